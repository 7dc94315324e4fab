"""File sources and sinks: text corpora, JSON and CSV tables, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut
from ..operators import parse


#: Splits of files whose starts are broadcast; more are joined by a shuffle.
BROADCAST_SPLITS = 200_000


def text_corpus(spark: SparkSession, folder: str, suffix: str = "txt") -> DataFrame:
    """Files below a folder, one row per line: doc_path, ordinal (in its file, from 0), row (over all files in path order), value.

    Files are read in splits of bytes, so a file of any size is many tasks.  Lines of a
    split are read in order; a row per split, with its first number and its lines, gives
    what comes before it.  Lines end with a line feed, a carriage return or both.
    """
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").text(folder)
    m = F.col("_metadata")
    lines = read.select(m["file_path"].alias("doc_path"), m["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("id"), "value")
    splits = lines.groupBy("doc_path", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    file, every = Window.partitionBy("doc_path").orderBy("split"), Window.orderBy("doc_path", "split")
    starts = cut(splits.select("doc_path", "split", "first", (F.sum("n").over(file) - F.col("n")).alias("in_file"), (F.sum("n").over(every) - F.col("n")).alias("in_all")))
    few = starts.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    placed = lines.join(F.broadcast(starts) if few else starts, ["doc_path", "split"])
    own = F.col("id") - F.col("first")
    return placed.select("doc_path", (F.col("in_file") + own).alias("ordinal"), (F.col("in_all") + own).alias("row"), "value")


def instruction_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered rows of a text corpus: doc, header, line, raw, ordinal."""
    rows = text_corpus(spark, folder)
    header = parse.header_points(F.col("value"))
    heads = rows.where((F.col("ordinal") == 0) & (header != "")).select("doc_path", header.alias("header"))
    return (
        parse.numbered_rows(rows, "value")
        .join(heads, "doc_path", "left")
        .select(parse.clean_name(F.element_at(F.split("doc_path", "/"), -1)).alias("doc"), F.coalesce("header", F.lit("")).alias("header"), "line", "raw", "ordinal")
    )


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON document or array of documents per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, required: list[str] | None = None) -> DataFrame:
    """A CSV table with a header; blanks are null, and so is what is not of its column's type. Rows without a value in a required column (an end mark, say) are skipped."""
    rows = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
    return rows.dropna(subset=required) if required else rows


def optional_table(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet") -> DataFrame:
    """A table, or no rows of its schema if nothing is there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(schema).format(kind).load(path)
    return spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, decimals: int = 4, true: str = "TRUE", false: str = "FALSE") -> None:
    """CSV with a header: doubles with so many decimals, booleans in the given words, nulls blank."""
    columns = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.format_string(f"%.{decimals}f", c.cast("double"))
            c = F.when(F.col(f"`{field.name}`").isNotNull(), c)
        elif isinstance(field.dataType, T.BooleanType):
            c = F.when(c, true).when(~c, false)
        columns.append(c.alias(field.name))
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str, form: str, *columns: str, order: list[str] | None = None) -> None:
    """One formatted text line per row; with `order`, files in path order hold the lines in that order."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.select(F.format_string(form, *columns).alias("value")).write.mode("overwrite").text(path)
