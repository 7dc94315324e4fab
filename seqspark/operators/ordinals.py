"""Numbers that run over the whole table, without one task for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def stream_ordinals(lines: DataFrame, doc: str, line: str, parts: int = 64) -> DataFrame:
    """Adds ordinal: the number of lines before this one in the order of (doc, line), docs being numbers.

    Docs are counted and dealt to ranges by quantiles (`parts` numbers on the driver);
    totals run within a range, and one row per range carries them on.  Lines are
    numbered within their doc.
    """
    per = lines.groupBy(doc).agg(F.count("*").alias("n_"))
    bounds = sorted(set(per.approxQuantile(doc, [i / parts for i in range(1, parts)], 0.001)))
    cut = F.aggregate(F.array(*(F.lit(float(b)) for b in bounds)), F.lit(0), lambda n, b: n + (F.col(doc) > b).cast("int")) if bounds else F.lit(0)
    ranged = per.withColumn("part_", cut)
    sizes = ranged.groupBy("part_").agg(F.sum("n_").alias("size_"))  # a row per range
    before = sizes.select("part_", (F.sum("size_").over(Window.orderBy("part_")) - F.col("size_")).alias("before_"))
    within = F.sum("n_").over(Window.partitionBy("part_").orderBy(doc)) - F.col("n_")
    offsets = ranged.join(F.broadcast(before), "part_").select(doc, (F.col("before_") + within).alias("offset_"))
    place = F.row_number().over(Window.partitionBy(doc).orderBy(line)) - 1
    return lines.withColumn("place_", place).join(offsets, doc).withColumn("ordinal", F.col("offset_") + F.col("place_")).drop("offset_", "place_")


#: Rows on average at most that a task sorts to number them.
ROWS = 250_000


def in_pieces(df: DataFrame, by: list[str], order: list[str], place: str = "i") -> tuple[DataFrame, DataFrame]:
    """df with piece_ and its place in its `by` group (from 0, by `order`), and the bounds of groups that go over several pieces.

    Rows are dealt to ranges of (by, order) and written, so a group of any size is many
    pieces; a piece's rows are numbered by themselves, ROWS a task.  Only the first group of a piece
    can go on from the piece before, so what is carried over is a row per piece: by,
    piece_, before_ and last_ (places of the group's first and last row there).
    """
    ranged = cut(df.repartitionByRange(*by, *order).withColumn("piece_", F.spark_partition_id()))
    dealt, least = ranged, -(-ranged.count() // ROWS)
    if least > int(ranged.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        dealt = ranged.repartition(least, *by, "piece_")
    every = Window.partitionBy(*by)
    sizes = ranged.groupBy(*by, "piece_").agg(F.count("*").alias("n_"))
    sizes = sizes.withColumn("before_", F.sum("n_").over(every.orderBy("piece_")) - F.col("n_")).withColumn("pieces_", F.count("*").over(every))
    spans = sizes.where("pieces_ > 1").select(*by, "piece_", "before_", (F.col("before_") + F.col("n_") - 1).alias("last_"))
    carried = spans.where("before_ > 0").select(*(F.col(c).alias(f"{c}__") for c in by), F.col("piece_").alias("piece__"), "before_")
    own = F.row_number().over(Window.partitionBy(*by, "piece_").orderBy(*order)) - 1
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{c}__")) for c in by), F.col("piece_") == F.col("piece__"))
    numbered = dealt.withColumn("own__", own).join(F.broadcast(carried), same, "left").withColumn(place, (F.col("own__") + F.coalesce("before_", F.lit(0))).cast("int"))
    return numbered.select(*ranged.columns, place), spans


def edges(parts: DataFrame, spans: DataFrame, by: list[str], first: str, last: str) -> tuple[DataFrame, DataFrame]:
    """parts (by, piece_, places `first` to `last`) that cannot go on in another piece, and those that can: two per piece at most."""
    other = spans.select(*(F.col(c).alias(f"{c}__") for c in by), F.col("piece_").alias("piece__"), "before_", "last_")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{c}__")) for c in by), F.col("piece_") == F.col("piece__"))
    edge = F.coalesce((F.col(first) == F.col("before_")) | (F.col(last) == F.col("last_")), F.lit(False))
    marked = parts.join(F.broadcast(other), same, "left").withColumn("edge__", edge).select(*parts.columns, "edge__")
    return marked.where(~F.col("edge__")).drop("edge__"), marked.where("edge__").drop("edge__")


def zipped(sequences: DataFrame, items: str, lines: DataFrame) -> DataFrame:
    """doc, ordinal, item, line: the items of each doc's sequence beside its lines in order; items beyond the lines have none."""
    item = sequences.select("doc", F.posexplode(items).alias("ordinal", "item"))
    placed = lines.select("doc", "line", (F.row_number().over(Window.partitionBy("doc").orderBy("line")) - 1).alias("ordinal"))
    return item.join(placed, ["doc", "ordinal"], "left").select("doc", "ordinal", "item", "line")
