"""What the operators of this subpackage share: shared storage and Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, a local session takes a folder of its own; a cluster is refused."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="seqspark-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/seqspark/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and survives the loss of executors.

    The shuffle files behind it are no longer needed then and are given back at once.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = new_folder(spark, name), spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove what save() wrote for these frames, once nothing reads them any more."""
    for df in frames:
        delete(df.sparkSession, df.folder)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage with Hadoop's own file system classes."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to `most` at most; a larger item is a range of its own."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def text_blocks(batches: Iterator[pa.RecordBatch], most: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Arrow batches cut so that each holds about `most` characters; with the texts as a list (null: None), those of one block at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_pylist()
        for lo, hi in slices(sizes, most):
            block = batch.slice(lo, hi - lo)
            yield block, block.column(text).to_pylist()


_SPACE = re.compile(r"[\x20\x09-\x0D]")


def text_pieces(text: str, most: int) -> Iterator[str]:
    """A text cut before white space into pieces of about so many characters."""
    lo = 0
    while lo < len(text):
        m = _SPACE.search(text, lo + most)
        hi = m.start() if m else len(text)
        yield text[lo:hi]
        lo = hi
