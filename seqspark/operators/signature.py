"""Line signatures: class composition, jumps between lines, distances to the doc's centre."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine_distance, euclidean, z_within


def classified(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """doc, line, token, class of every token; class is null for tokens without one."""
    return lines.select("doc", "line", F.explode("tokens").alias("token")).join(classes, "token", "left")


def composition(tokens: DataFrame, classes: list[str]) -> DataFrame:
    """Per line: tokens, unknown tokens, and the fraction of each class, in one pass with a fixed class list."""
    known = F.count("class")
    return tokens.groupBy("doc", "line").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("class").isNull()).alias("unknown"),
        F.array(*(F.coalesce(F.try_divide(F.count_if(F.col("class") == c), known), F.lit(0.0)) for c in classes)).alias("vector"),
    )


def jumps(signatures: DataFrame, order: str = "line") -> DataFrame:
    """Adds the cosine distance to the previous line of the doc; null for the first."""
    w = Window.partitionBy("doc").orderBy(order)
    return signatures.withColumn("jump", cosine_distance(F.lag("vector").over(w), F.col("vector")))


def mean_vector(vectors: DataFrame, by: str, column: str) -> DataFrame:
    """Mean vector of each group, by dimension in long form: sums are combined before they are moved."""
    long = vectors.select(by, F.posexplode(column).alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("x"))
    return long.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center"))


def centre_distance(vectors: DataFrame, by: str, column: str, metric: str = "cosine") -> DataFrame:
    """Adds the distance of each vector to its group's mean vector, and its z-score within the group."""
    centers = mean_vector(vectors, by, column)
    d = cosine_distance if metric == "cosine" else euclidean
    out = vectors.join(centers, by).withColumn("distance", d(F.col(column).cast("array<double>"), F.col("center")))
    return out.withColumn("z", z_within(F.col("distance"), by)).drop("center")


def cluster_profile(signatures: DataFrame, label: str, classes: list[str], top: int = 3) -> DataFrame:
    """Per cluster: mean composition made to sum to 1, and its top classes; cluster_summary() has the lines."""
    long = signatures.select(label, F.posexplode("vector").alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    total = F.sum("x").over(Window.partitionBy(label))
    ranked = long.withColumn("share", F.try_divide("x", total)).withColumn("r", F.row_number().over(Window.partitionBy(label).orderBy(F.desc("share"), "i")))
    names = F.array(*(F.lit(c) for c in classes))
    return ranked.where(F.col("r") <= top).select(label, F.col("r").alias("rank"), names[F.col("i")].alias("class"), "share")


def cluster_summary(signatures: DataFrame, label: str) -> DataFrame:
    """Per cluster of lines (doc, n, unknown): lines, mean and largest length, share of unknown tokens, docs, and the most lines in one doc."""
    per = signatures.groupBy(label, "doc").agg(F.count("*").alias("lines"), F.sum("n").alias("n"), F.max("n").alias("longest"), F.sum("unknown").alias("unknown"))
    return per.groupBy(label).agg(
        F.sum("lines").alias("lines"), (F.sum("n") / F.sum("lines")).alias("mean_length"), F.max("longest").alias("max_length"),
        (F.sum("unknown") / F.sum("n")).alias("unknown_share"), F.count("*").alias("docs"), F.max("lines").alias("most_in_a_doc"),
    )
