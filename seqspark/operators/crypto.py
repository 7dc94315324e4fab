"""Rare markers, runs, and the ranking of lines that carry both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def markers(lines: DataFrame, structural: list[str]) -> DataFrame:
    """Lines with the tokens that are not structural."""
    return lines.withColumn("tokens", F.filter("tokens", lambda t: ~t.isin(structural)))


def binary(tokens: Column, zero: str) -> Column:
    return F.transform(tokens, lambda t: F.when(t == zero, 0).otherwise(1))


def rare_tokens(lines: DataFrame, most: int = 2, whole: bool = False) -> DataFrame:
    """Per line (whole: per doc, whose stream the lines are): tokens that are rare in their doc, as a count and a list."""
    tokens = lines.select("doc", F.col("doc" if whole else "line").alias("line"), F.explode("tokens").alias("token"))
    rare = tokens.groupBy("doc", "token").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    return tokens.join(rare, ["doc", "token"]).groupBy("doc", "line").agg(F.count("*").alias("n_rare"), F.array_join(F.array_sort(F.collect_set("token")), " | ").alias("rare"))


def candidates(rare: DataFrame, runs: DataFrame, marked: DataFrame) -> DataFrame:
    """Lines with rare tokens or odd runs, with their category if any, and priority = 10 n_rare + |z|."""
    keys = ["doc", "line"]
    both = rare.join(runs.select(*keys, "z"), keys, "full").join(marked, keys, "left")
    return both.withColumn("priority", 10 * F.coalesce("n_rare", F.lit(0)) + F.abs(F.coalesce("z", F.lit(0.0))))


def verdict_by_ratio(ratio: Column, tolerance: float = 0.15) -> Column:
    """Does the coincidence of marked lines differ from that of the corpus?"""
    return F.when(ratio.isNull(), "NO_AVALUABLE").when(ratio < 1 - tolerance, "MES_PLA").when(ratio > 1 + tolerance, "MES_CONCENTRAT").otherwise("COMPATIBLE")


def indicators(tests: dict[str, Column]) -> Column:
    """Names of the indicators that hold, joined by commas."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in tests.items()))), ",")


__all__ = ["binary", "candidates", "indicators", "markers", "rare_tokens", "verdict_by_ratio"]
