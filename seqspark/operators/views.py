"""Tables behind charts, joins of channels, and small summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpora import last_of_key, tokens_of


def with_dimension(df: DataFrame, dimension: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    """A lookup column with a default for keys that the dimension lacks."""
    return df.join(dimension.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def channels_joined(base: DataFrame, channels: list[DataFrame], keys: list[str], ordinal: str) -> DataFrame:
    """Left joins of several channels on the same keys, each reduced to the last row of a key first.

    All sides are grouped by the same keys, so every join reuses their partitioning.
    """
    out = last_of_key(base, keys, ordinal)
    for c in channels:
        out = out.join(last_of_key(c, keys, ordinal).drop(ordinal), keys, "left")
    return out


def pattern_doc_counts(lines: DataFrame, low: int = 2, high: int = 3) -> DataFrame:
    """Occurrences of every shared pattern in each of its docs, with the doc's number of lines."""
    from .patterns import shared_grams

    shared = shared_grams(lines, low, high).select("pattern")
    one = lambda k: F.transform(F.sequence(F.lit(1), F.size("tokens") - (k - 1)), lambda i: F.array_join(F.slice("tokens", i, k), " "))
    per = None
    for k in range(low, high + 1):
        x = lines.where(F.size("tokens") >= k).select("doc", F.explode(one(k)).alias("pattern")).groupBy("doc", "pattern").agg(F.count("*").alias("n"))
        per = x if per is None else per.unionByName(x)
    sizes = lines.groupBy("doc").agg(F.count("*").alias("doc_lines"))
    return per.join(shared, "pattern", "left_semi").join(sizes, "doc")


def line_ranges(lines: DataFrame) -> DataFrame:
    """First and last line of each doc, and how many it has."""
    return lines.groupBy("doc").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("n_lines"))


def mean_increment(lines: DataFrame) -> DataFrame:
    """Mean difference between successive line numbers: the range over the gaps, no window needed."""
    r = line_ranges(lines)
    return r.select("doc", F.try_divide(F.col("last_line") - F.col("first_line"), F.col("n_lines") - 1).alias("increment"))


def first_places(lines: DataFrame, k: int = 5) -> DataFrame:
    """Each token's number of places in its line and the first k of them."""
    t = tokens_of(lines)
    w = Window.partitionBy("doc", "line", "token").orderBy("pos")
    placed = t.withColumn("r", F.row_number().over(w))
    few = F.collect_list(F.when(F.col("r") <= k, F.col("pos")))
    return placed.groupBy("doc", "line", "token").agg(F.count("*").alias("n"), F.array_join(F.array_sort(few), ",").alias("places"))


def discordant_pairs(discordances: DataFrame, most: int = 3) -> DataFrame:
    """How often a symbol stands out against a ruling one, from the first few places of each line."""
    w = Window.partitionBy("doc", "line").orderBy("position")
    return discordances.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).groupBy("ruler", "symbol").agg(F.count("*").alias("n"))


def largest_deviation(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The largest absolute z-score of each column over the table: the common axis of small charts."""
    s = df.agg(*(f(c).alias(f"{k}_{n}") for k, c in columns.items() for n, f in (("lo", F.min), ("hi", F.max), ("m", F.avg), ("s", F.stddev_pop))))
    widest = lambda k: F.try_divide(F.greatest(F.col(f"{k}_hi") - F.col(f"{k}_m"), F.col(f"{k}_m") - F.col(f"{k}_lo")), F.col(f"{k}_s"))
    return s.select(*(widest(k).alias(k) for k in columns))


def series_with_bands(placed: DataFrame, segments: DataFrame, doc: str) -> DataFrame:
    """Each row of a series with the segment it lies in, if any."""
    own = segments.select(doc, "first", "last", F.explode(F.sequence("first", "last")).alias("i"))
    return placed.join(own, [doc, "i"], "left")
