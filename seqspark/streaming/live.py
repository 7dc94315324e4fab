"""Streaming forms of the counts: bigram counts per time window of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_token_counts(stream: DataFrame, time: str, token: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Token counts per tumbling window; rows later than `late` are past the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.col(token).alias("token")).agg(F.count("*").alias("n")).select("w.start", "w.end", "token", "n")


def sessions(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of events of one key without a longer gap: the streaming form of gap islands."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), F.col(by)).agg(F.count("*").alias("length")).select(by, "w.start", "w.end", "length")
