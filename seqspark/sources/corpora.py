"""Corpora: any table read as docs of ordered lines of ordered tokens.

The common shape is `lines` with columns doc, line, tokens (array of strings).  A
line's tokens stay in one array, so sliding windows over them are row-local array
expressions and need no shuffle; `tokens_of` and `bigrams_of` make the long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Letters of a lower-cased word.
WORD = "[a-zà-öø-ÿ]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered_lines(rows: DataFrame, doc: Column, line: Column, token: Column, *order: Column) -> DataFrame:
    """One array of tokens per (doc, line), in the given order."""
    keyed = rows.select(doc.alias("doc"), line.alias("line"), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), token.alias("token")).alias("x"))
    return keyed.groupBy("doc", "line").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["token"]).alias("tokens"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc: user, line: day, tokens: event types by time."""
    c = F.col
    return ordered_lines(table(spark, sf_dir, "events"), c("user_id"), c("ts").cast("date"), c("event_type"), c("ts"), c("event_id"))


def user_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc: user, line: day, in order; together a user's days are its stream, without one array for all of it."""
    return event_lines(spark, sf_dir)


def stream_bigrams(pieces: DataFrame) -> DataFrame:
    """doc, a, b for adjacent tokens of each doc's stream, which is given in ordered pieces (doc, line, tokens).

    Pairs inside a piece are row-local; those across pieces come from the pieces' ends,
    so that a window runs over pieces, not over tokens.
    """
    ends = pieces.where(F.size("tokens") > 0).select("doc", "line", F.element_at("tokens", 1).alias("b"), F.element_at("tokens", -1).alias("last"))
    across = ends.select("doc", F.lag("last").over(Window.partitionBy("doc").orderBy("line")).alias("a"), "b").where("a IS NOT NULL")
    return bigrams_of(pieces).select("doc", "a", "b").unionByName(across)


def stream_starts(pieces: DataFrame) -> DataFrame:
    """doc, token: the first token of each doc's stream."""
    return pieces.where(F.size("tokens") > 0).groupBy("doc").agg(F.min_by(F.element_at("tokens", 1), "line").alias("token"))


def user_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc and line: user, tokens: all its event types by time."""
    c = F.col
    return ordered_lines(table(spark, sf_dir, "events"), c("user_id"), c("user_id"), c("event_type"), c("ts"), c("event_id"))


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc: conversation, line: turn, tokens: lower-cased words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), F.lit(1))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line"), words.alias("tokens"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc: source, line: document, tokens: lower-cased words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), F.lit(1))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("line"), words.alias("tokens"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc: customer, line: order, tokens: return flag and status of its items."""
    c = F.col
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), c("l_orderkey") == c("o_orderkey"))
    token = F.concat("l_returnflag", "l_linestatus")
    return ordered_lines(items, c("o_custkey"), c("l_orderkey"), token, c("l_linenumber"), c("l_partkey"), c("l_suppkey"), c("l_extendedprice"))


def last_of_key(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The last row of every key: the policy for line numbers that repeat within a doc."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(ordinal)).alias("x"))
    return best.select(*keys, *(F.col(f"x.{c}").alias(c) for c in others)).select(rows.columns)


def tokens_of(lines: DataFrame) -> DataFrame:
    """doc, line, pos (from 0), n (tokens of the line), token."""
    return lines.select("doc", "line", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "token"))


def bigrams_of(lines: DataFrame) -> DataFrame:
    """doc, line, a, b for adjacent tokens of a line."""
    n = F.size("tokens")
    pairs = F.arrays_zip(F.slice("tokens", F.lit(1), n - 1).alias("a"), F.slice("tokens", F.lit(2), n - 1).alias("b"))
    return lines.where(n >= 2).select("doc", "line", F.explode(pairs).alias("p")).select("doc", "line", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
