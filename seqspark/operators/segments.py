"""Runs, gaps and contiguous anomalous segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .ordinals import edges, in_pieces
from .stats import benjamini_hochberg, percentile_values, z_global


def maximal_runs(df: DataFrame, by: list[str], order: list[str], flag: Column, least: int = 3) -> DataFrame:
    """Maximal runs of true flags: by, first, last (positions from 0) and length, where long enough; runs of a piece, then those that go over pieces put together."""
    placed, spans = in_pieces(df.withColumn("flag_", flag), by, order)
    island = F.col("i") - F.row_number().over(Window.partitionBy(*by, "piece_").orderBy("i"))
    runs = placed.where("flag_").withColumn("island_", island).groupBy(*by, "piece_", "island_").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    inner, open_ = edges(runs.drop("island_"), spans, by, "first", "last")
    w = Window.partitionBy(*by).orderBy("first")
    new = F.coalesce(F.col("first") != F.lag("last").over(w) + 1, F.lit(True)).cast("int")
    joined = open_.withColumn("new_", new).withColumn("run_", F.sum("new_").over(w)).groupBy(*by, "run_").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    every = inner.select(*by, "first", "last").unionByName(joined.select(*by, "first", "last"))
    return every.withColumn("length", (F.col("last") - F.col("first") + 1).cast("long")).where(F.col("length") >= least)


def gap_islands(df: DataFrame, by: list[str], number: str, gap: int = 2, least: int = 3) -> DataFrame:
    """Runs of numbers that lie at most `gap` apart: first, last, length; islands of a piece, then those that go over pieces put together."""
    placed, spans = in_pieces(df, by, [number], "at_")
    w = Window.partitionBy(*by, "piece_").orderBy(number)  # the order in which in_pieces() has sorted them
    marked = placed.withColumn("new_", (F.coalesce(F.col(number) - F.lag(number).over(w), F.lit(0)) > gap).cast("int"))
    islands = marked.withColumn("island_", F.sum("new_").over(w)).groupBy(*by, "piece_", "island_")
    parts = islands.agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("length"), F.min("at_").alias("from_"), F.max("at_").alias("to_"))
    inner, open_ = edges(parts.drop("island_"), spans, by, "from_", "to_")
    v = Window.partitionBy(*by).orderBy("from_")
    apart = (F.lag("to_").over(v) + 1 != F.col("from_")) | (F.coalesce(F.col("first") - F.lag("last").over(v), F.lit(0)) > gap)
    chained = open_.withColumn("new_", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("run_", F.sum("new_").over(v)).groupBy(*by, "run_")
    joined = chained.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("length").alias("length"))
    return inner.select(*by, "first", "last", "length").unionByName(joined.select(*by, "first", "last", "length")).where(F.col("length") >= least)


def max_window_mean(df: DataFrame, by: list[str], order: list[str], value: str, length: int) -> DataFrame:
    """The largest mean over full windows of consecutive rows; a piece takes the rows before it that its first windows reach back to."""
    placed, spans = in_pieces(df.select(*by, *order, value), by, order, "at_")
    rows = placed.select(*by, "piece_", "at_", F.col(value).alias("x_"), F.lit(False).alias("lent_"))
    ahead = spans.where("before_ > 0").select(*(F.col(c).alias(f"{c}__") for c in by), F.col("piece_").alias("to__"), "before_")
    reach = (F.col("at_") < F.col("before_")) & (F.col("at_") >= F.col("before_") - (length - 1))
    for c in by:
        reach = reach & F.col(c).eqNullSafe(F.col(f"{c}__"))
    lent = rows.join(F.broadcast(ahead), reach).select(*by, F.col("to__").alias("piece_"), "at_", "x_", F.lit(True).alias("lent_"))
    w = Window.partitionBy(*by, "piece_").orderBy("at_")
    full = rows.unionByName(lent).withColumn("m_", F.when(~F.col("lent_") & (F.col("at_") >= length - 1), F.avg("x_").over(w.rowsBetween(-(length - 1), 0))))
    return full.groupBy(*by).agg(F.max("m_").alias("max_mean"))


def combined_scores(df: DataFrame, grammar: str, lexical: str, share: float = 0.6) -> DataFrame:
    """Adds score = z(grammar) + z(lexical), and high: score at or above the given percentile of all."""
    z = z_global(z_global(df, grammar, "z_g", "centred"), lexical, "z_l", "centred").withColumn("score", F.col("z_g") + F.col("z_l"))
    z = cut(z)  # read several times, and compared with a number taken from it
    return z.withColumn("high", F.col("score") >= F.lit(percentile_values(z, "score", [share])[0]))


#: Rows of a doc's series up to which one task makes all its replicates.
LONG = 200_000


def _permuted(doc: str, times: int, seed: int):
    """From rows in the order of (doc, part_, i): doc, length and the largest mean over windows of that length in each of the part's replicates, in the order of place_hash()."""

    def best(name: str, scores: np.ndarray, lengths: list[int], perms: range) -> list[list[float]]:
        out: list[list[float]] = [[] for _ in lengths]
        places = [str(i).encode() for i in range(len(scores))]
        for perm in perms:
            start, keys = hashlib.md5(f"{seed}|{perm}|{name}|".encode()), []
            for place in places:
                h = start.copy()
                h.update(place)
                keys.append(h.digest())
            key = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2)
            s = np.concatenate([[0.0], np.cumsum(scores[np.lexsort((key[:, 1], key[:, 0]))])])
            for k, n in enumerate(lengths):
                out[k].append(float((s[n:] - s[:-n]).max()) / n)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def leave() -> pa.RecordBatch:
            own, scores = now, np.concatenate(held)
            found = best(own[1], scores, own[2], range(own[4], times, own[3]))
            n = len(own[2])
            return pa.RecordBatch.from_arrays([pa.concat_arrays([own[0]] * n), pa.array(own[2], pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=[doc, "length", "best"])

        for batch in batches:
            names, part, score = batch.column("name_").to_pylist(), batch.column("part_").to_numpy(), batch.column("score").to_numpy()
            code = batch.column("name_").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((code[1:] != code[:-1]) | (part[1:] != part[:-1])) + 1
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(part)], strict=True):
                if i == j:
                    continue
                if now is None or (names[i], part[i]) != (now[1], now[4]):
                    if now is not None:
                        yield leave()
                    now, held = (batch.column(doc).slice(i, 1), names[i], batch.column("lengths")[i].as_py(), int(batch.column("parts_")[i].as_py()), int(part[i])), []
                held.append(score[i:j])
        if now is not None:
            yield leave()

    return run


def segment_significance(scored: DataFrame, doc: str, order: list[str], times: int = 100, seed: int = 42, least: int = 3) -> DataFrame:
    """Maximal runs of high scores with permutation p and q.

    The series of a doc is shuffled `times` times; p counts how often some window of
    the segment's length reaches its mean.  Replicates depend on the doc and the
    length alone, so a doc's series is dealt once and permuted for all its segments in
    the task; one of over LONG rows is dealt in several copies, each for some of the
    replicates.
    """
    w = Window.partitionBy(doc).orderBy(*order)
    placed = scored.withColumn("i", F.row_number().over(w) - 1).select(doc, "i", "score")
    runs = maximal_runs(scored, [doc], order, F.col("high"), least)
    mean = members(runs, placed, doc).withColumn("length", (F.col("last") - F.col("first") + 1).cast("long"))
    seg = mean.groupBy(doc, "first", "last", "length").agg(F.avg("score").alias("mean_score"), F.sum("score").alias("total_score"))
    wanted = runs.groupBy(doc).agg(F.sort_array(F.collect_set("length")).alias("lengths"))
    sizes = placed.groupBy(doc).agg(F.count("*").alias("n_")).join(wanted, doc).select(doc, "lengths", F.least(F.lit(times), F.ceil(F.col("n_") / LONG)).cast("int").alias("parts_"))
    copies = sizes.select(doc, "lengths", "parts_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1)).alias("part_"))
    dealt = placed.join(copies, doc).select(doc, F.col(doc).cast("string").alias("name_"), "i", F.coalesce(F.col("score"), F.lit(0.0)).alias("score"), "lengths", "parts_", "part_")
    best = dealt.repartition(doc, "part_").sortWithinPartitions(doc, "part_", "i").mapInArrow(_permuted(doc, times, seed), f"`{doc}` {scored.schema[doc].dataType.simpleString()}, length long, best array<double>")
    reached = F.size(F.filter("best", lambda x: x >= F.col("mean_score") - 1e-12))
    p = seg.join(best, [doc, "length"]).groupBy(doc, "first", "last", "length", "mean_score", "total_score").agg(
        ((F.sum(reached) + 1) / (F.sum(F.size("best")) + 1)).alias("p_value")
    )
    return benjamini_hochberg(p, "p_value", [doc, "first"]).withColumn("significant", F.col("q_value") <= 0.05)


def line_class(grammar: Column, lexical: Column) -> Column:
    return F.when(grammar & lexical, "CONVERGENT").when(grammar, "GRAMATICAL").when(lexical, "LEXICA").otherwise("CAP")


def verdict(n_conv: Column, n_gram: Column, n_lex: Column) -> Column:
    """Of a segment: convergent lines decide, then the larger of the two kinds."""
    return (
        F.when(n_conv > 0, "CONVERGENCIA")
        .when((n_gram > 0) & (n_lex == 0), "PERFIL_GRAMATICAL")
        .when((n_lex > 0) & (n_gram == 0), "PERFIL_LEXIC")
        .when((n_gram > 0) & (n_lex > 0), "MIXT")
        .otherwise("SENSE_SENYAL")
    )


def members(segments: DataFrame, placed: DataFrame, doc: str) -> DataFrame:
    """Rows of the series inside their segment: a range join kept on the doc, with the segment's places exploded."""
    own = segments.select(doc, "first", "last", F.explode(F.sequence("first", "last")).alias("i"))
    return own.join(placed, [doc, "i"])


def orphans(placed: DataFrame, segments: DataFrame, doc: str) -> DataFrame:
    """Anomalous rows outside every segment."""
    covered = segments.select(doc, F.explode(F.sequence("first", "last")).alias("i"))
    return placed.join(covered, [doc, "i"], "left_anti")


def covered(placed: DataFrame, segments: DataFrame, doc: str) -> DataFrame:
    inside = segments.select(doc, F.explode(F.sequence("first", "last")).alias("i"))
    return placed.join(inside, [doc, "i"], "left_semi")
