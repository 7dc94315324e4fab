"""Composed plans: an anomaly report over one scored series, stage by stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import z_score, z_within
from ..operators import anomaly, ngram, segments, signature
from ..sources.corpora import bigrams_of


def anomaly_report(rows: DataFrame, doc: str, order: list[str], grammar: str, lexical: str, times: int = 100) -> dict[str, DataFrame]:
    """Scores, segments with significance, their verdicts, and orphans, each a lazy DataFrame.

    grammar and lexical are numeric signal columns; a row is anomalous in a channel
    where its z-score is 2 or more.
    """
    scored = segments.combined_scores(rows, grammar, lexical)
    placed = scored.withColumn("i", F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1)
    marked = placed.withColumns({"gram": F.coalesce(F.col("z_g") >= 2, F.lit(False)), "lex": F.coalesce(F.col("z_l") >= 2, F.lit(False))})
    marked = marked.withColumn("class", segments.line_class(F.col("gram"), F.col("lex")))
    found = segments.segment_significance(scored, doc, order, times)
    inside = segments.members(found, marked, doc)
    count = lambda c: F.count_if(F.col("class") == c)
    verdicts = inside.groupBy(doc, "first", "last").agg(count("CONVERGENT").alias("n_conv"), count("GRAMATICAL").alias("n_gram"), count("LEXICA").alias("n_lex"))
    verdicts = verdicts.withColumn("verdict", segments.verdict(F.col("n_conv"), F.col("n_gram"), F.col("n_lex")))
    return {
        "scores": marked,
        "segments": found.join(verdicts, [doc, "first", "last"], "left"),
        "orphans": segments.orphans(marked.where("gram or lex"), found, doc),
    }


def fused(rows: DataFrame, doc: str, flags: dict[str, Column], channels: dict[str, list[str]], signals: list[str]) -> tuple[DataFrame, DataFrame]:
    """Flags, categories and the first-component score of every row, and the totals of each doc."""
    scored = anomaly.first_component(anomaly.flagged(rows, flags, channels), signals)
    return scored, anomaly.doc_totals(scored, doc, "score")


#: The eight flags of a line, and those of the two grammars, which make it a cross-channel one.
FLAGS = ["intra", "jump", "macro_bits", "macro_zero", "micro_mean", "micro_max", "micro_zero", "invalid"]
GRAMMARS = {"macro": ["macro_bits", "macro_zero"], "micro": ["micro_mean", "micro_max", "micro_zero"]}


def line_signals(lines: DataFrame, classes: DataFrame, names: list[str], significance: DataFrame, training: DataFrame) -> DataFrame:
    """Per line (doc, line): the signals of four channels.

    distance (to the doc's mean composition) and its z within the doc, jump (from the
    line before), macro_bits and macro_zero (of the line's type after that before, by
    a grammar of the training lines), micro_mean, micro_max, micro_zero (of the line's
    classes), frac_not_valid (share of its tested bigrams that are not significant).
    """
    typed = lambda s: F.when(F.array_max(s) == 0, "VOID").otherwise(F.element_at(F.array(*map(F.lit, names)), F.array_position(s, F.array_max(s)).cast("int")))

    def signatures(of: DataFrame) -> DataFrame:
        return signature.composition(signature.classified(of, classes), names)

    def sequences(of: DataFrame) -> DataFrame:
        """One line per doc: the types of its lines in order."""
        x = F.array_sort(F.collect_list(F.struct("line", typed(F.col("vector")).alias("type"))))
        return signatures(of).groupBy("doc").agg(x.alias("x")).select("doc", F.col("doc").alias("line"), F.transform("x", lambda t: t["type"]).alias("tokens"))

    def classed(of: DataFrame) -> DataFrame:
        token = of.select("doc", "line", F.posexplode("tokens").alias("pos", "token")).join(classes, "token", "left")
        x = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("class", F.lit("C_RARE")).alias("c"))))
        return token.groupBy("doc", "line").agg(x.alias("x")).select("doc", "line", F.transform("x", lambda t: t["c"]).alias("tokens"))

    own = signatures(lines)
    distance = signature.centre_distance(own, "doc", "vector").withColumn("distance", F.round("distance", 9)).withColumn("z_intra", z_within(F.col("distance"), "doc"))
    jump = signature.jumps(own).select("doc", "line", F.round("jump", 9).alias("jump"))
    macro = ngram.surprisal(sequences(lines), training=sequences(training)).select("doc", F.col("pos").alias("at"), F.col("bits").alias("macro_bits"), F.col("zero_prob").alias("macro_zero"))
    numbered = own.select("doc", "line", (F.row_number().over(Window.partitionBy("doc").orderBy("line")) - 1).alias("at"))
    micro = ngram.surprisal(classed(lines), training=classed(training)).groupBy("doc", "line").agg(F.avg("bits").alias("micro_mean"), F.max("bits").alias("micro_max"), F.max("zero_prob").alias("micro_zero"))
    invalid = anomaly.untested_share(bigrams_of(lines), significance).select("doc", "line", "frac_not_valid")
    keys = ["doc", "line"]
    out = distance.select("doc", "line", "z_intra").join(jump, keys).join(numbered.join(macro, ["doc", "at"]).drop("at"), keys, "left")
    return out.join(micro, keys, "left").join(invalid, keys, "left")


def line_flags(signals: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Adds the eight flags, their number, the category and cross: signals against the corpus, from one row of means and spreads."""
    columns = ["jump", "macro_bits", "micro_mean", "micro_max", "frac_not_valid"]
    s = signals.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    high = lambda c: F.round(z_score(F.col(c), F.col(f"m_{c}"), F.col(f"s_{c}")), 9) >= threshold
    flags = {
        "intra": F.round("z_intra", 9) >= threshold, "jump": high("jump"), "macro_bits": high("macro_bits"), "macro_zero": F.col("macro_zero"),
        "micro_mean": high("micro_mean"), "micro_max": high("micro_max"), "micro_zero": F.col("micro_zero"), "invalid": high("frac_not_valid"),
    }
    named = {f"flag_{k}": c for k, c in flags.items()}
    joined = signals.join(F.broadcast(s))
    return anomaly.flagged(joined, named, {k: [f"flag_{f}" for f in fs] for k, fs in GRAMMARS.items()}).select("doc", "line", *named, "n_flags", "category", "cross")


def summary(parts: dict[str, DataFrame]) -> DataFrame:
    """One row per table: its name and number of rows, from single-row aggregates."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def roll_up(phases: dict[str, tuple[DataFrame | None, dict[str, Column]]]) -> DataFrame:
    """phase, figure, value (double): the figures of every phase, each phase one aggregate over its table; a phase without a table has one row without figure and value."""
    out = None
    for phase, (df, figures) in phases.items():
        if df is None:
            one = next(d for d, _ in phases.values() if d is not None).sparkSession.range(1).select(F.lit(phase).alias("phase"), F.lit(None).cast("string").alias("figure"), F.lit(None).cast("double").alias("value"))
        else:
            row = df.agg(*(c.cast("double").alias(name) for name, c in figures.items()))
            one = row.select(F.lit(phase).alias("phase"), F.explode(F.array(*(F.struct(F.lit(n).alias("figure"), F.col(n).alias("value")) for n in figures))).alias("x")).select("phase", "x.*")
        out = one if out is None else out.unionByName(one)
    return out
