"""Token, bigram and position counts, and the Markov tables that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpora import bigrams_of, tokens_of


def token_counts(lines: DataFrame) -> DataFrame:
    return tokens_of(lines).groupBy("token").agg(F.count("*").alias("n"))


def bigram_counts(lines: DataFrame) -> DataFrame:
    return bigrams_of(lines).groupBy("a", "b").agg(F.count("*").alias("n"))


def with_margins(counts: DataFrame) -> DataFrame:
    """Bigram counts with n_a, n_b and the total; the margins are sums over a table of distinct bigrams."""
    n_a = counts.groupBy("a").agg(F.sum("n").alias("n_a"))
    n_b = counts.groupBy("b").agg(F.sum("n").alias("n_b"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(n_a, "a").join(n_b, "b").join(F.broadcast(total))  # one row


def transition_probs(lines: DataFrame) -> DataFrame:
    """P(b | a) and P(a | b) of every bigram."""
    return with_margins(bigram_counts(lines)).select("a", "b", "n", (F.col("n") / F.col("n_a")).alias("p_b_given_a"), (F.col("n") / F.col("n_b")).alias("p_a_given_b"))


def end_counts(lines: DataFrame) -> DataFrame:
    """How often a token begins and ends a line."""
    ends = lines.where(F.size("tokens") > 0).select(
        F.explode(F.array(F.struct(F.element_at("tokens", 1).alias("token"), F.lit(1).alias("i"), F.lit(0).alias("f")), F.struct(F.element_at("tokens", -1).alias("token"), F.lit(0).alias("i"), F.lit(1).alias("f")))).alias("x")
    )
    return ends.groupBy("x.token").agg(F.sum("x.i").alias("n_first"), F.sum("x.f").alias("n_last"))


def entropies(lines: DataFrame, of: str = "b", given: str = "a") -> DataFrame:
    """Entropy in bits, and the number of distinct partners, of successors (or predecessors) per token."""
    counts = bigram_counts(lines).select(F.col(given).alias("token"), "n")
    # -sum(n/N log2(n/N)) = log2 N - sum(n log2 n)/N: one pass, no join
    out = counts.groupBy("token").agg(F.sum("n").alias("total"), F.count("*").alias("partners"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return out.select("token", "total", "partners", F.greatest(F.lit(0.0), F.log2("total") - F.col("s") / F.col("total")).alias("entropy"))


def markov_profile(lines: DataFrame) -> DataFrame:
    """Per token: count, P(t), P(first), P(last), successor and predecessor entropy and partners."""
    tokens = token_counts(lines).join(F.broadcast(token_counts(lines).agg(F.sum("n").alias("all_tokens"))))
    n_lines = lines.where(F.size("tokens") > 0).agg(F.count("*").alias("all_lines"))
    succ = entropies(lines).select("token", F.col("entropy").alias("h_succ"), F.col("partners").alias("n_succ"))
    pred = entropies(lines, "a", "b").select("token", F.col("entropy").alias("h_pred"), F.col("partners").alias("n_pred"))
    return (
        tokens.join(F.broadcast(n_lines))
        .join(end_counts(lines), "token", "left")
        .join(succ, "token", "left")
        .join(pred, "token", "left")
        .select(
            "token", "n",
            (F.col("n") / F.col("all_tokens")).alias("p"),
            (F.coalesce("n_first", F.lit(0)) / F.col("all_lines")).alias("p_first"),
            (F.coalesce("n_last", F.lit(0)) / F.col("all_lines")).alias("p_last"),
            F.coalesce("h_succ", F.lit(0.0)).alias("h_succ"), F.coalesce("n_succ", F.lit(0)).alias("n_succ"),
            F.coalesce("h_pred", F.lit(0.0)).alias("h_pred"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"),
        )
    )


def position_stats(lines: DataFrame) -> DataFrame:
    """Mean and population spread of the normalised position pos / (n - 1) per token."""
    x = F.when(F.col("n") > 1, F.col("pos") / (F.col("n") - 1)).otherwise(0.0)
    return tokens_of(lines).groupBy("token").agg(F.count("*").alias("n"), F.avg(x).alias("mean_pos"), F.stddev_pop(x).alias("sd_pos"))


def doc_profile(lines: DataFrame) -> DataFrame:
    """Share of each doc in a token's occurrences."""
    per = tokens_of(lines).groupBy("token", "doc").agg(F.count("*").alias("n"))
    total = per.groupBy("token").agg(F.sum("n").alias("total"))
    return per.join(total, "token").select("token", "doc", "n", (F.col("n") / F.col("total")).alias("share"))


def successors(lines: DataFrame) -> DataFrame:
    """Each token's successors, most frequent first, joined by spaces."""
    s = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "b")))
    return bigram_counts(lines).groupBy("a").agg(F.array_join(F.transform(s, lambda x: x["b"]), " ").alias("successors"))


def document_frequency(lines: DataFrame, least: int = 2) -> DataFrame:
    """Tokens found in several docs."""
    once = tokens_of(lines).select("token", "doc").distinct()
    return once.groupBy("token").agg(F.count("*").alias("docs")).where(F.col("docs") >= least)


def vocabulary_split(lines: DataFrame) -> DataFrame:
    """How many token types occur once and how many more often."""
    return token_counts(lines).groupBy(F.when(F.col("n") <= 1, "C_RARE").otherwise("kept").alias("part")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))


def corpus_summary(lines: DataFrame) -> DataFrame:
    """Docs, lines, tokens, types and mean line length in one row."""
    a = lines.agg(F.count_distinct("doc").alias("docs"), F.count("*").alias("lines"), F.sum(F.size("tokens")).alias("tokens"))
    b = token_counts(lines).agg(F.count("*").alias("types"))
    return a.join(F.broadcast(b)).withColumn("mean_length", F.try_divide(F.col("tokens"), F.col("lines")))


def top_tokens(lines: DataFrame, k: int) -> DataFrame:
    """The k most frequent tokens of each doc; ties to the smaller token."""
    per = tokens_of(lines).groupBy("doc", "token").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc").orderBy(F.desc("n"), "token")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dominants(lines: DataFrame, k: int = 5) -> DataFrame:
    """The k tokens of each doc that cover most characters: count times length."""
    per = tokens_of(lines).groupBy("doc", "token").agg((F.count("*") * F.length("token")).alias("weight"))
    w = Window.partitionBy("doc").orderBy(F.desc("weight"), "token")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def most_common(lines: DataFrame, k: int) -> DataFrame:
    """The k most frequent tokens of the corpus with their share in percent."""
    total = token_counts(lines).agg(F.sum("n").alias("total"))
    return token_counts(lines).orderBy(F.desc("n"), "token").limit(k).join(F.broadcast(total)).select("token", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))
