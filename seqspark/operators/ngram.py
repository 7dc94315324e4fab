"""N-gram grammars: counts with padding, add-k probabilities, entropy, surprisal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.corpora import bigrams_of, stream_bigrams, stream_starts, tokens_of

BOS, EOS = "<BOS>", "<EOS>"


def padded(tokens: Column, n: int) -> Column:
    return F.concat(F.array_repeat(F.lit(BOS), n - 1), tokens, F.array(F.lit(EOS)))


def positions(lines: DataFrame, n: int) -> DataFrame:
    """doc, line, pos (from 0), ctx (array of n - 1 symbols), sym, for every symbol and the end of each line."""
    x = lines.withColumn("x", padded(F.col("tokens"), n))
    at = F.transform(F.sequence(F.lit(n), F.size("x")), lambda i: F.struct((i - n).alias("pos"), F.slice("x", i - (n - 1), n - 1).alias("ctx"), F.element_at("x", i).alias("sym")))
    return x.select("doc", "line", F.explode(at).alias("g")).select("doc", "line", "g.pos", "g.ctx", "g.sym")


def model(lines: DataFrame, n: int = 2) -> DataFrame:
    """ctx, sym, n: how often a symbol follows a context."""
    return positions(lines, n).groupBy("ctx", "sym").agg(F.count("*").alias("n"))


def alphabet_size(lines: DataFrame) -> DataFrame:
    """One row v: the number of distinct tokens, without padding symbols."""
    return tokens_of(lines).agg(F.count_distinct("token").alias("v"))


def smoothed(lines: DataFrame, n: int = 2, k: float = 0.5) -> DataFrame:
    """Add-k probability of every symbol of the alphabet and of the end after every seen context."""
    counts = model(lines, n)
    symbols = tokens_of(lines).select(F.col("token").alias("sym")).distinct().unionAll(lines.sparkSession.createDataFrame([(EOS,)], "sym string"))
    # contexts by targets is the size of the table that is asked for
    targets = symbols.agg(F.collect_set("sym").alias("symbols"), F.count("*").alias("targets"))
    totals = counts.groupBy("ctx").agg(F.sum("n").alias("total"))
    full = totals.join(F.broadcast(targets)).select("ctx", "total", "targets", F.explode("symbols").alias("sym"))
    own = F.coalesce("n", F.lit(0))
    p = (own + k) / (F.col("total") + k * F.col("targets"))
    return full.join(counts, ["ctx", "sym"], "left").select("ctx", "sym", own.alias("n"), p.alias("p"))


def conditional_entropy(lines: DataFrame, n: int = 2, k: float = 0.5) -> DataFrame:
    """Per context: its count and the entropy of what follows, in bits.

    Symbols that never follow a context share one probability, so their part of the
    entropy is a product and no table of contexts by symbols is made.
    """
    seen = F.col("n") + k
    sums = model(lines, n).groupBy("ctx").agg(F.sum("n").alias("total"), F.count("*").alias("types"), F.sum(seen).alias("mass"), F.sum(seen * F.log2(seen)).alias("s"))
    targets = alphabet_size(lines).select((F.col("v") + 1).alias("targets"))
    whole = F.col("total") + k * F.col("targets")
    rest = F.lit(k) / whole
    unseen = F.when(rest > 1e-12, (F.col("targets") - F.col("types")) * rest * F.log2(rest)).otherwise(0.0)
    h = (F.col("mass") * F.log2(whole) - F.col("s")) / whole - unseen
    return sums.join(F.broadcast(targets)).select("ctx", "total", h.alias("h"))


def weighted_entropy(lines: DataFrame, n: int = 2, k: float = 0.5) -> DataFrame:
    return conditional_entropy(lines, n, k).agg((F.sum(F.col("h") * F.col("total")) / F.sum("total")).alias("h"), F.count("*").alias("contexts"), F.sum("total").alias("positions"))


def surprisal(lines: DataFrame, n: int = 2, k: float = 0.5, training: DataFrame | None = None) -> DataFrame:
    """Per position: p, surprisal in bits, and whether the context and the transition were seen in training.

    An unseen context backs off to the uniform probability over symbols and the end.
    Contexts and their successors are joined as one table of bounded rows per context.
    """
    source = lines if training is None else training
    counts = model(source, n)
    totals = counts.groupBy("ctx").agg(F.sum("n").alias("total"))
    targets = alphabet_size(source).select((F.col("v") + 1).alias("targets"))
    at = positions(lines, n).join(totals, "ctx", "left").join(counts, ["ctx", "sym"], "left").join(F.broadcast(targets))
    seen = F.col("total").isNotNull()
    own = F.coalesce("n", F.lit(0))
    p = F.when(seen, F.try_divide(own + k, F.col("total") + k * F.col("targets"))).otherwise(1 / F.col("targets"))
    return at.select("doc", "line", "pos", "ctx", "sym", p.alias("p"), seen.alias("context_seen"), (own == 0).alias("zero_prob")).withColumn(
        "bits", F.when(F.col("p") > 0, -F.log2("p"))
    )


def surprisal_summary(positions_: DataFrame, *by: str) -> DataFrame:
    """Mean, maximum, perplexity and counts of unseen things per sequence."""
    return positions_.groupBy(*by).agg(
        F.count("*").alias("positions"),
        F.avg("bits").alias("mean_bits"),
        F.max("bits").alias("max_bits"),
        F.pow(F.lit(2.0), F.avg("bits")).alias("perplexity"),
        F.count_if("zero_prob").alias("zero_prob"),
        F.count_if(~F.col("context_seen")).alias("unseen_contexts"),
    )


def rare_transitions(lines: DataFrame, n: int = 2, most: int = 1) -> DataFrame:
    """Transitions seen so often at most, outside the beginning of lines."""
    return model(lines, n).where((F.col("n") <= most) & ~F.array_contains("ctx", BOS))


def zero_transitions(lines: DataFrame, n: int = 2) -> DataFrame:
    """Symbols of the alphabet that never follow a seen context."""
    return smoothed(lines, n, 1.0).where((F.col("n") == 0) & (F.col("sym") != EOS)).select("ctx", "sym")


def leave_one_doc_out(lines: DataFrame, alpha: float = 0.01, pieces: bool = False) -> DataFrame:
    """Per doc: surprisal under the model of all other docs and of all docs.

    pieces: the lines of a doc are pieces of one stream, in order, so that pairs run across them.

    The first token of a line is scored by its frequency, the others by their
    bigram.  The model of a fold is the whole count less the doc's own, so nothing
    is trained again: one grouping by doc and a join serve all folds.
    """
    pairs = (stream_bigrams(lines) if pieces else bigrams_of(lines)).groupBy("doc", "a", "b").agg(F.count("*").alias("own"))
    tokens = tokens_of(lines).groupBy("doc", "token").agg(F.count("*").alias("own"))
    starts = stream_starts(lines) if pieces else lines.where(F.size("tokens") > 0).select("doc", F.element_at("tokens", 1).alias("token"))
    firsts = starts.groupBy("doc", "token").agg(F.count("*").alias("times"))
    whole_b = pairs.groupBy("a", "b").agg(F.sum("own").alias("n"))
    whole_a = pairs.groupBy("a").agg(F.sum("own").alias("n_a"))
    own_a = pairs.groupBy("doc", "a").agg(F.sum("own").alias("own_a"))
    whole_t = tokens.groupBy("token").agg(F.sum("own").alias("n"), F.count("*").alias("docs"))
    size = whole_t.agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))
    # types of a fold: all, less those that only this doc has
    only = tokens.join(whole_t, "token").groupBy("doc").agg(F.sum("own").alias("own_tokens"), F.count_if(F.col("docs") == 1).alias("only_types"))
    fold = only.join(F.broadcast(size)).select("doc", (F.col("tokens") - F.col("own_tokens")).alias("n_fold"), (F.col("types") - F.col("only_types")).alias("v_fold"), F.col("tokens").alias("n_all"), F.col("types").alias("v_all"))

    def bits(c: Column, n: Column, v: Column) -> Column:
        return -F.log2((c + alpha) / (n + alpha * v))

    col = F.col
    second = (
        pairs.join(whole_b, ["a", "b"]).join(whole_a, "a").join(own_a, ["doc", "a"]).join(fold, "doc").select(
            "doc", col("own").alias("times"),
            bits(col("n") - col("own"), col("n_a") - col("own_a"), col("v_fold")).alias("loo"),
            bits(col("n"), col("n_a"), col("v_all")).alias("all"),
            (col("n") == col("own")).cast("long").alias("oov"),
        )
    )
    first = (
        firsts.join(whole_t, "token").join(tokens, ["doc", "token"]).join(fold, "doc").select(
            "doc", "times",
            bits(col("n") - col("own"), col("n_fold"), col("v_fold")).alias("loo"),
            bits(col("n"), col("n_all"), col("v_all")).alias("all"),
            F.lit(0).cast("long").alias("oov"),
        )
    )
    t = col("times")
    return second.unionAll(first).groupBy("doc").agg(
        F.sum(t).alias("n_tokens"),
        (F.sum(t * col("loo")) / F.sum(t)).alias("loo_bits"),
        (F.sum(t * col("all")) / F.sum(t)).alias("in_sample_bits"),
        F.sum(t * col("oov")).alias("n_oov"),
    ).withColumn("delta_bits", col("loo_bits") - col("in_sample_bits")).withColumn("frac_oov", col("n_oov") / col("n_tokens"))
