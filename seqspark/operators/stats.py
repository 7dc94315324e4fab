"""Association, significance, scores and stream statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut
from ..functions.scalars import runs_z, z_score
from ..sources.corpora import stream_bigrams, tokens_of
from .counts import bigram_counts, with_margins


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """scalars.log_gamma over numbers."""
    y = x + 8
    shift = x.copy()
    for i in range(1, 8):
        shift *= x + i
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def fisher_tails(n_ab: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """scalars.fisher_greater over numbers: a sum ends where all that is left of it is beyond the last bit of a double, so frequent pairs cost no more terms than the spread of their count."""
    x, a, b, n = (np.asarray(v, np.float64) for v in (n_ab, n_a, n_b, n))
    low, high, rest = np.maximum(0, a + b - n), np.minimum(a, b), n - a - b
    over = x * n >= a * b
    out = np.where(x <= low, 1.0, 0.0)
    at = np.flatnonzero((x > low) & (x <= high))
    a, b, n, rest, over = a[at], b[at], n[at], rest[at], over[at]
    k = np.where(over, x[at], x[at] - 1)
    last = np.where(over, high[at], low[at])
    choose = lambda m, j: _log_gamma(m + 1) - _log_gamma(j + 1) - _log_gamma(m - j + 1)
    t = np.exp(choose(a, k) + choose(n - a, b - k) - choose(n, b))
    s = t.copy()
    go = np.arange(len(at))
    while True:
        go = go[k[go] != last[go]]
        if not len(go):
            break
        j, up = k[go], over[go]
        ratio = np.where(up, (a[go] - j) * (b[go] - j) / ((j + 1) * (rest[go] + j + 1)), j * (rest[go] + j) / ((a[go] - j + 1) * (b[go] - j + 1)))
        # ratios fall on the way: the rest is below a geometric series
        more = (ratio >= 1) | (t[go] * ratio > (1 - ratio) * s[go] * 2.0**-60)
        go, ratio, up = go[more], ratio[more], up[more]
        t[go] *= ratio
        s[go] += t[go]
        k[go] += np.where(up, 1, -1)
    out[at] = np.where(over, np.minimum(1.0, s), np.maximum(0.0, 1 - s))
    return out


def with_fisher(margins: DataFrame) -> DataFrame:
    """Adds p_value, the one-sided Fisher p of n with margins n_a, n_b and total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = fisher_tails(*(batch.column(c).to_numpy() for c in ("n", "n_a", "n_b", "total")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "p_value"])

    return margins.mapInArrow(run, T.StructType([*margins.schema.fields, T.StructField("p_value", T.DoubleType())]))


def significance(lines: DataFrame, least: int = 3) -> DataFrame:
    """Lift, odds ratio and one-sided Fisher p of every bigram seen often enough."""
    t = with_fisher(with_margins(bigram_counts(lines)).where(F.col("n") >= least))
    n, a, b, total = (F.col(c) for c in ("n", "n_a", "n_b", "total"))
    rest = total - a - b + n
    return t.select(
        "a", "b", "n",
        (n / a).alias("p_b_given_a"),
        (b / total).alias("p_b"),
        ((n / a) / (b / total)).alias("lift"),
        F.try_divide(n * rest, (a - n) * (b - n)).alias("odds_ratio"),
        "p_value",
    )


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", order: list[str] | None = None, q: str = "q_value", parts: int = 64) -> DataFrame:
    """Step-up q-values: p * m / rank, made monotone from the largest p down; a null p has a null q.

    Equal p give equal q, so distinct p are ranked, by the last of their ranks.  They
    are counted once and dealt to ranges whose bounds are quantiles; ranks and minima
    run within a range, and two numbers per range, which pass the driver, carry them
    on.  Tests and distinct p are written, so that neither is made twice.
    """
    tests = cut(tests)
    per = cut(tests.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("n_")))
    bounds = sorted(set(per.approxQuantile(p, [i / parts for i in range(1, parts)], 0.001)))
    part = F.aggregate(F.array(*(F.lit(float(b)) for b in bounds)), F.lit(0), lambda n, b: n + (F.col(p) > b).cast("int")) if bounds else F.lit(0)
    ranged = per.withColumn("part_", part)
    at = lambda values: F.array(*(F.lit(float(v)) for v in values))[F.col("part_")]
    sizes = {r.part_: r.n for r in ranged.groupBy("part_").agg(F.sum("n_").alias("n")).collect()}
    before, m = [0], sum(sizes.values())
    for k in range(len(bounds)):
        before.append(before[-1] + sizes.get(k, 0))
    rank = at(before) + F.sum("n_").over(Window.partitionBy("part_").orderBy(p))
    ranked = ranged.withColumn("raw_", F.col(p) * m / rank)
    least = {r.part_: r.least for r in ranked.groupBy("part_").agg(F.min("raw_").alias("least")).collect()}
    above = [1.0]
    for k in range(len(bounds), 0, -1):
        above.insert(0, min(above[0], least.get(k, 1.0)))
    down = F.min("raw_").over(Window.partitionBy("part_").orderBy(F.desc(p)))
    found = ranked.select(p, F.least(F.lit(1.0), at(above), down).alias(q))
    return tests.join(found, p, "left").select(*tests.columns, q)


def ppmi(lines: DataFrame, side: str = "succ", alpha: float = 0.75) -> DataFrame:
    """Positive pointwise mutual information with context smoothing, for successors or predecessors."""
    counts = with_margins(bigram_counts(lines))
    own, other = ("n_a", "n_b") if side == "succ" else ("n_b", "n_a")
    margin = bigram_counts(lines).groupBy("b" if side == "succ" else "a").agg(F.sum("n").alias("m"))
    z = margin.agg(F.sum(F.pow(F.col("m").cast("double"), F.lit(alpha))).alias("z"))
    p = F.col("n") / F.col("total")
    q = (F.col(own) / F.col("total")) * (F.pow(F.col(other).cast("double"), F.lit(alpha)) / F.col("z"))
    return counts.join(F.broadcast(z)).select("a", "b", F.greatest(F.lit(0.0), F.log2(p / q)).alias("ppmi"))


def z_global(df: DataFrame, column: str, out: str, flat: str = "zero") -> DataFrame:
    """Population z-score over the whole table, from a one-row aggregate; flat: 'zero' or 'centred' without spread."""
    s = df.agg(F.avg(column).alias("mean_"), F.stddev_pop(column).alias("sd_"))
    c = F.col(column)
    z = z_score(c, F.col("mean_"), F.col("sd_"), c - F.col("mean_") if flat == "centred" else 0.0)
    return df.join(F.broadcast(s)).withColumn(out, z).drop("mean_", "sd_")


def h_global(pairs: DataFrame, *by: str) -> DataFrame:
    """Entropy of the next token given the current one, from bigrams (a, b), per group."""
    return h_of_counts(pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("n")), *by)


def h_of_counts(n_ab: DataFrame, *by: str) -> DataFrame:
    """The same from counted bigrams (a, b, n), each once in a group."""
    n_a = n_ab.groupBy(*by, "a").agg(F.sum("n").alias("n_a"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    # sum over a of n_a log2 n_a - sum of n log2 n, over N
    h = (F.sum(F.col("n_a") * F.log2("n_a")) - F.sum("s")) / F.sum("n_a")
    return n_a.groupBy(*by).agg(h.alias("h"), F.sum("n_a").alias("bigrams"))


def index_of_coincidence(tokens: DataFrame, *by: str) -> DataFrame:
    """IC, its ratio to the uniform one, per stream; null for streams under 10 tokens."""
    f = tokens.groupBy(*by, "token").agg(F.count("*").alias("f"))
    s = f.groupBy(*by).agg(F.sum("f").alias("n"), F.count("*").alias("types"), F.sum(F.col("f") * (F.col("f") - 1)).alias("s"), F.max_by("token", F.struct("f", "token")).alias("top_token"), F.max("f").alias("top"))
    ic = F.when(F.col("n") >= 10, F.col("s") / (F.col("n") * (F.col("n") - 1)))
    return s.select(*by, "n", "types", ic.alias("ic"), (ic * F.col("types")).alias("ic_norm"), (1 / F.col("types")).alias("ic_uniform"), "top_token", (100.0 * F.col("top") / F.col("n")).alias("top_pct"))


def repeated_gram_distances(lines: DataFrame, n: int = 3) -> DataFrame:
    """Kasiski: distances between successive places of an n-gram within a line, above 1."""
    grams = F.transform(F.sequence(F.lit(1), F.size("tokens") - (n - 1)), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("tokens", i, n), " ").alias("gram")))
    g = lines.where(F.size("tokens") >= n).select("doc", "line", F.explode(grams).alias("g")).select("doc", "line", "g.pos", "g.gram")
    w = Window.partitionBy("doc", "line", "gram").orderBy("pos")
    return g.withColumn("d", F.col("pos") - F.lag("pos").over(w)).where(F.col("d") > 1)


def factor_histogram(distances: DataFrame, low: int = 2, high: int = 10) -> DataFrame:
    """How many distances each factor divides."""
    per = distances.groupBy("d").agg(F.count("*").alias("n"))
    return per.withColumn("factor", F.explode(F.sequence(F.lit(low), F.lit(high)))).where(F.col("d") % F.col("factor") == 0).groupBy("factor").agg(F.sum("n").alias("n"))


def common_divisor(distances: DataFrame, *by: str) -> DataFrame:
    """Greatest common divisor of the distances per group, by Euclid's steps over the distinct ones."""
    step = lambda acc, x: F.aggregate(
        F.sequence(F.lit(1), F.lit(48)),
        F.struct(acc.alias("x"), x.alias("y")),
        lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, s["y"]).otherwise(s["x"] % s["y"]).alias("y")),
        lambda s: s["x"],
    )
    sets = distances.groupBy(*by).agg(F.count("*").alias("repeats"), F.collect_set(F.col("d").cast("long")).alias("ds"))
    return sets.select(*by, "repeats", F.aggregate("ds", F.lit(0).cast("long"), step).alias("gcd"))


def _runs_label(z: Column) -> Column:
    return F.when(z.isNull(), "untestable").when(z < -3, "clustered").when(z > 3, "alternating").otherwise("random")


def runs_test(lines: DataFrame, zero_token: str, least: int = 20) -> DataFrame:
    """Wald-Wolfowitz test per line: is zero_token against all others dealt at random?"""
    t = F.transform("tokens", lambda x: F.when(x == zero_token, 0).otherwise(1))
    n1 = F.aggregate("t", F.lit(0), lambda acc, x: acc + x)
    change = F.aggregate(F.zip_with(F.slice("t", F.lit(1), F.col("n") - 1), F.slice("t", F.lit(2), F.col("n") - 1), lambda x, y: (x != y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    z = runs_z(F.col("n0").cast("double"), F.col("n1").cast("double"), F.col("runs"))
    return (
        lines.select("doc", "line", t.alias("t"), F.size("tokens").alias("n"))
        .where(F.col("n") >= least)
        .withColumn("n1", n1)
        .withColumn("n0", F.col("n") - F.col("n1"))
        .withColumn("runs", change + 1)
        .withColumn("z", z)
        .select("doc", "line", "n", "n0", "n1", "runs", "z", _runs_label(F.col("z")).alias("label"))
    )


def stream_runs_test(pieces: DataFrame, zero_token: str, least: int = 20) -> DataFrame:
    """runs_test() of each doc's stream given in ordered pieces (doc, line, tokens): counts of tokens and of adjacent pairs that differ."""
    is_zero = lambda c: F.col(c) == zero_token
    sizes = tokens_of(pieces).groupBy("doc").agg(F.count("*").alias("n"), F.count_if(is_zero("token")).alias("n0")).where(F.col("n") >= least)
    changes = stream_bigrams(pieces).groupBy("doc").agg(F.count_if(is_zero("a") != is_zero("b")).alias("changes"))
    t = sizes.join(changes, "doc", "left").select("doc", F.col("doc").alias("line"), "n", "n0", (F.col("n") - F.col("n0")).alias("n1"), (F.coalesce("changes", F.lit(0)) + 1).alias("runs"))
    return t.withColumn("z", runs_z(F.col("n0").cast("double"), F.col("n1").cast("double"), F.col("runs"))).withColumn("label", _runs_label(F.col("z")))


def percentile_values(df: DataFrame, column: str, shares: list[float], bins: int = 1024) -> list[float | None]:
    """Exact percentiles with linear interpolation of the finite values of a column; None without any.

    Selection by histograms: the range of values that holds a wanted rank is cut into
    bins, and the bin that holds it is the next range, from its least to its largest
    value, until that is one value.  A round is one pass for all ranks; the driver gets
    `bins` rows a range.  df should be a table or written: it is read every round.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where(F.abs("x") < float("inf"))
    n, low, high = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    ranks = {int(r) for p in places for r in (p // 1, -(-p // 1))}
    found: dict[int, float] = {}
    ranges = [(low, high, 0, ranks)]  # least, largest, values before it, ranks in it
    while ranges:
        found.update((r, lo) for lo, hi, _, rs in ranges if lo == hi for r in rs)
        ranges = [t for t in ranges if t[0] < t[1]]
        if not ranges:
            break
        of = F.lit(None).cast("int")
        at = F.lit(None).cast("double")
        for k, (lo, hi, _, _) in enumerate(ranges):
            inside = F.col("x").between(lo, hi)
            of = F.when(inside, k).otherwise(of)
            # halves, so that the width of a range does not overflow
            at = F.when(inside, (F.col("x") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2) * bins).otherwise(at)
        part = x.select("x", of.alias("range"), F.least(F.floor(at), F.lit(bins - 1)).alias("bin")).where("range IS NOT NULL")
        held = sorted(map(tuple, part.groupBy("range", "bin").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()))
        nxt = []
        for k, (_, _, before, rs) in enumerate(ranges):
            for _, _, m, lo, hi in (h for h in held if h[0] == k):
                own = {r for r in rs if before <= r < before + m}
                if own:
                    nxt.append((lo, hi, before, own))
                before += m
        ranges = nxt
    out = []
    for p in places:
        lo, hi = int(p // 1), int(-(-p // 1))
        a, b = found[lo], found[hi]
        out.append(a if lo == hi or a == b else (hi - p) * a + (p - lo) * b)
    return out


def percentiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation in one row, a column each."""
    values = percentile_values(df, column, list(shares.values()))
    return df.sparkSession.range(1).select(*(F.lit(v).cast("double").alias(name) for name, v in zip(shares, values, strict=True)))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, lower triangle, in one pass."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[:i]]
    one = df.agg(*(F.corr(x, y).alias(f"r{i}") for i, (x, y) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"r{i}").alias("r")) for i, (x, y) in enumerate(pairs)))).alias("p")).select("p.*")


def text_metrics(docs: DataFrame, key: str, text: Column, window: int = 5) -> DataFrame:
    """Per text: 1 / distinct chars, bigrams and trigrams; share of repeated windows; character entropy; white space does not count.

    A measure of n-grams is 0 for texts that hold none.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    # from an array of characters: places in a string are found by walking it
    grams = lambda k: F.when(
        F.size("c") >= k, F.transform(F.sequence(F.lit(1), F.size("c") - (k - 1)), lambda i: F.concat(*(F.element_at("c", (i + j).cast("int")) for j in range(k))))
    ).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(key), F.filter(F.split(t, ""), lambda x: x != "").alias("c"))
    g = {k: grams(k) for k in (1, 2, 3, window)}
    out = rows.select(key, *(F.size(F.array_distinct(g[k])).alias(f"d{k}") for k in g), F.greatest(F.size("c") - (window - 1), F.lit(0)).alias("w"))
    chars = rows.select(key, F.explode("c").alias("c")).groupBy(key, "c").agg(F.count("*").alias("n"))
    h = chars.groupBy(key).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("m8"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return out.join(h, key, "left").select(
        key,
        *(zero(F.try_divide(F.lit(1.0), F.col(f"d{k}"))).alias(f"m{k}") for k in (1, 2, 3)),
        zero(1 - F.try_divide(F.col(f"d{window}"), F.col("w"))).alias("m5"),
        zero(F.col("m8")).alias("m8"),
    )


def palindromic_share(lines: DataFrame, doc: str, text: str) -> DataFrame:
    """m6: the share of a doc's lines that read the same backwards."""
    return lines.groupBy(doc).agg(F.count("*").alias("lines"), (F.count_if(F.col(text) == F.reverse(text)) / F.count("*")).alias("m6"))


def compression_ratio(docs: DataFrame, key: str, text: str) -> DataFrame:
    """zlib-compressed over raw bytes; Spark has no such function, so batches go through Arrow."""
    import pyarrow as pa

    def run(batches):
        import zlib

        for b in batches:
            raw = [None if x is None else x.encode() for x in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([len(zlib.compress(x)) / len(x) if x else None for x in raw], pa.float64())], names=[key, "ratio"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ratio double")


