"""Published results, restated as small extracts: neither the SQL nor the operators were made from them."""

import pytest
from pyspark.sql import functions as F
from seqspark.functions.scalars import fisher_greater
from seqspark.operators import ngram, segments

# Counts of a grammar over 11 sequences of 656 symbols, and the entropies in bits that follow with k = 0.5 (fixed values).
COUNTS = {
    "<BOS>": {"V1": 6, "V0": 4, "V2": 1},
    "V1": {"V0": 102, "V1": 210, "<EOS>": 7, "V2": 8},
    "V0": {"V1": 103, "V0": 193, "<EOS>": 3, "V2": 3},
    "V2": {"V1": 8, "V0": 3, "V2": 15, "<EOS>": 1},
}
ENTROPY = {"<BOS>": 1.5701, "V1": 1.197, "V0": 1.0924, "V2": 1.5912}
# n, occurrences of the first and of the second token, bigrams in all; lift, odds ratio, p (fixed values).
PAIRS = [(3, 7, 500, 45116, 38.6709, 67.3219, 4.581e-05), (48, 210, 1151, 45116, 8.9594, 11.7667, 0.0), (24, 361, 36817, 45116, 0.0815, 0.0154, 1.0)]
# Lines that are convergent, grammatical, lexical; verdict (fixed values).
VERDICTS = [(8, 0, 4, "CONVERGENCIA"), (0, 0, 2, "PERFIL_LEXIC"), (0, 1, 1, "MIXT"), (0, 5, 0, "PERFIL_GRAMATICAL"), (0, 0, 0, "SENSE_SENYAL")]


def sequences(counts):
    """Sequences with these transitions: one closed walk, its ends joined, cut at the ends."""
    left = {a: [b for b, n in bs.items() for _ in range(n)] for a, bs in counts.items()} | {"<EOS>": ["<BOS>"] * sum(counts["<BOS>"].values())}
    stack, walk = ["<BOS>"], []
    while stack:
        if left[stack[-1]]:
            stack.append(left[stack[-1]].pop())
        else:
            walk.append(stack.pop())
    text = " ".join(reversed(walk))
    return [s.split() for s in text.replace("<BOS>", "").split("<EOS>") if s.strip()]


def test_entropies(spark):
    found = sequences(COUNTS)
    assert len(found) == 11 and sum(map(len, found)) == 656
    lines = spark.createDataFrame([(i, 0, s) for i, s in enumerate(found)], "doc int, line int, tokens array<string>")
    got = {r.ctx[0]: r.h for r in ngram.conditional_entropy(lines).collect()}
    assert {k: round(v, 4) for k, v in got.items()} == ENTROPY
    row = ngram.weighted_entropy(lines).first()
    assert (round(row.h, 4), row.contexts, row.positions) == (1.1717, 4, 667)
    p = {(r.ctx[0], r.sym): r.p for r in ngram.smoothed(lines).collect()}
    assert p["<BOS>", "V1"] == pytest.approx(6.5 / 13) and p["V2", "<EOS>"] == pytest.approx(1.5 / 29)
    assert sum(v for (c, _), v in p.items() if c == "V0") == pytest.approx(1)
    # dense and closed forms agree, with symbols that never follow a context
    odd = spark.createDataFrame([(0, 0, list("abca")), (0, 1, list("ddd")), (1, 0, ["e"])], "doc int, line int, tokens array<string>")
    dense = ngram.smoothed(odd, 2, 0.5).groupBy("ctx").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    assert {tuple(r.ctx): round(r.h, 9) for r in dense.collect()} == {tuple(r.ctx): round(r.h, 9) for r in ngram.conditional_entropy(odd).collect()}


def test_significance(spark):
    rows = spark.createDataFrame(PAIRS, "n long, a long, b long, total long, lift double, odds double, p double")
    n, a, b, total = (F.col(c) for c in ("n", "a", "b", "total"))
    got = rows.select("*", fisher_greater(n, a, b, total).alias("fisher")).collect()
    for r in got:
        assert round((r.n / r.a) / (r.b / r.total), 4) == r.lift
        assert round(r.n * (r.total - r.a - r.b + r.n) / ((r.a - r.n) * (r.b - r.n)), 4) == r.odds
        assert r.fisher == pytest.approx(r.p, abs=5e-9)


def test_verdicts(spark):
    rows = spark.createDataFrame(VERDICTS, "c long, g long, l long, verdict string")
    got = rows.select("verdict", segments.verdict(F.col("c"), F.col("g"), F.col("l")).alias("found")).collect()
    assert all(r.verdict == r.found for r in got)
