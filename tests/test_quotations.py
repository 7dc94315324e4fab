import random

import pytest
from seqspark.operators import parse, quotations
from seqspark.queries import QUERIES


def brute(lines, quotes, part_over, least):
    out = []
    for k, x in lines:
        for i, y in quotes:
            if x is None or y is None or len(x) < least:
                continue
            if x == y:
                out.append((k, i, "IDENTICA"))
            elif len(y) > part_over and (y in x or x in y):
                out.append((k, i, "SUBCADENA"))
    return sorted(out, key=str)


def matches(spark, lines, quotes, part_over, least, block):
    df = spark.createDataFrame([(k, x) for k, x in lines], "k long, text string").repartition(3)
    q = spark.createDataFrame(quotes, "i long, quote string")
    return quotations.quotation_matches(df, q, part_over, least, block)


@pytest.mark.parametrize("part_over, least, block", [(15, 1, 40), (-1, 1, 1_000_000), (3, 0, 1)])
def test_planted_quotations(spark, monkeypatch, part_over, least, block):
    """Quotations planted whole, in part and with a change; repeated, nested, null, empty and long ones."""
    if block == 40:
        monkeypatch.setattr(quotations, "BROADCAST_KEYS", 0)
    rng = random.Random(block)
    word = lambda n: "".join(rng.choices("ab", k=n))
    quotes = [(i, word(rng.randint(1, 45))) for i in range(40)] + [(50, "a" * 60), (51, "a" * 60), (52, "a" * 30), (53, None), (54, "b"), (55, "é日" * 12)]
    lines = [(1000, None), (1001, ""), (1002, "a" * 3000), (1003, "xé日" + "é日" * 12), (1004, "é日" * 3)]
    for k in range(150):
        q = rng.choice(quotes)[1] or "b"
        lo = rng.randint(0, len(q) - 1)
        lines.append((k, rng.choice([q, word(3) + q + word(2), q[lo : lo + rng.randint(1, 30)], word(rng.randint(1, 20)), q[:-1] + "x"])))
    got = matches(spark, lines, quotes, part_over, least, block)
    assert got.columns == ["quote", "k", "text", "i", "kind"]
    expected = brute(lines, quotes, part_over, least)
    assert sorted(((r.k, r.i, r.kind) for r in got.collect()), key=str) == expected and len(expected) > 300


def test_no_pair_is_compared_without_a_key(spark, monkeypatch):
    for most in (0, 2_000_000):
        monkeypatch.setattr(quotations, "BROADCAST_KEYS", most)
        got = matches(spark, [(1, "x" * 20)], [(1, "y" * 20)], 15, 1, 1000)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.collect() == []
    assert matches(spark, [], [(1, "y" * 20)], 15, 1, 1000).collect() == matches(spark, [(1, "y")], [], 15, 1, 1000).collect() == []


def test_normalized_instruction(spark):
    rows = [("12.- (la-2V) X.)", "-(la-2v)x)"), (" 3-a. B", "a.b"), ("7 . c", "c"), (None, None), ("12", "12")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "a string")
    assert [r[0] for r in df.select(parse.normalized_instruction(df.a)).collect()] == [b for _, b in rows]


def test_quotation_query_finds_some(spark):
    kinds = [r.kind for r in QUERIES["quotation_match"](spark, "/root/testdata/sf0.01").collect()]
    assert len(kinds) > 200 and set(kinds) == {"SUBCADENA"}
