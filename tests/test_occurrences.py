import random
from collections import Counter, defaultdict

from seqspark.operators import occurrences, patterns


def brute(lines, given):
    """Occurrences from the left end that do not overlap, by comparing slices."""
    out = Counter()
    for doc, tokens in lines:
        tokens = [t for t in tokens or [] if t is not None]
        for p in {tuple(p) for p in given if p}:
            i = 0
            while i + len(p) <= len(tokens):
                if tuple(tokens[i : i + len(p)]) == p:
                    out[doc, " ".join(p)] += 1
                    i += len(p)
                else:
                    i += 1
    return dict(out)


def frames(spark, lines, given):
    return spark.createDataFrame(lines, "doc string, tokens array<string>").repartition(3), spark.createDataFrame([(p,) for p in given], "pattern array<string>")


def test_counts_of_patterns_of_any_length(spark, monkeypatch):
    rng = random.Random(2)
    long = [rng.choice("xyz") for _ in range(1000)]
    lines = [(rng.choice("de"), [rng.choice(["a", "b", "ab"]) for _ in range(rng.randint(0, 40))]) for _ in range(80)]
    lines += [("d", long), ("e", [*long, "q", *long]), ("f", ["a"] * 3001), (None, ["a", "b"]), ("g", None), ("g", ["a", None, "b"])] + [("d", ["ab", "a", "b"])] * 3
    given = [[rng.choice(["a", "b", "ab"]) for _ in range(rng.randint(1, 6))] for _ in range(60)] + [long, long[:500], ["a"] * 1000, ["a", "a"], ["ab"], [], ["nowhere"]]
    expected = brute(lines, given)
    assert expected["e", " ".join(long)] == 2 and expected["f", " ".join(["a"] * 1000)] == 3
    for block, held in ((1_000_000, 200_000), (300, 5)):
        monkeypatch.setattr(occurrences, "HELD", held)
        rows = occurrences.pattern_counts(*frames(spark, lines, given), block).collect()
        assert {(r.doc, r.pattern): r.n for r in rows} == expected and len(rows) == len(expected)


def test_nothing_to_count(spark):
    assert occurrences.pattern_counts(*frames(spark, [("d", ["a"])], [])).collect() == []
    assert occurrences.pattern_counts(*frames(spark, [], [["a"]])).collect() == []


def test_shared_patterns_of_covers_are_counted_everywhere(spark):
    rng = random.Random(9)
    rows = [(f"d{k % 5}", k, [rng.choice("abcd") for _ in range(rng.randint(1, 12))]) for k in range(60)]
    df = spark.createDataFrame(rows, "doc string, line int, tokens array<string>").repartition(4)
    covers = defaultdict(set)
    for doc in sorted({r[0] for r in rows}):
        for p, *_ in patterns.cover_of_lines([t for d, _, t in rows if d == doc], 1000):
            covers[p].add(doc)
    shared = [p.split(" ") for p, docs in covers.items() if len(docs) >= 2]
    got = occurrences.pattern_counts(df, occurrences.shared_patterns_of_docs(df))
    assert {(r.doc, r.pattern): r.n for r in got.collect()} == brute([(d, t) for d, _, t in rows], shared) and len(shared) > 10


def test_containment_of_long_patterns(spark):
    rng = random.Random(11)
    long = [rng.choice(["x", "y", "xy"]) for _ in range(500)]
    given = [long, long[100:480], long[480:], ["x"], ["nowhere", "x"], [*long[:50], "q"]] + [[rng.choice(["x", "y", "xy"]) for _ in range(rng.randint(1, 7))] for _ in range(60)]
    given = sorted({tuple(p) for p in given})
    df = spark.createDataFrame([(" ".join(p),) for p in [*given, given[0]]], "pattern string").repartition(3)
    inside = lambda c, p: len(c) < len(p) and any(p[i : i + len(c)] == c for i in range(len(p) - len(c) + 1))
    got = patterns.containment(df).collect()
    assert {(r.parent, r.child) for r in got} == {(" ".join(p), " ".join(c)) for p in given for c in given if inside(c, p)}
    assert len(got) == len(set(got)) > 300
    assert patterns.containment(df.where("false")).collect() == []
