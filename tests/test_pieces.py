"""Scans of groups that go over many pieces, and exact percentiles, against plain loops."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from seqspark.operators import ordinals, segments, stats


def events(spark, n=4000, seed=1):
    """One group with nine tenths of the rows, small ones, and rows without a group; in 16 partitions."""
    rng = random.Random(seed)
    rows = [(None if k % 97 == 0 else "hot" if rng.random() < 0.9 else f"g{rng.randrange(40)}", k, rng.random() < 0.7, round(rng.gauss(0, 1), 3)) for k in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, t int, f boolean, x double").repartition(16)


@pytest.fixture(params=[16, 1])
def partitions(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def groups(rows):
    by = defaultdict(list)
    for g, t, f, x in sorted(rows, key=lambda r: r[1]):
        by[g].append((t, f, x))
    return by


def test_a_hot_group_is_many_pieces(spark, partitions):
    rows, df = events(spark)
    placed, spans = ordinals.in_pieces(df, ["g"], ["t"])
    got = placed.collect()
    expected = {(g, t): i for g, xs in groups(rows).items() for i, (t, _, _) in enumerate(xs)}
    assert {(r.g, r.t): r.i for r in got} == expected and len(got) == len(rows)
    hot = {r.piece_ for r in got if r.g == "hot"}
    assert len(hot) >= 10 if partitions == 16 else len(hot) == 1
    assert spans.count() <= 2 * 16


def test_runs_over_pieces(spark, partitions):
    for seed in (1, 2):
        rows, df = events(spark, 3000, seed)
        expected = set()
        for g, xs in groups(rows).items():
            i = 0
            while i < len(xs):
                j = i
                while j < len(xs) and xs[j][1]:
                    j += 1
                if j - i >= 2:
                    expected.add((g, i, j - 1, j - i))
                i = max(j, i + 1)
        assert {tuple(r) for r in segments.maximal_runs(df, ["g"], ["t"], F.col("f"), 2).collect()} == expected
    every = df.withColumn("f", F.lit(True))
    assert {(r.g, r.length) for r in segments.maximal_runs(every, ["g"], ["t"], F.col("f"), 1).collect()} == {(g, len(xs)) for g, xs in groups(rows).items()}


def test_islands_over_pieces(spark, partitions):
    rows, df = events(spark)
    for gap, keep in ((1, 3), (2, 1), (10_000, 1)):
        expected = set()
        for g, xs in groups(rows).items():
            part = [xs[0][0]]
            for t, _, _ in [*xs[1:], (10**9, 0, 0)]:
                if t - part[-1] > gap:
                    if len(part) >= keep:
                        expected.add((g, part[0], part[-1], len(part)))
                    part = []
                part.append(t)
        assert {tuple(r) for r in segments.gap_islands(df, ["g"], "t", gap, keep).collect()} == expected


def test_windows_over_pieces(spark, partitions):
    rows, df = events(spark)
    for length in (1, 5, 700):
        got = {r.g: r.max_mean for r in segments.max_window_mean(df, ["g"], ["t"], "x", length).collect()}
        for g, xs in groups(rows).items():
            x = np.array([x for _, _, x in xs])
            best = max((x[i : i + length].mean() for i in range(len(x) - length + 1)), default=None)
            assert got[g] == (None if best is None else pytest.approx(best))


def test_percentile_values(spark):
    rng = np.random.default_rng(3)
    columns = {
        "normal": rng.normal(size=3000), "ties": rng.integers(0, 4, 3000) * 1.0, "one": np.full(50, 7.0), "wide": np.concatenate([10.0 ** rng.integers(-300, 300, 500), -(10.0 ** rng.integers(-300, 300, 500))]),
        "ends": np.array([-1.7e308, 0.0, 1.7e308]), "two": np.array([1.0, 2.0]),
    }
    shares = [0.0, 0.025, 0.5, 0.6, 0.975, 1.0]
    for name, x in columns.items():
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(5)
        got = stats.percentile_values(df, "x", shares, bins=16)
        order = np.sort(x)
        for s, v in zip(shares, got, strict=True):
            p = s * (len(x) - 1)
            lo, hi = order[int(np.floor(p))], order[int(np.ceil(p))]
            assert v == pytest.approx(lo if lo == hi else lo * (np.ceil(p) - p) + hi * (p - np.floor(p)), rel=1e-12, abs=0), (name, s)
    assert stats.percentile_values(df.where("false"), "x", [0.5]) == [None]
    assert stats.percentiles(df, "x", {"a": 0.5, "b": 1.0}).collect()[0].asDict() == {"a": 1.5, "b": 2.0}


def test_pieces_are_numbered_by_more_tasks_in_larger_tables(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 3000)) for _ in range(900)]
    df = spark.createDataFrame(rows, "g int, t int").repartition(3)
    own = sorted(map(tuple, segments.gap_islands(df, ["g"], "t", 2).collect()))
    monkeypatch.setattr(ordinals, "ROWS", 40)
    assert ordinals.in_pieces(df, ["g"], ["t"])[0].rdd.getNumPartitions() >= 900 // 40
    assert sorted(map(tuple, segments.gap_islands(df, ["g"], "t", 2).collect())) == own and len(own) > 20
