import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from seqspark.operators import cluster, hypotheses, ordinals, patterns, stability, stats


def test_q_values_with_ties_against_the_plain_rule(spark):
    rng = random.Random(3)
    ps = [round(rng.random() ** 3, 2) for _ in range(400)] + [1.0] * 200 + [0.0] * 5 + [None] * 3
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p_value double")
    got = {r.i: r.q_value for r in stats.benjamini_hochberg(df, parts=7).collect()}
    order = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    want, least = {}, 1.0
    for rank in range(len(order), 0, -1):
        p, i = order[rank - 1]
        least = min(least, p * len(order) / rank)
        want[i] = least
    assert len(got) == len(ps) and all(got[i] == pytest.approx(q) for i, q in want.items()) and all(got[i] is None for i, p in enumerate(ps) if p is None)
    assert stats.benjamini_hochberg(df.where("false")).collect() == []


def plain_cover(lines):
    """The published rule, word for word: every sequence of every line, long ones first, first seen first."""
    seen = {}
    for k, line in enumerate(lines):
        for size in range(2, len(line) + 1):
            for i in range(len(line) - size + 1):
                seen.setdefault(tuple(line[i : i + size]), []).append((k, i))
    covered, out = set(), []
    for seq, at in sorted(((s, a) for s, a in seen.items() if len(a) >= 2), key=lambda x: -len(x[0])):
        own = [{(k, j) for j in range(i, i + len(seq))} for k, i in at]
        free = sum(not o <= covered for o in own)
        if free:
            out.append((" ".join(seq), len(at), free, len(set().union(*own) - covered)))
            covered |= set().union(*own)
    return out


def test_patterns_of_a_doc_against_the_plain_rule(spark):
    assert patterns.greedy_cover(["a", "a", "a"]) == [("a a", 2, 3)]
    rng = random.Random(8)
    rows = []
    for doc in range(40):
        lines = [[rng.choice("abc"[: 1 + doc % 3]) for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(1, 6))]
        assert Counter(patterns.cover_of_lines(lines)) == Counter(plain_cover(lines)), lines
        rows += [(doc, k, line) for k, line in enumerate(lines)]
    rng.shuffle(rows)
    got = patterns.doc_patterns(spark.createDataFrame(rows, "doc int, line int, tokens array<string>").repartition(3)).collect()
    by = {d: [t for _, k, t in sorted((r for r in rows if r[0] == d), key=lambda r: r[1])] for d in range(40)}
    assert Counter(map(tuple, got)) == Counter((d, *x) for d, lines in by.items() for x in plain_cover(lines))


def test_depths_with_and_without_a_bound(spark, tmp_path):
    edges = spark.createDataFrame([("a b c", "a b"), ("a b", "a"), ("a b c", "b"), ("x", "y")], "parent string, child string")
    nodes = spark.createDataFrame([(n,) for n in ("a b c", "a b", "a", "b", "x", "y", "z")], "pattern string")
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    want = {"a b c": 0, "a b": 1, "a": 2, "b": 1, "x": 0, "y": 1, "z": 0}
    for layers in (2, None):
        assert {r.node: r.depth for r in patterns.depths(edges, nodes, layers).collect()} == want


def test_stream_ordinals_and_zip(spark):
    rng = random.Random(1)
    rows = [(rng.choice([3, 5, 5, 5, 900, -2, 10**12]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc long, line int").repartition(4)
    got = {(r.doc, r.line): r.ordinal for r in ordinals.stream_ordinals(df, "doc", "line", parts=3).collect()}
    assert got == {r: i for i, r in enumerate(sorted(rows))}
    lines = spark.createDataFrame([(1, 7), (1, 3), (2, 1)], "doc int, line int")
    sequences = spark.createDataFrame([(1, ["x", "y", "<EOS>"]), (2, ["z", "<EOS>"])], "doc int, items array<string>")
    assert sorted(map(tuple, ordinals.zipped(sequences, "items", lines).collect()), key=str) == [(1, 0, "x", 3), (1, 1, "y", 7), (1, 2, "<EOS>", None), (2, 0, "z", 1), (2, 1, "<EOS>", None)]


def test_morse_scores_take_the_better_polarity(spark):
    # a = dot, g = dash: -.. . / .-.. .- reads DELA
    text = "gaa a agaa ag " * 20
    row = hypotheses.morse_scores(spark.createDataFrame([(1, text), (2, "a g"), (3, None)], "k int, t string"), "k", "t", "lga", ["DE", "LA", "EL"], ["DEL"]).where("a = 'g' AND b = 'a'").collect()
    assert len(row) == 1
    r = row[0]
    assert (r.k, r.groups, r.n1, r.n2, r.dot, r.reading[:8]) == (1, 80, 60, 140, "a", "DELADELA")
    clean = "DELA" * 20
    bi, tri = [clean[i : i + 2] for i in range(79)], [clean[i : i + 3] for i in range(78)]
    assert r.score == pytest.approx((sum(b in ("DE", "LA", "EL") for b in bi) + 3 * sum(t == "DEL" for t in tri)) / (79 + 3 * 78))
    assert 0 < r.control < r.score and r.z > 2


def planted(spark, mixed):
    """Lines of words from two groups that follow each other in fixed ways, or at random."""
    rng, rows = random.Random(4), []
    for i in range(300):
        out = []
        for _ in range(8):
            out += [rng.choice(["a1", "a2", "a3", "a4"]), rng.choice(["bb1", "bb2", "bb3", "bb4"])]
        if mixed:
            rng.shuffle(out)
            out = [rng.choice(["a1", "a2", "a3", "a4", "b1", "b2", "b3", "b4"]) for _ in out]
        rows.append((i % 5, i, out))
    return spark.createDataFrame(rows, "doc int, line int, tokens array<string>").repartition(3)


def test_stability_tells_classes_from_chance(spark):
    clear = planted(spark, False)
    labels = stability.original_classes(clear, range(2, 5))
    groups = {}
    for r in labels.collect():
        groups.setdefault(r.label, set()).add(r.token[0])
    assert sorted(map(sorted, groups.values())) == [["a"], ["b"]]
    row = stability.stability(stability.agreement(clear, labels, 30)).first()
    assert row.replicates == 30 and row.mean == 1 and row.mean_tokens == 8
    noise = planted(spark, True)
    row = stability.stability(stability.agreement(noise, stability.original_classes(noise, range(2, 5)), 30)).first()
    assert row["mean"] < 0.9 and row.low < row.high


def test_replicate_counts_are_weighted_counts(spark):
    from seqspark.operators.resample import bootstrap_counts

    lines = spark.createDataFrame([(1, 1, ["x", "y", "x"]), (1, 2, ["y"]), (2, 1, []), (2, 2, ["x", "x"])], "doc int, line int, tokens array<string>")
    got = {tuple(r)[:4]: r.n for r in stability.replicate_counts(lines, 20).collect()}
    want = Counter()
    tokens = {(r.doc, r.line): r.tokens for r in lines.collect()}
    for r in bootstrap_counts(lines, 20).collect():
        ts = tokens[r.doc, r.line]
        want[r.rep, "lines", "", ""] += r.weight
        for t in ts:
            want[r.rep, "token", t, ""] += r.weight
        for a, b in zip(ts, ts[1:]):
            want[r.rep, "pair", a, b] += r.weight
    assert {k: v for k, v in got.items() if k[1] in ("lines", "token", "pair")} == dict(want)


def test_adjusted_rand_is_that_of_the_frame_operator(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice("xy")) for _ in range(60)]
    one = cluster.adjusted_rand(spark.createDataFrame(rows, "x string, y string"), "x", "y").first().ari
    assert stability.adjusted_rand([r[0] for r in rows], [r[1] for r in rows]) == pytest.approx(one)


def test_loadings_are_principal_axes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 4)) * [3, 1, 0.5, 0.1]
    df = cluster.vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>"), "k", "v")
    got = cluster.loadings(df, 2, list("abcd")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    _, s, axes = np.linalg.svd(unit - unit.mean(0))
    for c in (1, 2):
        own = np.array([r.loading for r in got if r.component == c])
        assert abs(abs(own @ axes[c - 1]) - 1) < 1e-9 and own[abs(own).argmax()] > 0
        assert [r.variance for r in got if r.component == c][0] == pytest.approx(s[c - 1] ** 2 / (s**2).sum())
    scatter = cluster.scatter(cluster.reduced(df, 2).withColumn("label", F.col("k") % 2), "k", "pca", "label").collect()
    centre = [r for r in scatter if r.kind == "centre" and r.label == 1][0]
    assert centre.x == pytest.approx(np.mean([r.x for r in scatter if r.kind == "point" and r.label == 1])) and len(scatter) == 82


def test_of_rows_that_share_a_line_the_first_in_its_file_is_discordant(spark, tmp_path):
    """Rows of one order, supplier and line number with odd symbols at one place: the SQL's arg_min leaves the tie open, read in order it takes the first row."""
    import duckdb
    from seqspark.queries import QUERIES, SQL

    rng = random.Random(3)
    rows = [(k, 1, 1, 7, float(rng.randint(1, 50)), rng.choice([0.02, 0.07]), flag) for k in range(60) for flag in rng.sample("NAR", 3)]
    table = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, l_returnflag string")
    table.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    for name in ("discordant_rows", "discordant_row_runs"):
        got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(con.execute(SQL[name]).fetchall()) and got or name == "discordant_row_runs"


def test_discordance_counts_windows_of_a_line_only(spark):
    rows = [(1, 1, list("llllplll")), (1, 1, list("llllqlll")), (1, 2, list("lll")), (1, 3, ["l"] * 7 + [None]), (1, 4, None), (2, 1, list("lllplllllllqllll"))]
    lines = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc int, line int, tokens array<string>, o int").repartition(2)
    got = sorted((r.doc, r.line, r.position, r.symbol, r.ruler) for r in hypotheses.local_discordance(lines, ties=["o"]).collect())
    assert got == [(1, 1, 4, "p", "l"), (2, 1, 3, "p", "l"), (2, 1, 11, "q", "l")]
    marked = sorted((r.doc, r.line, r.odd) for r in hypotheses.discordant_lines(lines).collect())
    assert marked == [(1, 1, True), (1, 1, True), (1, 2, False), (1, 3, False), (1, 4, False), (2, 1, True)]


def test_morse_scores_read_large_tables_of_texts(spark):
    """4,000 texts in all 21 pairs are read as plain functions read them; by expressions of Spark alone this took minutes."""
    import time

    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("lgapvxr  e") for _ in range(1500))) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, t string").repartition(4)
    bi, tri = ["DE", "LA", "EL", "EE"], ["DEL", "TET"]
    begin = time.time()
    got = {(r.k, r.a, r.b): r for r in hypotheses.morse_scores(df, "k", "t", "lgapvxr", bi, tri).collect()}
    assert time.time() - begin < 120 and len(got) == 4000 * 21
    few = df.where("k < 20")
    for a, b in ("lg", "ar", "vx"):
        for dot, dash in ((a, b), (b, a)):
            plain = hypotheses.morse_test(few, "k", "t", [(dot, dash)]).withColumn("s", hypotheses.language_score(F.col("reading"), bi, tri)).collect()
            assert len(plain) == 20
            for r in plain:
                own = got[r.k, a, b]
                assert own.groups == r.groups and own.score >= r.s - 1e-12
                assert own.dot != dot or (own.score == pytest.approx(r.s) and own.reading == r.reading[:50])
    assert np.mean([r.z for r in got.values()]) < 1 and min(r.control_sd for r in got.values()) > 0


def test_patterns_of_many_docs_leave_a_task_together(spark):
    """Docs' patterns are handed on in batches, not doc by doc, and are those of each doc alone."""
    import random

    import pyarrow as pa
    from seqspark.operators import patterns

    rng = random.Random(3)
    docs = {d: [[rng.choice("abc") for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(1, 8))] for d in range(40)}
    rows = spark.createDataFrame([(d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)], "doc int, line int, tokens array<string>")
    whole = rows.groupBy("doc").agg({"line": "max"}).select("doc")
    sizes = []

    class Rows:
        schema = whole.schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            batch = pa.RecordBatch.from_arrays([pa.array(list(docs), pa.int32()), pa.array(list(docs.values()), pa.list_(pa.list_(pa.string())))], names=["doc", "lines"])
            return [sizes.append(b.num_rows) or b for b in run(iter([batch]))]

    got = sorted(tuple(r.values()) for b in patterns._covered(Rows(), "lines", None) for r in b.to_pylist())
    assert got == sorted((d, *p) for d, ts in docs.items() for p in patterns.cover_of_lines(ts)) and len(sizes) == 1
    assert sorted(map(tuple, patterns.doc_patterns(rows, None).collect())) == got
