"""Micro fixtures, worked out by hand, and properties."""

import math

import pytest
from pyspark.sql import functions as F
from seqspark.functions import scalars
from seqspark.operators import anomaly, cluster, counts, crypto, hypotheses, ngram, parse, patterns, resample, segments, signature, stats
from seqspark.plans.report import anomaly_report
from seqspark.sources import corpora, files
from seqspark.streaming import live


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(column.alias("v")).first().v


def lines(spark, *rows):
    return spark.createDataFrame([(d, i, t.split()) for d, i, t in rows], "doc string, line int, tokens array<string>")


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("3l(la-2v)g<4 5>q12", ["3", "l", "(la-2v)", "g", "<4", "5>", "12"]),
        ("(a(b)c)L", ["(a(b)c)", "l"]),
        ("l(2g", ["l", "(2g"]),
        ("<<5", ["<5"]),
        ("", []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, parse.tokenize(F.col("t")), t=text) == tokens


@pytest.mark.parametrize(
    "text, tokens, blocks",
    [
        ("3a(la-2v)(53)2MZ4>", ["a", "a", "a", "<la>", "(53)", "MZ", "MZ", "4>"], [(3, "la", 2)]),
        ("l(2ga)", ["l", "g", "g", "a"], []),
        ("0al", ["l"], []),
        ("a(b(c-3v)d", ["a", "b", "<c>", "d"], [(2, "c", 3)]),
        ("IMZ 2IMZ <7?", ["IMZ", "IMZ", "IMZ", "<7", "?"], []),
    ],
)
def test_expand(spark, text, tokens, blocks):
    assert parse.expand_text(text) == (tokens, blocks)
    row = parse.expand(spark.createDataFrame([(text, 1)], "text string, n int"), "text").first()
    assert row["tokens"] == tokens and [tuple(b) for b in row["blocks"]] == blocks


def test_expand_flat_and_rows(spark):
    assert one(spark, parse.expand_flat(F.col("t")), t="3a2l(12)4>") == list("aaall") + ["(12)", "4>"]
    assert one(spark, parse.expand_flat(F.col("t")), t="0al") == ["l"]
    assert "".join(one(spark, parse.expand_row(F.col("t")), t="(3)p12g")) == "lllplllg"
    for text, want in {"(la-2v)": "lala", "g(2p-3v)(2)x": "gllpllpllpllx", "(a-2v-2v)": "allva" + "llv", "((3))": "lll", "(a(2g-2v)": "allgllg", "": ""}.items():
        assert "".join(one(spark, parse.expand_row(F.col("t")), t=text)) == want, text


def test_names_headers_rows(spark):
    assert one(spark, parse.clean_name(F.col("t")), t="CM. 4. Pasión.txt") == "CM_Pasión"
    assert one(spark, parse.clean_name(F.col("t")), t="CM. 17-18. Pelargonia.txt") == "CM_Pelargonia"
    assert one(spark, parse.header_points(F.col("t")), t="8/10p") == "8/10"
    assert one(spark, parse.normalized_instruction(F.col("t")), t="71.-(6P)L") == "-(6p)l"
    rows = spark.createDataFrame([("12 ab c",), ("x",), ("7",), ("3-zz",)], "v string")
    assert [(r.line, r.raw) for r in parse.numbered_rows(rows, "v").collect()] == [(12, "ab c")]
    assert [(r.line, r.raw) for r in parse.numbered_or_dashed_rows(rows, "v").collect()] == [(12, "ab c"), (3, "zz")]


def test_scalars(spark):
    assert one(spark, scalars.cosine_distance(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 1.0
    for x in (0.5, 1.0, 2.0, 10.0, 1234.5):
        assert one(spark, scalars.log_gamma(F.lit(x))) == pytest.approx(math.lgamma(x), abs=1e-9)
    assert one(spark, scalars.paren_depth(F.col("t")), t="(a(b)c)") == 2
    z = one(spark, scalars.runs_z(F.lit(2.0), F.lit(2.0), F.lit(2.0)))
    assert z == pytest.approx((2 - 3) / math.sqrt(2 / 3))
    assert one(spark, scalars.runs_z(F.lit(0.0), F.lit(9.0), F.lit(1.0))) is None
    hyper = sum(math.comb(5, k) * math.comb(15, 6 - k) for k in range(3, 6)) / math.comb(20, 6)
    n = [F.lit(v).cast("long") for v in (3, 5, 6, 20)]
    assert one(spark, scalars.fisher_greater(*n)) == pytest.approx(hyper)
    assert one(spark, scalars.overlap_free_count(F.col("t"), F.lit("aa")), t="aaaaa") == 2
    df = spark.createDataFrame([(2.0,)] * 3, "x double")
    assert {r.z for r in stats.z_global(df, "x", "z").collect()} == {0.0}


def test_bigram_grammar(spark):
    docs = [(f"d{i}", 0, "V1 V2") for i in range(6)] + [(f"e{i}", 0, "V2 V3") for i in range(5)]
    p = {(r.ctx[0], r.sym): r.p for r in ngram.smoothed(lines(spark, *docs)).collect()}
    assert p[ngram.BOS, "V1"] == pytest.approx(6.5 / 13)
    for ctx in {c for c, _ in p}:
        assert sum(v for (c, _), v in p.items() if c == ctx) == pytest.approx(1)
    unseen = ngram.surprisal(lines(spark, ("x", 0, "Z Z")), training=lines(spark, *docs))
    r = unseen.where("pos = 1").first()
    assert (r.p, r.bits, r.context_seen, r.zero_prob) == (0.25, 2.0, False, True)
    empty = lines(spark, ("x", 0, ""))
    assert ngram.surprisal_summary(ngram.surprisal(empty), "doc").first().positions == 1
    assert ngram.leave_one_doc_out(lines(spark, *docs)).where("loo_bits < in_sample_bits - 1e-9").count() == 0


def test_statistics(spark):
    ic = stats.index_of_coincidence(spark.createDataFrame([("s", t) for t in "aab" * 1], "id string, token string"), "id").first()
    assert ic.ic is None
    long = spark.createDataFrame([("s", t) for t in "a" * 8 + "b" * 4], "id string, token string")
    assert stats.index_of_coincidence(long, "id").first().ic == pytest.approx((8 * 7 + 4 * 3) / (12 * 11))
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p_value double")
    q = {r.k: r.q_value for r in stats.benjamini_hochberg(p).collect()}
    assert q == pytest.approx({"a": 0.03, "b": 0.04, "c": 0.04})
    kas = stats.repeated_gram_distances(lines(spark, ("d", 0, "a b c x y z a b c q w e a b c")))
    assert sorted(r.d for r in kas.collect()) == [6, 6]
    assert stats.common_divisor(kas, "doc").first().gcd == 6
    assert {r.factor: r.n for r in stats.factor_histogram(kas).collect()} == {2: 2, 3: 2, 6: 2}
    same = resample.shuffled_coincidence(lines(spark, ("d", 0, "a a b b b c c c c d d")), 5).first()
    assert same.sd_ic == pytest.approx(0)
    null = resample.null_model(lines(spark, *((f"d{i}", 0, "a b " * 12) for i in range(3))), 19).first()
    assert null.p_value == pytest.approx(1 / 20) and null.h_obs == pytest.approx(0, abs=1e-9)


def test_runs_and_windows(spark):
    flags = spark.createDataFrame([("d", i, f) for i, f in enumerate([True, True, False, True, True, True])], "doc string, i0 int, f boolean")
    got = segments.maximal_runs(flags, ["doc"], ["i0"], F.col("f")).first()
    assert (got["first"], got["last"], got.length) == (3, 5, 3)
    s = spark.createDataFrame([("d", i, float(v)) for i, v in enumerate([1, 5, 3])], "doc string, i0 int, x double")
    assert segments.max_window_mean(s, ["doc"], ["i0"], "x", 2).first().max_mean == 4
    gaps = spark.createDataFrame([("d", v) for v in (1, 3, 5, 9, 10)], "doc string, v int")
    assert [tuple(r) for r in segments.gap_islands(gaps, ["doc"], "v").collect()] == [("d", 1, 5, 3)]
    v = lambda *n: one(spark, segments.verdict(*(F.lit(x) for x in n)))
    assert [v(0, 0, 1), v(0, 2, 0), v(1, 0, 0), v(0, 1, 1), v(0, 0, 0)] == ["PERFIL_LEXIC", "PERFIL_GRAMATICAL", "CONVERGENCIA", "MIXT", "SENSE_SENYAL"]


def test_report_plan(spark):
    rows = spark.createDataFrame([("d", i, 9.0 if 20 <= i < 26 else 1.0 + i % 3 / 10, 3.0 if i == 22 else 0.0) for i in range(60)], "doc string, o int, g double, l double")
    parts = anomaly_report(rows, "doc", ["o"], "g", "l", 50)
    best = parts["segments"].where("first <= 20 and last >= 25").first()
    assert best.p_value <= 0.05 and best.n_conv == 1 and best.verdict == "CONVERGENCIA"


def test_patterns(spark):
    assert patterns.greedy_cover("a b c x a b c y a b".split(), 8) == [("a b c", 2, 6), ("a b", 3, 2)]
    p = spark.createDataFrame([("a b c", 3), ("a b", 2), ("b c", 2), ("c", 1), ("x ab", 2)], "pattern string, length int")
    edges = patterns.containment(p)
    assert {tuple(r) for r in edges.collect()} == {("a b c", "a b"), ("a b c", "b c"), ("a b c", "c"), ("b c", "c")}
    cut = patterns.reduced(edges)
    assert ("a b c", "c") not in {tuple(r) for r in cut.collect()}
    spark.sparkContext.setCheckpointDir(spark.sparkContext._jsc.sc().getCheckpointDir().get() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else "/tmp/spark-checkpoints-seqspark")
    assert {r.node: r.depth for r in patterns.depths(cut, p).collect()} == {"a b c": 0, "a b": 1, "b c": 1, "c": 2, "x ab": 0}


def test_hypotheses(spark):
    got = hypotheses.local_discordance(lines(spark, ("d", 0, "l l l l p l l l"))).collect()
    assert [(r.position, r.symbol, r.ruler) for r in got] == [(4, "p", "l")]
    g = one(spark, hypotheses.symbol_groups(F.col("t"), "e", "t"), t="eee ttt xx eeeeee et")
    assert g == ["eee", "ttt", "et"]
    assert one(spark, hypotheses.decoded(F.array(*(F.lit(x) for x in ("eee", "ttt", "eeetet"))), "e", "t")) == "SO?"
    assert one(spark, hypotheses.language_score(F.lit("DE?LA"), ["DE", "LA"], ["DEL"])) == pytest.approx((2 + 3) / (3 + 3 * 2))
    groups = spark.createDataFrame([("k", ["et", "te", "eet"])], "k string, g array<string>")
    shuffled = [r.g for r in hypotheses.shuffled_groups(groups, "k", 4).collect()]
    assert all(sorted(map(sorted, g)) == sorted(map(sorted, ["et", "te", "eet"])) for g in shuffled)


def test_signatures_and_flags(spark):
    cls = spark.createDataFrame([("a", "C0"), ("b", "C1")], "token string, class string")
    s = signature.composition(signature.classified(lines(spark, ("d", 0, "a a b z"), ("d", 1, "b b"), ("d", 2, "z")), cls), ["C0", "C1"])
    j = {r.line: r.jump for r in signature.jumps(s).collect()}
    assert j[0] is None and j[1] == pytest.approx(1 - 1 / math.sqrt(5)) and j[2] == 1.0
    assert {r.line: r.unknown for r in s.collect()} == {0: 1, 1: 0, 2: 1}
    f = anomaly.flagged(spark.createDataFrame([(3, True), (0, None)], "x int, y boolean"), {"fx": F.col("x") > 2, "fy": F.col("y")}, {"p": ["fx"], "q": ["fy"]})
    assert [(r.n_flags, r.category, r.cross) for r in f.collect()] == [(2, "ALTA", True), (0, "NORMAL", False)]
    data = spark.createDataFrame([(float(i), 2.0 * i, None if i == 3 else 1.0) for i in range(6)], "a double, b double, c double")
    scores = [r.score for r in anomaly.first_component(data, ["a", "b", "c"]).orderBy("a").collect()]
    assert min(scores) == 0 and scores == sorted(scores)
    assert one(spark, crypto.verdict_by_ratio(F.lit(1.2))) == "MES_CONCENTRAT"


def test_agreement(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "x int, y int")
    assert cluster.adjusted_rand(df, "x", "y").first().ari == 1


def test_corpora(spark, sf):
    last = corpora.last_of_key(spark.createDataFrame([("d", 1, 0, "a"), ("d", 1, 1, "b")], "doc string, line int, o int, t string"), ["doc", "line"], "o")
    assert [r.t for r in last.collect()] == ["b"]
    for make in (corpora.event_lines, corpora.user_streams, corpora.conversation_lines, corpora.document_lines, corpora.order_lines):
        assert counts.corpus_summary(make(spark, sf)).first().tokens > 0
    none = corpora.event_lines(spark, sf).where("false")
    assert counts.bigram_counts(none).collect() == [] and stats.significance(none).collect() == []


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "CM. 4. Pasión.txt").write_text("8/10p\n1 3l\n2 (la-2v)\n\nnote\n")
    (tmp_path / "in" / "deep" / "other.txt").write_text("1 2g")
    rows = {(r.doc, r.header, r.line, r.raw) for r in files.instruction_corpus(spark, str(tmp_path / "in")).collect()}
    assert {(h, n, raw) for _, h, n, raw in rows} == {("8/10", 1, "3l"), ("8/10", 2, "(la-2v)"), ("", 1, "2g")}
    df = spark.createDataFrame([(1, 0.123456, True, None), (2, None, False, "x")], "a int, b double, c boolean, d string")
    files.write_csv(df, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert "1,0.1235,TRUE" in text and "FALSE,x" in text
    back = files.read_csv(spark, str(tmp_path / "csv"), "a int, b double, c boolean, d string")
    assert back.where("b is null").first().a == 2
    files.write_json(df, str(tmp_path / "json"))
    assert files.read_json(spark, str(tmp_path / "json"), df.schema).count() == 2
    assert files.optional_table(spark, str(tmp_path / "none"), "a int").collect() == []
    files.write_report(df.where("a = 1"), str(tmp_path / "txt"), "%d lines", "a")
    assert "1 lines" in "".join(p.read_text() for p in (tmp_path / "txt").glob("part-*"))


def test_streaming(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,i*10) as ts, 'u' as user, if(i%2=0,'a','b') as token from (select explode(sequence(0,5)) i)")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df in (("w", live.windowed_token_counts(source, "ts", "token")), ("s", live.sessions(source, "ts", "user"))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(f"live_{name}").start()
        q.processAllAvailable()
        q.stop()
    assert {(r.token, r.n) for r in spark.table("live_w").collect()} == {("a", 3), ("b", 3)}
    assert [r.length for r in spark.table("live_s").collect()] == [6]


def test_files_in_splits_keep_their_lines_in_order(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    texts = {f"{c}.txt": end.join(f"{c} line {i} " + "é" * (i % 40) for i in range(300)) + tail for c, end, tail in (("a", "\n", ""), ("b", "\r\n", "\r\n"), ("sub/c", "\n", "\n\n"))}
    (tmp_path / "sub").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "other.csv").write_text("no\n")
    expected = [(name.rsplit("/", 1)[-1], i, line) for name, text in sorted(texts.items()) for i, line in enumerate(text.splitlines())]
    try:
        for size in ("700b", "1g"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            df = files.text_corpus(spark, str(tmp_path))
            got = df.orderBy("row").collect()
            assert [(r.doc_path.rsplit("/", 1)[-1], r.ordinal, r.value) for r in got] == expected and [r.row for r in got] == list(range(len(expected)))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        assert files.text_corpus(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    report = str(tmp_path / "report")
    files.write_report(spark.range(1000).selectExpr("id", "pmod(hash(id), 7) AS k").repartition(7), report, "%d %d", "k", "id", order=["k", "id"])
    rows = [tuple(map(int, r.value.split())) for r in files.text_corpus(spark, report).orderBy("row").collect()]
    assert rows == sorted(rows) and len(rows) == 1000
    files.write_csv(spark.createDataFrame([(1, "x"), (None, "EOS")], "n int, t string"), str(tmp_path / "eos"))
    assert [r.t for r in files.read_csv(spark, str(tmp_path / "eos"), "n int, t string", required=["n"]).collect()] == ["x"]


def test_literal_match_takes_whole_quotations(spark, tmp_path):
    from seqspark.queries import QUERIES

    item = "The quick brown fox jumps over the lazy dog"
    turns = [(1, 1, item.upper()), (1, 2, "he said: " + item + "!"), (1, 3, "brown fox jumps over"), (2, 1, "the quiet night"), (2, 2, "short one"), (2, 3, "a short one"), (2, 4, None)]
    spark.createDataFrame(turns, "conv_id int, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, item), (2, "Short one")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in QUERIES["literal_match_whole"](spark, str(tmp_path)).collect())
    assert got == [(1, 1, 1, "IDENTICA"), (1, 2, 1, "SUBCADENA"), (1, 3, 1, "SUBCADENA"), (2, 2, 2, "IDENTICA")]


def test_expand_text_nests_to_any_depth():
    assert parse.expand_text("(" * 50_000 + "3a" + ")" * 50_000) == (["a"] * 3, [])
    assert parse.expand_text("(" * 2000 + "la-2v" + ")" * 1999)[0] == ["<la>"]
    assert parse.expand_text("(a(2b)") == (["a", "b", "b"], []) and parse.expand_text("a)b") == (["a", ")", "b"], [])
    assert parse.expand_text("(a(b-2v)c(x-y-13v))") == (["a", "<b>", "c", "<x-y>"], [(1, "b", 2), (3, "x-y", 13)])
    # a block has a sequence and a small v
    assert parse.expand_text("(la-2V)") == (["l", "a", "-", "V", "V"], []) and parse.expand_text("(-2v)") == (["-", "v", "v"], [])
    assert parse.expand_text("(a-v)(2v)(--3v)") == (["a", "-", "v", "v", "v", "<->"], [(5, "-", 3)])
    assert parse.expand_text("(" * 3000 + "x-" + "1" * 3000 + "v")[1][0][1] == "(" * 2999 + "x"


def test_greedy_cover_takes_the_longest_repeats(spark):
    import random

    def plain(tokens):
        covered, out = set(), []
        for size in range(len(tokens) - 1, 1, -1):
            grams = {}
            for i in range(len(tokens) - size + 1):
                grams.setdefault(tuple(tokens[i : i + size]), []).append(i)
            for gram, at in grams.items():
                fresh = {j for i in at for j in range(i, i + size)} - covered
                if len(at) > 1 and fresh:
                    out.append((" ".join(gram), len(at), len(fresh)))
                    covered |= fresh
        return out

    long = [f"t{i}" for i in range(12)]
    stream = [*long, "x", *long]
    got = patterns.repeated_patterns(spark.createDataFrame([(1, stream)], "doc int, tokens array<string>")).collect()
    assert [tuple(r) for r in got] == [(1, " ".join(long), 2, 24)]
    rng = random.Random(4)
    for n in [*range(12), 40, 90]:
        for letters in ("a", "ab", "abcde"):
            tokens = rng.choices(letters, k=n) * rng.choice([1, 2])
            assert patterns.greedy_cover(tokens) == plain(tokens), tokens


def test_token_classes_cover_all_tokens_over_the_hapax_threshold(spark, tmp_path):
    from seqspark.queries import QUERIES

    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    turns = [(c, 1, " ".join(word(3 * (7 * i * (c + 1) % 131) + i % 3) for i in range(200)) + f" once{word(c)}") for c in range(4)]
    spark.createDataFrame(turns, "conv_id int, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    counts = {}
    for _, _, text in turns:
        for w in text.split():
            counts[w] = counts.get(w, 0) + 1
    got = QUERIES["token_classes"](spark, str(tmp_path)).collect()
    often = {w for w, n in counts.items() if n > 1}
    assert len(often) > 100 and sorted(r.token for r in got) == sorted(often)
    assert len({r.label for r in got}) >= 2


def test_fisher_tails_of_frequent_pairs_end_where_nothing_is_left(spark):
    import random
    import time

    import numpy as np

    rng, rows = random.Random(5), []
    for _ in range(400):
        n = rng.randint(1, 3000)
        a, b = rng.randint(0, n), rng.randint(0, n)
        rows.append((rng.randint(max(0, a + b - n), min(a, b)), a, b, n))
    df = spark.createDataFrame(rows, "n long, n_a long, n_b long, total long").coalesce(1)
    got = stats.with_fisher(df).withColumn("plain", scalars.fisher_greater(*map(F.col, ("n", "n_a", "n_b", "total")))).collect()
    assert len(got) == 400 and all(r.p_value == pytest.approx(r.plain, abs=1e-12) for r in got)
    begin = time.time()
    many = np.array([(10**6 + k, 10**8, 10**8, 10**10) for k in range(-2000, 2000, 10)], np.int64).T
    p = stats.fisher_tails(*many)  # 99 million terms each without an end
    assert time.time() - begin < 60 and (np.diff(p) <= 0).all() and abs(p[200] - 0.5) < 1e-2
    assert stats.with_fisher(df.where("false")).collect() == []


def test_replicates_of_a_long_series_are_dealt_and_stay_the_same(spark, monkeypatch):
    from seqspark.operators import segments

    rows = [(d, i, float((i + d) % 11), (i + d) % 11 > 3) for d in range(4) for i in range(30 + 40 * d)]
    df = spark.createDataFrame(rows, "doc int, o int, score double, high boolean").repartition(3)
    out = []
    for most in (200_000, 25):
        monkeypatch.setattr(segments, "LONG", most)
        out.append(sorted(map(tuple, segments.segment_significance(df, "doc", ["o"], 12).collect())))
    assert out[0] == out[1] and len(out[0]) > 4
