"""The Morse test over a corpus against a plain reading of its joined text."""

import random
import re
import statistics
from itertools import combinations

import pytest

import __spark_entry__ as entry
from seqspark.operators import hypotheses, morse
from seqspark.queries.composed import BIGRAMS, TRIGRAMS

LETTER = {code: letter for letter, code in hypotheses.MORSE.items()}


def score(text):
    clean = text.replace("?", "")
    m = len(clean)
    if m < 3:
        return 0.0
    two = sum(clean[i : i + 2] in set(BIGRAMS) for i in range(m - 1))
    three = sum(clean[i : i + 3] in set(TRIGRAMS) for i in range(m - 2))
    return (two + 3 * three) / ((m - 1) + 3 * (m - 2))


def read(groups, dot):
    return "".join(LETTER.get("".join("." if c == dot else "-" for c in g), "?") for g in groups)


def plain(texts, symbols, least=50):
    whole = " ".join(t.lower() for t in texts)
    out = {}
    for a, b in combinations(symbols, 2):
        every = re.findall(f"[{a}{b}]+", whole)
        if len(every) < least:
            continue
        kept = [g for g in every if len(g) <= 5]
        best = max((a, b), key=lambda dot: score(read(kept, dot)))  # the first at a tie
        out[a + b] = (len(kept), whole.count(a), whole.count(b), best, read(kept, best)[:50], score(read(kept, best))), kept
    return out


def control(groups, times):
    rng, scores = random.Random(1), []
    for _ in range(times):
        some = ["".join(rng.sample(g, len(g))) for g in rng.sample(groups, len(groups))]
        scores.append(score("".join(read([g], min(g)) for g in some)))
    return statistics.mean(scores), statistics.stdev(scores)


SCHEMA = "k long, text string, pair int"


@pytest.mark.parametrize("chars", [7, 1 << 22])
def test_reading_is_that_of_the_joined_text(spark, monkeypatch, chars):
    rng = random.Random(chars)
    texts = ["".join(rng.choice("lgapvxr   LGÀz\n") for _ in range(rng.randint(0, 90))) for _ in range(150)]
    texts += ["lggl", "", "l" * 400, "lg", "lg", "g" * 5]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(-1, None, 0)]
    monkeypatch.setattr(morse, "CHARS", chars)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.pair: r for r in morse.corpus_test(df, ["k"], "text", "lgapvxr", BIGRAMS, TRIGRAMS, times=2).collect()}
    want = plain(texts, "lgapvxr")
    assert set(got) == set(want) and len(got) == 21
    for pair, (row, _) in want.items():
        r = got[pair]
        assert (r.groups, r.n1, r.n2, r.dot, r.reading) == row[:5], pair
        assert r.score == pytest.approx(row[5]) and r.ratio == pytest.approx(row[1] / row[2])


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_control_is_that_of_shuffled_groups(spark, monkeypatch, block):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("llg") for _ in range(rng.randint(1, 6))) for _ in range(1500))
    monkeypatch.setattr(morse, "BLOCK", block)
    r = morse.corpus_test(spark.createDataFrame([(1, text, 0)], SCHEMA), ["k"], "text", "lg", BIGRAMS, TRIGRAMS, times=300).first()
    (row, kept) = plain([text], "lg")["lg"]
    mean, sd = control(kept, 300)
    assert r.control == pytest.approx(mean, abs=5 * sd / 300**0.5 * 2**0.5)
    assert r.control_sd == pytest.approx(sd, rel=0.25)
    assert r.z == pytest.approx((row[5] - r.control) / r.control_sd)


def test_blocks_hold_every_group_once(spark, monkeypatch):
    monkeypatch.setattr(morse, "BLOCK", 10)
    counts = [0] * 64
    counts[2], counts[4], counts[13] = 500, 300, 7  # one and two dots, and a group of three
    df = spark.createDataFrame([(0, counts)], "pair long, counts array<long>")
    pieces = morse.shuffled_pieces(df, "gl", [], [], 3, 42)
    assert {r.perm: r.n for r in pieces.groupBy("perm").agg({"letters": "sum"}).withColumnRenamed("sum(letters)", "n").collect()} == {p: 807 for p in range(3)}
    assert pieces.where("perm = 0").count() == 128
    again = morse.shuffled_pieces(df.repartition(2), "gl", [], [], 3, 42)
    assert sorted(map(tuple, pieces.collect())) == sorted(map(tuple, again.collect()))


def test_few_groups_and_empty_tables(spark):
    few = spark.createDataFrame([(1, "lg l g", 0), (2, None, 0), (3, "", 0)], SCHEMA)
    assert morse.corpus_test(few, ["k"], "text", "lga", BIGRAMS, TRIGRAMS).count() == 0
    r = {r.pair: r for r in morse.corpus_test(few, ["k"], "text", "lga", BIGRAMS, TRIGRAMS, least=2).collect()}
    assert (r["la"].groups, r["la"].n2, r["la"].ratio, r["lg"].groups) == (2, 0, None, 3)
    assert morse.corpus_test(few.limit(0), ["k"], "text", "lga", BIGRAMS, TRIGRAMS, least=0).count() == 0


def test_query_reads_all_documents(spark, sf):
    got = {r.pair: r for r in entry.queries()["morse_corpus"](spark, sf).collect()}
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if r.text is not None]
    want = plain(texts, "lgapvxr")
    assert set(got) == set(want)
    for pair, (row, _) in want.items():
        r = got[pair]
        assert (r.groups, r.n1, r.n2, r.dot, r.reading) == row[:5] and r.score == pytest.approx(row[5])
