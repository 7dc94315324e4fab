import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from seqspark.llm import importance

ODD = [None, "", " .,;", "One", "a b", "É É é ſ K", "tab\tand\x00nul", "x" * 5000 + " y", "the cat sat on the mat " * 40, "0x1F a_b don't Ａ"]


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def buckets(text):
    ws = words(text)
    return [zlib.crc32(f.encode()) % 10000 for f in [*ws, *map(" ".join, zip(ws, ws[1:]))]]


def brute(docs, target):
    s, t = (Counter(b for _, text in rows for b in buckets(text)) for rows in (docs, target))
    S, T = float(sum(s.values())), float(sum(t.values()))
    out = []
    for doc, text in docs:
        bs = buckets(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(bs), weight, score, None, len(words(text)) >= 20])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(may[: 25 * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_slice_checksums():
    rng = random.Random(1)
    data = rng.randbytes(3000)
    at = np.array([sorted((rng.randrange(3000), rng.randrange(3000))) for _ in range(300)] + [(5, 5)])
    first = importance.slice_checksums(data, at[:, 0], at[:, 1])
    assert first.tolist() == [zlib.crc32(data[a:b]) for a, b in at]
    assert importance.slice_checksums(data, at[::-1, 0], at[::-1, 1], first).tolist() == [zlib.crc32(data[a:b] + data[c:d]) for (a, b), (c, d) in zip(at, at[::-1])]


def test_offsets_in_pieces(monkeypatch):
    split = importance.WordSplit()
    for size in (7, 1_000_000):
        monkeypatch.setattr(importance, "_BLOCK_CHARS", size)
        for text in ODD:
            low = (text or "").encode().translate(importance._LOWER)
            assert [low[a:b].decode() for a, b in split.offsets(low.decode()).tolist()] == words(text)


def test_resample_against_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(rng.choices("abcdefgh", k=rng.randint(15, 60)))) for i in range(90)]
    docs += [(7, docs[50][1])] * 9 + [(None, docs[51][1])] * 30  # repeated rows and ids, null ids
    target = [(0, "a b c a b. The CAT"), (1, None), (2, "")]
    df = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in docs], "doc_id int, text string, n_words int, uid string, rank double").repartition(4)
    items = spark.createDataFrame(target, "item_id int, text string")
    got = importance.resample(df, items)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target)
    none = items.where("false")
    assert sorted(map(tuple, importance.resample(df, none).collect()), key=str) == brute(docs, [])
    assert importance.resample(df.where("false"), items).collect() == []


def test_rank_of_one_score(spark, tmp_path):
    """All rows tie: still several ranges, every rank once."""
    spark.range(1000).selectExpr("id % 7 AS doc_id", "5L AS n_features", "9L AS score", "id AS uid").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    got = importance.highest(rows, F.lit(True), 50).orderBy("rank").collect()
    drawn = [r for r in got if r.rank]
    assert len(got) == 1000 and [r.rank for r in drawn] == list(range(1, 501))
    assert [r.doc_id for r in drawn] == sorted(r.doc_id for r in drawn)
    assert all(r.rank is None for r in importance.highest(rows, F.lit(False), 50).collect())
    with pytest.raises(ValueError):
        importance.features(rows.withColumn("text", F.lit("")), rows["doc_id"], 1 << 17)
