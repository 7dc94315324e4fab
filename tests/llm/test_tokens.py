import collections
import io
import random
import zlib
from array import array

import pytest
from seqspark.llm import common, packing, queries, tokencounts, tokenfile, wordids

ODD = ["The cat's hat, isn't.", "a<|endoftext|>b c", "Ünïcode… é Å Å", "x\x0by\x0cz\x1cq r", "12 a1b2 ...!?", "", None, " \n\t ", "foo), (bar.", "ΑΣ. ΣΑΣ", "w" * 30000]


def ids_of(t, text):
    return array("I", [*t.encode(text or "", add_special_tokens=False).ids, 2]).tobytes()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_word_ids_are_the_librarys(tokenizer):
    w = wordids.WordIds(queries.tokenizer_path())
    w.HELD = 3
    for text in ODD * 2:
        assert w.ids(text) + b"\2\0\0\0" == ids_of(tokenizer, text)


def test_word_ids_of_odd_letters(tokenizer):
    rng = random.Random(0)
    alphabet = "aYiİßéÅ Ȧ\u0301\u0307.,!'-_*3٣ΣσçŁłĀŉ'  \x1c|<ǅﬁＡ%$\n"
    texts = ["3 İ,", "YYİ.", "i\u0307.", "e\u0301,", *("".join(rng.choices(alphabet, k=rng.randint(1, 14))) for _ in range(6000))]
    w = wordids.WordIds(queries.tokenizer_path())
    assert [ids + b"\2\0\0\0" for ids in w.many(texts)] == [ids_of(tokenizer, t) for t in texts]
    w.BLOCK_CHARS = 50  # long texts go in pieces
    assert w.many(["abc, d\té. " * 90])[0] + b"\2\0\0\0" == ids_of(tokenizer, "abc, d\té. " * 90)


def test_best_fill_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        counts = collections.Counter(rng.randint(1, 30) for _ in range(rng.randint(1, 9)))
        cap = rng.randint(1, 70)
        sums = {0}
        for n, k in counts.items():
            sums = {s + n * j for s in sums for j in range(k + 1)}
        got = packing.best_fill(dict(counts), cap)
        assert all(got[n] <= counts[n] for n in got)
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= cap)


def check_packed(rows, ids):
    got = collections.defaultdict(list)
    seqs = collections.defaultdict(list)
    for r in rows:
        got[r[0]].append(r)
        seqs[r[5]].append(r)
    for doc, raw in ids.items():
        at = 0
        for r in sorted(got[doc], key=lambda r: r[1]):
            assert r[1] == at and r[3] == zlib.crc32(raw[4 * at : 4 * (at + r[2])]) and r[4] == len(raw) // 4
            at += r[2]
        assert at == len(raw) // 4
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r[6]):
            assert r[6] == at and r[2] > 0
            at += r[2]
        assert at == 4096 or at & (at - 1) == 0 and at < 4096


def test_pack(spark, tokenizer):
    rows = [(i, t, "clash", i) for i, t in enumerate(ODD + ["word " * 9000, "a b c"] + ["n " * k for k in range(1, 90)])]
    df = spark.createDataFrame(rows, "doc_id int, text string, start string, length int").repartition(3)
    check_packed([tuple(r) for r in packing.pack(df, queries.tokenizer_path(), pool_items=16).collect()], {r[0]: ids_of(tokenizer, r[1]) for r in rows})
    assert packing.pack(df.where("false"), queries.tokenizer_path()).collect() == []


def test_op2_whole(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check_packed([tuple(r) for r in queries.op2_packing(spark, sf).collect()], {r.doc_id: ids_of(tokenizer, r.text) for r in docs})


def expected_files(docs, tokenizer):
    out, at = [], 0
    for doc, text in docs:
        raw = ids_of(tokenizer, text)
        out.append((doc, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[1])


def test_op9(spark, sf, tokenizer, monkeypatch):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, queries.op9_token_files(spark, sf).collect())) == expected_files(docs, tokenizer)
    odd = [(5, "b"), (5, "b"), (5, "a"), (None, "n"), (1, None), (2, ""), (7, "w " * 70000), (6, "z")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in odd], "doc_id long, text string, start int, tie string").repartition(3)
    ordered = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert sorted(map(tuple, tokenfile.token_files(spark, df, queries.tokenizer_path()).collect()), key=key) == sorted(expected_files(ordered, tokenizer), key=key)
    assert tokenfile.token_files(spark, df.where("false"), queries.tokenizer_path()).collect() == []
    # a doc_id that all rows share is still cut into several files
    monkeypatch.setattr(tokenfile, "SMALL_BYTES", 100)
    monkeypatch.setattr(tokenfile, "READ_DOCS", 7)
    hot = spark.createDataFrame([(None, f"some words {i % 3}") for i in range(300)], "doc_id long, text string").repartition(3)
    files = tokenfile.write_tokens(hot, common.new_folder(spark, "tokens"), queries.tokenizer_path())
    assert files.count() > 1 and files.agg({"n_docs": "max"}).first()[0] < 250
    got = tokenfile.token_files(spark, hot, queries.tokenizer_path()).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected_files(sorted([(None, f"some words {i % 3}") for i in range(300)], key=lambda r: r[1]), tokenizer), key=key)


def test_file_reads_one_frame_and_finds_damage():
    out = io.BytesIO()
    w = tokenfile.Writer(out, frame_bytes=400)
    docs = [bytes(random.Random(i).randbytes(4 * (1 + 37 * i % 150))) for i in range(40)]
    for i, d in enumerate(docs):
        w.add(i, d)
    w.close()
    raw = out.getvalue()
    r = tokenfile.Reader(io.BytesIO(raw), len(raw))
    assert [r.document(i) for i in (7, 39, 0)] == [docs[7], docs[39], docs[0]]
    assert sum(f[1] for f in w.frames) == sum(map(len, docs)) and len(w.frames) > 5
    bad = bytearray(raw)
    bad[-9 - 12 * (len(w.frames) + 1) + 8] ^= 1  # a checksum of the seek table
    with pytest.raises(ValueError):
        tokenfile.Reader(io.BytesIO(bytes(bad)), len(bad)).document(0)


def greedy(pieces, word):
    s, n, first = tokencounts.MARK + word, 0, True
    while s:
        k = max(i for i in range(1, len(s) + 1) if s[:i] in pieces and (s[:1] == tokencounts.MARK) == first or i == 1 and s[:1] in pieces)
        s, n, first = s[k:], n + 1, False
    return n


def test_automaton_is_greedy():
    rng = random.Random(2)
    for _ in range(60):
        pieces = {bytes([b]) for b in range(256)} | {bytes(rng.choice(b" abc" if i == 0 else b"abc") for i in range(rng.randint(1, 6))) for _ in range(25)}
        a = tokencounts.Automaton(sorted(pieces))
        for _ in range(60):
            w = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 14)))
            assert a.length(w) == greedy(pieces, w), (w, sorted(p for p in pieces if len(p) > 1))


def test_op10(spark, sf):
    pieces = set(tokencounts.load_pieces(queries.vocabulary_path()))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op10_token_counts(spark, sf).collect()}
    for d, t in docs.items():
        n = [greedy(pieces, w) for w in t.encode().split()]
        assert tuple(got[d])[1:] == (len(n), sum(n), max(n, default=0))
    odd = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "ÿ\x00 a", 9), (3, "ÿ\x00 a", 9)], "doc_id int, text string, n_words int")
    assert sorted(map(tuple, tokencounts.token_counts(odd, queries.vocabulary_path()).collect()))[:2] == [(1, 0, 0, 0), (2, 0, 0, 0)]
    assert tokencounts.token_counts(odd.where("false"), queries.vocabulary_path()).collect() == []


def test_a_batchs_texts_are_made_strings_a_block_at_a_time():
    import tracemalloc

    import pyarrow as pa

    texts = [None if i == 7 else chr(97 + i % 26) * 100_000 for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": texts})
    tracemalloc.start()
    seen = []
    for block, some in common.text_blocks([batch], 1_000_000):
        assert len(some) <= 11
        seen += [(i, t is None or t == texts[i]) for i, t in zip(block.column("doc_id").to_pylist(), some, strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == [(i, True) for i in range(200)]
    assert peak < 5_000_000  # two blocks, not 20 MB


def test_word_cache_is_bounded_by_bytes(tokenizer):
    rng = random.Random(5)
    w = wordids.WordIds(queries.tokenizer_path())
    w.HELD_BYTES = 100_000
    for _ in range(30):
        text = " ".join("".join(rng.choices("abcdefghij", k=2000)) + "!" * (i % 2) for i in range(10))
        assert w.ids(text) + b"\2\0\0\0" == ids_of(tokenizer, text)
        held = [sum(len(k) + len(v) for k, v in c.items()) for c in (w.young, w.old)]
        assert max(held) < 400_000  # one text's words beyond the bound at most
