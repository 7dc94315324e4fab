import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from seqspark.llm import crosstok, queries, tokencounts

SPACES = " \t\n\r\x0b\x0c\x1c\x85\xa0   　​﻿"
ODD = [
    None, "", " ", "  ", "a ", " a", "a  b   c", "<|endoftext|> <s></s><unk><0x41>", "it's we'll 's 't", "tab\t x\n\n y ", "日本語 と 한국어", "é à ç Ã\xa0 x　 y   z",
    "a▁b", "▁", "x\x00y \x00", "😀 👩‍👩‍👧 z", "ab" * 3000, "word " * 3000, "a\xa0 b", "1234567 12 3.14", "İ ß ŉ ́ é ", "the the the the",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.vocabulary_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    alphabet = tokencounts.byte_alphabet()
    byte = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    return a, b, lambda i: bytes(alphabet[c] for c in a.id_to_token(i)), lambda i: byte(b.id_to_piece(i))


def brute(libraries, text):
    """(A ids, B ids, [(A ids, B ids) of each group]) of the whole text by the libraries; None without tokens."""
    a, b, bytes_a, bytes_b = libraries
    if not text:
        return None
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts = [bytes_a(i) for i in ids[0]], [bytes_b(i) for i in ids[1]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    both = sorted(set(ends[0]) & set(ends[1]))
    groups, lo = [], (0, 0)
    for e in both:
        hi = ends[0].index(e, lo[0]) + 1, ends[1].index(e, lo[1]) + 1
        groups.append((ids[0][lo[0] : hi[0]], ids[1][lo[1] : hi[1]]))
        lo = hi
    return *ids, groups


def brute_rows(libraries, docs):
    found = [(doc, brute(libraries, text)) for doc, text in docs]
    count = Counter((g[0][-1], g[1][-1]) for _, x in found if x for g in x[2])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for doc, x in found:
        if x is None:
            yield doc, 0, 0, 0, 0, 0, 0, ""
            continue
        links = [(g[0][-1], g[1][-1]) for g in x[2]]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in x[2])
        yield doc, len(x[0]), len(x[1]), len(links), len(links), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest()


def test_align():
    rng = random.Random(4)
    for _ in range(3000):
        n = rng.randint(1, 60)
        ends = [np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})) for _ in range(2)]
        both = sorted({*ends[0].tolist()} & {*ends[1].tolist()})
        last_a, last_b = crosstok.align(*ends)
        assert ends[0][last_a].tolist() == ends[1][last_b].tolist() == both
    same = np.arange(1, 100_000)
    assert (crosstok.align(same, same)[1] == same - 1).all()
    assert crosstok.align(np.zeros(0, int), np.zeros(0, int))[0].tolist() == []


def test_texts_by_pieces_are_the_libraries(libraries, monkeypatch):
    monkeypatch.setattr(crosstok, "_BLOCK_BYTES", 500)
    by = crosstok.Aligner(queries.vocabulary_path(), queries.model_path())
    by.HELD, by.JOINED = 300, 7
    rng = random.Random(6)
    alphabet = SPACES + "  ab's1é日ß-.,▁😀"
    made = ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(8000)] + ["".join(rng.choices(alphabet[:-3], k=3000)) for _ in range(4)]
    texts = ODD + made
    for text, got in zip(texts, by.many(texts), strict=True):
        x = brute(libraries, text)
        assert (got is None) == (x is None), repr(text)
        if x:
            groups = ";".join("|".join(",".join(map(str, side)) for side in g) for g in x[2])
            assert got[:2] == (len(x[0]), len(x[1])) and got[3] == hashlib.sha256(groups.encode()).hexdigest(), repr(text)


def test_rows(spark, libraries):
    docs = list(enumerate(ODD)) + [(21, ODD[21])] * 2 + [(None, "the end")]
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in docs], "doc_id int, text string, n_a int, links binary").repartition(3)
    got = crosstok.cross_alignment(df, queries.vocabulary_path(), queries.model_path())
    assert got.columns == crosstok.SCHEMA.names
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_rows(libraries, docs), key=str)
    assert crosstok.cross_alignment(df.where("false"), queries.vocabulary_path(), queries.model_path()).collect() == []
    with pytest.raises(ValueError):
        crosstok.pair_counts(crosstok.aligned(df, queries.vocabulary_path(), queries.model_path()), np.dtype("<u4"), 3)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_op13(spark, libraries, scale):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{scale}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op13_cross_alignment(spark, f"/root/testdata/{scale}").collect())) == sorted(brute_rows(libraries, docs))
