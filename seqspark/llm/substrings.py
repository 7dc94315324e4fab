"""Substring dedup by difference-cover anchors.

The set {0, 1, 3} modulo 7 is a difference cover: whatever two places a repeated
passage starts at, one of its first seven words stands at a cover position in both
copies.  So only the windows of ANCHOR words at cover positions are hashed and
compared over the corpus, three of seven; any repeat of WINDOW = 13 words shares
an anchor at the same distance from its start.  Shared anchors are then extended:
the full windows around them are compared by two independent 64-bit hashes, and a
window that also starts in a document with a smaller id has its words removed.

Both comparisons are made on packed arrays.  Documents lie in chunks of some
megabytes, written once to shared storage.  A chunk sends each distinct hash once
to the hash's bucket, so that a passage that stands everywhere costs a row per
chunk; the bucket answers with one bit per hash.  Buckets grow in number with the
corpus, not in size.

Defined results: null texts have no words; documents of fewer than 13 words lose
nothing; a null doc_id counts as larger than all others; rows with equal doc_id
never remove each other's words; texts of any length and empty tables are fine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save, text_blocks
from .wordarrays import PLAIN, SECOND, Words, window_hashes, windows, words_of

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
CHUNK_CHARS = 1_500_000
#: Hashes that one bucket holds on average.
BUCKET_HASHES = 2_000_000
_LAST = np.iinfo(np.int64).max

_CHUNKS = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("rows", T.BinaryType())])
_SENT = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("hashes", T.BinaryType()),
        T.StructField("docs", T.BinaryType()),
    ]
)
_REPLY = "chunk long, step int, bucket int, bits binary"


def _pack(block: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(block)
    return sink.getvalue().to_pybytes()


def _unpack(rows: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows).read_next_batch()


def chunks_of(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """docs in rows of about chunk_chars characters each, all columns packed; written to shared storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for k, (block, texts) in enumerate(text_blocks(batches, chunk_chars)):
            n = len(words_of(texts, PLAIN, hashed=False))
            yield pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), pa.array([n], pa.int64()), pa.array([_pack(block)], pa.binary())], names=_CHUNKS.names)

    return save(docs.mapInArrow(run, _CHUNKS), "chunks")


class Chunk:
    """Words, anchors and windows of one chunk."""

    def __init__(self, rows: bytes):
        self.block = _unpack(rows)
        self.texts = self.block.column("text").to_pylist()
        ids = self.block.column("doc_id").cast(pa.int64())
        self.doc = ids.fill_null(_LAST).to_numpy(zero_copy_only=False)
        self.words: Words = words_of(self.texts, PLAIN)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of the anchor windows at cover positions of their text."""
        at, h = windows(self.words, ANCHOR)
        text = np.searchsorted(self.words.first, at, side="right") - 1
        on = np.isin((at - self.words.first[text]) % PERIOD, COVER)
        return at[on], h[on]

    def candidates(self, at: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, hash, second hash, doc) of the windows that hold a shared anchor within their first PERIOD words."""
        edge = np.zeros(len(self.words) + PERIOD + 1, np.int64)
        edge[at[shared] + 1] = 1
        total = np.cumsum(edge)
        w, h = windows(self.words, WINDOW)
        on = total[w + PERIOD] > total[w]
        w, h = w[on], h[on]
        text = np.searchsorted(self.words.first, w, side="right") - 1
        some, own = np.unique(text, return_inverse=True)
        again = words_of([self.texts[i] for i in some.tolist()], PLAIN, weights=SECOND)
        second = window_hashes(again.hash, WINDOW)[w - self.words.first[text] + again.first[own]] if len(w) else h
        return w, h, second, self.doc[text]


class Distinct:
    """Distinct hashes of a chunk by bucket, with the least and largest doc of each.

    Anchors go by 32 bits within their bucket, windows by both hashes whole.
    """

    def __init__(self, hashes: np.ndarray, docs: np.ndarray, buckets: int, second: np.ndarray | None = None):
        bucket = (hashes >> np.uint64(40)) % np.uint64(buckets)
        value = (hashes & np.uint64(0xFFFFFFFF)).astype("<u4")[:, None] if second is None else np.stack([hashes, second], 1).astype("<u8")
        order = np.lexsort((*value.T[::-1], bucket))
        bucket, value, docs = bucket[order], value[order], docs[order]
        first = np.ones(len(order), bool)
        first[1:] = (value[1:] != value[:-1]).any(1) | (bucket[1:] != bucket[:-1])
        at = np.flatnonzero(first)
        self.slot = np.empty(len(order), np.int64)
        self.slot[order] = np.cumsum(first) - 1
        self.bucket, self.value = bucket[at].astype(np.int64), value[at]
        self.least = np.minimum.reduceat(docs, at) if len(at) else docs
        self.largest = np.maximum.reduceat(docs, at) if len(at) else docs
        self.buckets, self.begin = np.unique(self.bucket, return_index=True)
        self.end = np.append(self.begin, len(self.bucket))[1:]

    def sent(self, chunk: int, docs: bool) -> Iterator[dict]:
        for b, lo, hi in zip(self.buckets.tolist(), self.begin.tolist(), self.end.tolist(), strict=True):
            least = pa.compress(self.least[lo:hi].astype("<i8").tobytes(), codec="zstd", asbytes=True) if docs else None
            yield {"bucket": b, "chunk": chunk, "hashes": self.value[lo:hi].tobytes(), "docs": least}

    def flags(self, replies: list) -> np.ndarray:
        """The buckets' bits, in the order of the distinct hashes."""
        out = np.zeros(len(self.bucket), bool)
        place = dict(zip(self.buckets.tolist(), zip(self.begin.tolist(), self.end.tolist(), strict=True), strict=True))
        for r in replies:
            lo, hi = place[r["bucket"]]
            out[lo:hi] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=hi - lo)
        return out


def _elsewhere(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk's hashes in a bucket: does another chunk have them (no docs), or have them in a smaller doc?"""
    by_docs = rows["docs"].iloc[0] is not None
    parts = [np.frombuffer(h, "<u8").reshape(-1, 2) if by_docs else np.frombuffer(h, "<u4")[:, None] for h in rows["hashes"]]
    value = np.concatenate(parts)
    order = np.lexsort(value.T[::-1])
    first = np.ones(len(order), bool)
    first[1:] = (value[order][1:] != value[order][:-1]).any(1)
    begin = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    bit = np.empty(len(order), bool)
    if by_docs:
        docs = np.concatenate([np.frombuffer(pa.decompress(d, len(p) * 8, "zstd", asbytes=True), "<i8") for d, p in zip(rows["docs"], parts, strict=True)])
        bit[order] = np.minimum.reduceat(docs[order], begin)[group] < docs[order]
    else:
        bit[order] = np.diff(np.append(begin, len(order)))[group] > 1
    ends = np.cumsum([len(p) for p in parts])
    return pd.DataFrame(
        {
            "chunk": rows["chunk"],
            "step": 2 if by_docs else 1,
            "bucket": rows["bucket"],
            "bits": [np.packbits(bit[e - len(p) : e]).tobytes() for e, p in zip(ends, parts, strict=True)],
        }
    )


def _sent_batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary())])
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["hashes"]) + len(r["docs"] or b"")
        if size > 8_000_000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _shared(chunk: Chunk, replies: list, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    at, h = chunk.anchors()
    text = np.searchsorted(chunk.words.first, at, side="right") - 1
    distinct = Distinct(h, chunk.doc[text], buckets)
    known = distinct.flags(replies) | (distinct.least < distinct.largest)
    return at, known[distinct.slot]


def _removed(chunk: Chunk, replies: list, buckets: int) -> np.ndarray:
    """For each word of the chunk: is it covered by a window that starts in a smaller document?"""
    by_step = {k: [r for r in replies if r["step"] == k] for k in (1, 2)}
    w, h, second, doc = chunk.candidates(*_shared(chunk, by_step[1], buckets))
    distinct = Distinct(h, doc, buckets, second)
    gone = distinct.flags(by_step[2])[distinct.slot] | (doc > distinct.least[distinct.slot])
    edge = np.zeros(len(chunk.words) + WINDOW + 1, np.int64)
    np.add.at(edge, w[gone], 1)
    np.add.at(edge, w[gone] + WINDOW, -1)
    return np.cumsum(edge)[: len(chunk.words)] > 0


def _judged(docs: DataFrame, chunk_chars: int) -> tuple[DataFrame, int]:
    """Chunks with their replies of both steps, and the number of buckets."""
    spark = docs.sparkSession
    chunks = chunks_of(docs, chunk_chars)
    n_words = chunks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_words * len(COVER) // PERIOD // BUCKET_HASHES)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for key, packed in zip(batch.column("chunk").to_pylist(), batch.column("rows"), strict=True):
                    chunk = Chunk(packed.as_py())
                    at, h = chunk.anchors()
                    yield from Distinct(h, at, buckets).sent(key, docs=False)

        yield from _sent_batches(rows())

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for key, packed, replies in zip(batch.column("chunk").to_pylist(), batch.column("rows"), batch.column("replies"), strict=True):
                    chunk = Chunk(packed.as_py())
                    _, h, second, doc = chunk.candidates(*_shared(chunk, replies.as_py() or [], buckets))
                    yield from Distinct(h, doc, buckets, second).sent(key, docs=True)

        yield from _sent_batches(rows())

    first = save(chunks.mapInArrow(anchors, _SENT).groupBy("bucket").applyInPandas(_elsewhere, _REPLY), "anchors")
    second = save(_with_replies(chunks, first).mapInArrow(extended, _SENT).groupBy("bucket").applyInPandas(_elsewhere, _REPLY), "windows")
    return _with_replies(chunks, first.unionAll(second)), buckets


def _with_replies(chunks: DataFrame, replies: DataFrame) -> DataFrame:
    own = replies.groupBy("chunk").agg(F.collect_list(F.struct("step", "bucket", "bits")).alias("replies"))
    return chunks.join(own, "chunk", "left").select("chunk", "rows", "replies")


def _mapped(docs: DataFrame, schema: T.StructType, make: Callable[[Chunk, np.ndarray], pa.RecordBatch], chunk_chars: int) -> DataFrame:
    judged, buckets = _judged(docs, chunk_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, replies in zip(batch.column("rows"), batch.column("replies"), strict=True):
                chunk = Chunk(packed.as_py())
                yield make(chunk, _removed(chunk, replies.as_py() or [], buckets))

    return judged.mapInArrow(run, schema)


def _kept_texts(chunk: Chunk, removed: np.ndarray) -> list[bytes]:
    buffer, first = chunk.words.buffer, chunk.words.first.tolist()
    out = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        on = ~removed[lo:hi]
        spans = zip(chunk.words.start[lo:hi][on].tolist(), chunk.words.end[lo:hi][on].tolist(), strict=True)
        out.append(b" ".join([buffer[a:b] for a, b in spans]))
    return out


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
)


def repeated_words(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per document: words, removed words, and the digest of what is kept."""

    def make(chunk: Chunk, removed: np.ndarray) -> pa.RecordBatch:
        lost = np.concatenate([[0], np.cumsum(removed)])[chunk.words.first]
        kept = [hashlib.sha256(t).hexdigest() for t in _kept_texts(chunk, removed)]
        ids = chunk.block.column("doc_id").cast(pa.int64())
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(chunk.words.first)), pa.array(np.diff(lost)), pa.array(kept, pa.string())], names=SCHEMA.names)

    return _mapped(docs.select("doc_id", "text"), SCHEMA, make, chunk_chars)


def remove_repeats(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """docs, all their columns, with texts of their kept words joined by spaces; null texts stay null."""

    def make(chunk: Chunk, removed: np.ndarray) -> pa.RecordBatch:
        kept = [None if t is None else k.decode("utf-8", "surrogatepass") for t, k in zip(chunk.texts, _kept_texts(chunk, removed), strict=True)]
        block = chunk.block
        columns = [pa.array(kept, block.schema.field(n).type) if n == "text" else block.column(n) for n in block.schema.names]
        return pa.RecordBatch.from_arrays(columns, names=block.schema.names)

    return _mapped(docs, docs.schema, make, chunk_chars)
