"""Packing by minimum bin slack: documents into sequences of a fixed capacity.

Each task walks its documents.  Full windows are cut from long documents as they
come; what remains of each document waits in a pool.  From the pool, sequences
are filled one at a time: a bitset subset-sum programme over the pool's length
multiset finds the sum closest to the capacity, and its stages are walked back to
the count of each length.  Where the pool has no exact fill, the last gap takes
a cut from the longest remainder, and what is left at the end of a task goes into
sequences whose lengths are powers of two, which take no padding.

No rows are shuffled: a task's rows depend on its input alone, so a lost task is
simply run again.

Defined results: null and empty texts hold the end token alone; repeated rows are
packed as often as they occur; a null doc_id is carried through; an empty table
gives no rows.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_blocks
from .wordids import WordIds, word_ids

#: Characters of texts that a task encodes at once.
BLOCK_CHARS = 1_000_000

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length to take so that their sum is the largest up to capacity.

    Lengths are met from long to short, each split into powers of two of its
    count; one integer holds the reachable sums as bits.  The stages are then
    walked back from the best sum.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, stages = 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:
            take = min(part, left)
            stages.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
            if reach >> capacity & 1:
                break
        if reach >> capacity & 1:
            break
    at, out = reach.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(stages):
        if not before >> at & 1:
            at -= length * take
            out[length] += take
    return dict(out)


class Pool:
    """Remainders of documents by length: (document, start, ids) with a total of tokens."""

    def __init__(self, capacity: int):
        self.capacity, self.by_length, self.counts, self.items, self.tokens = capacity, defaultdict(deque), {}, 0, 0

    def add(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        self.by_length[n].append(piece)
        self.counts[n] = self.counts.get(n, 0) + 1
        self.items += 1
        self.tokens += n

    def take(self, n: int) -> tuple:
        piece = self.by_length[n].popleft()
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.counts[n], self.by_length[n]
        self.items -= 1
        self.tokens -= n
        return piece

    def cut(self, n: int) -> tuple:
        """n tokens off the front of the longest remainder, whose rest stays."""
        doc, start, ids, total = self.take(max(self.counts))
        if len(ids) > 4 * n:
            self.add((doc, start + n, ids[4 * n :], total))
        return doc, start, ids[: 4 * n], total

    def sequence(self, length: int) -> list[tuple]:
        """Pieces of so many tokens in all, as long as the pool has them."""
        chosen = best_fill(self.counts, length)
        out = [self.take(n) for n, k in chosen.items() for _ in range(k)]
        gap = length - sum(len(p[2]) // 4 for p in out)
        while gap and self.tokens:
            out.append(self.cut(min(gap, max(self.counts))))
            gap -= len(out[-1][2]) // 4
        return out


def pack_documents(rows: Iterator[tuple], capacity: int, pool_items: int, first_id: int) -> Iterator[tuple]:
    """rows: (doc_id, ids as bytes, end token included) in their order; yields SCHEMA's tuples."""
    pool, sequence = Pool(capacity), first_id

    def rows_of(pieces: list[tuple], sequence: int) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, at
            at += len(ids) // 4

    for doc, ids in rows:
        total = len(ids) // 4
        full = total // capacity * capacity
        for start in range(0, full, capacity):
            yield from rows_of([(doc, start, ids[4 * start : 4 * (start + capacity)], total)], sequence)
            sequence += 1
        if full < total:
            pool.add((doc, full, ids[4 * full :], total))
        while pool.items > pool_items and pool.tokens >= capacity:
            yield from rows_of(pool.sequence(capacity), sequence)
            sequence += 1
    while pool.tokens >= capacity:
        yield from rows_of(pool.sequence(capacity), sequence)
        sequence += 1
    while pool.tokens:
        yield from rows_of(pool.sequence(1 << (pool.tokens.bit_length() - 1)), sequence)
        sequence += 1


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, pool_items: int = 2048, held_bytes: int = WordIds.HELD_BYTES) -> DataFrame:
    """Pieces of docs (doc_id, text) in sequences; tokenizer is the path of a tokenizer file.

    pool_items bounds the remainders that wait in a task (at most pool_items *
    capacity tokens), held_bytes each generation of a worker's cache of words.
    sequence_id is unique over all tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = word_ids(tokenizer, held_bytes), end_id.to_bytes(4, "little")

        def rows() -> Iterator[tuple]:
            for block, texts in text_blocks(batches, BLOCK_CHARS):
                for doc, ids in zip(block.column("doc_id").to_pylist(), encoder.many(texts), strict=True):
                    yield doc, ids + end

        out: list[tuple] = []
        for row in pack_documents(rows(), capacity, pool_items, TaskContext.get().partitionId() << 32):
            out.append(row)
            if len(out) == 20_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=SCHEMA.names)
