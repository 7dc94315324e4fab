"""Benchmark decontamination with suffix arrays of the training text.

Every task turns its documents into shards of words, and each shard into a
suffix array: suffixes sorted by word hash, by prefix doubling to the depth of a
window.  The windows that begin the suffixes of the benchmark are searched for by
bisection, equal ones once; a window's places are one interval of the array.  Words
are hit by place, items by sets of windows, so text that repeats itself costs no
more than other text.  Longest matches start from places whose preceding words
differ, and get their lengths by halving steps over hashes of 2**k words.

The benchmark travels to the tasks in blocks of a bounded size, one broadcast at a
time; with several blocks, each pass writes what it found, and the parts are united
per document row.  Words are compared by 64-bit hashes.

Defined results: a null text has no words; an item without words has no window
and one with fewer words than `window` is one window as a whole; repeated rows of
documents give a row each; items that share an item_id count once; empty tables
give no rows (no documents) or clean rows (no items).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, save, text_blocks
from .wordarrays import ALNUM_LOWER, mix, window_hashes, words_of

WINDOW = 10
#: Characters of benchmark text that one pass broadcasts.
BLOCK_CHARS = 8_000_000


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `words` in the order of their suffixes' first `depth` words (or more).

    Prefix doubling; in every round only suffixes that still tie are sorted again.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    new = np.ones(n, bool)
    new[1:] = words[order[1:]] != words[order[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    width = 1
    while width < depth:
        last = np.append(new[1:], True)
        tied = np.flatnonzero(~(new & last))  # slots of `order` in groups of several
        if not len(tied):
            break
        at = order[tied]
        group = rank[at]
        follow = rank[np.minimum(at + width, n)]
        turn = np.lexsort((follow, group))
        order[tied] = at[turn]
        group, follow = group[turn], follow[turn]
        first = np.ones(len(tied), bool)
        first[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        new[tied] = first
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        width *= 2
    return order


def _compare(words: np.ndarray, at: np.ndarray, test: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sign of words[at:] against test[start:start + length], for each entry; 0 where the latter is a prefix."""
    sign = np.zeros(len(at), np.int8)
    left = np.arange(len(at))
    k, n = 0, len(words)
    while len(left):
        left = left[length[left] > k]
        p = at[left] + k
        short = p >= n
        sign[left[short]] = -1
        left, p = left[~short], p[~short]
        a, b = words[p], test[start[left] + k]
        sign[left[a < b]] = -1
        sign[left[a > b]] = 1
        left = left[a == b]
        k += 1
    return sign


def bisect(words: np.ndarray, order: np.ndarray, test: np.ndarray, start: np.ndarray, length: np.ndarray, right: bool) -> np.ndarray:
    """For each test slice, the first slot of `order` whose suffix is not below it (right: above it)."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        sign = _compare(words, order[mid], test, start[open_], length[open_])
        below = sign <= 0 if right else sign < 0
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]


@dataclass
class Items:
    """Benchmark items as one word array, and their distinct windows.

    Places are windows as they stand, in the order of the distinct ones: those of
    window w are places first[w]:first[w + 1].  Windows in the same items share a set.
    """

    ids: list[str]
    words: np.ndarray
    bounds: np.ndarray  # words of item i are bounds[i]:bounds[i + 1]
    start: np.ndarray  # of each distinct window, somewhere
    length: np.ndarray
    first: np.ndarray
    place: np.ndarray
    place_item: np.ndarray
    set_of: np.ndarray
    sets: list[frozenset[str]]

    @classmethod
    def of(cls, rows: list[tuple], window: int) -> Items:
        found = words_of([text for _, text in rows], ALNUM_LOWER)
        words, bounds = np.maximum(found.hash, 1), found.first
        sizes = np.diff(bounds)
        width = np.minimum(sizes, window)
        room = np.where(sizes > 0, sizes - width + 1, 0)
        item = np.repeat(np.arange(len(rows)), room)
        place = np.repeat(bounds[:-1], room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        length = width[item]
        start, lengths, group, known = [], [], np.zeros(len(place), np.int64), 0
        for w in np.unique(length).tolist():
            some = np.flatnonzero(length == w)
            rep, own = _groups(words, place[some], w)
            start.append(place[some][rep])
            lengths.append(np.full(len(rep), w))
            group[some] = known + own
            known += len(rep)
        order = np.argsort(group, kind="stable")
        first = np.searchsorted(group[order], np.arange(known + 1))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        ids = [str(i) for i, _ in rows]
        sets: dict[bytes, int] = {}
        members: list[frozenset[str]] = []
        set_of = np.zeros(known, np.int64)
        own_items = item[order]
        for g, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            some = np.unique(own_items[lo:hi])
            key = some.tobytes()
            if key not in sets:
                sets[key] = len(members)
                members.append(frozenset(ids[i] for i in some.tolist()))
            set_of[g] = sets[key]
        return cls(ids, words, bounds, join(start), join(lengths), first, place[order], own_items, set_of, members)


def _groups(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal windows: the index of one window of each group, and each window's group."""
    _, rep, own = np.unique(window_hashes(words, width)[at], return_index=True, return_inverse=True)
    if all((words[at + k] == words[at[rep][own] + k]).all() for k in range(width)):
        return rep, own
    rows = np.stack([words[at + k] for k in range(width)], 1)  # windows of one hash that differ
    _, rep, own = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return rep, own.ravel()


@dataclass
class Shard:
    """Texts as words that end in a word of hash 0 each, with the places of the windows that were found."""

    n_words: np.ndarray
    words: np.ndarray
    begin: np.ndarray  # first word of each text
    order: np.ndarray
    window: np.ndarray  # distinct windows that stand here
    lo: np.ndarray  # their intervals of the suffix array
    hi: np.ndarray

    @classmethod
    def of(cls, texts: list, items: Items) -> Shard:
        found = words_of(texts, ALNUM_LOWER)
        words = np.zeros(len(found) + len(texts), np.uint64)
        words[np.arange(len(found)) + found.text_of()] = np.maximum(found.hash, 1)
        begin = found.first[:-1] + np.arange(len(texts))
        none = np.zeros(0, np.int64)
        if not len(items.start) or not len(found):
            return cls(np.diff(found.first), words, begin, none, none, none, none)
        order = suffix_array(words, int(items.length.max()))
        lo = bisect(words, order, items.words, items.start, items.length, right=False)
        here = np.flatnonzero(lo < len(order))
        here = here[_compare(words, order[lo[here]], items.words, items.start[here], items.length[here]) == 0]
        hi = bisect(words, order, items.words, items.start[here], items.length[here], right=True)
        return cls(np.diff(found.first), words, begin, order, here, lo[here], hi)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, distinct window) wherever one stands: at most one for each word and length of window."""
        count = self.hi - self.lo
        slot = np.repeat(self.lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return self.order[slot], np.repeat(self.window, count)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, side="right") - 1

    def hits(self, items: Items) -> np.ndarray:
        """For each word: does it stand in a window?"""
        at, window = self.places()
        edge = np.bincount(at, minlength=len(self.words) + 1) - np.bincount(at + items.length[window], minlength=len(self.words) + 1)
        return np.cumsum(edge[:-1]) > 0

    def per_text(self, hit: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(hit)])
        return total[self.begin + self.n_words] - total[self.begin]

    def items(self, items: Items) -> dict[int, frozenset[str]]:
        """Ids of the items of each text that has any."""
        at, window = self.places()
        key = np.unique(self.text_of(at) * len(items.sets) + items.set_of[window])
        out: dict[int, frozenset[str]] = {}
        for t, k in zip((key // len(items.sets)).tolist(), (key % len(items.sets)).tolist(), strict=True):
            out[t] = out[t] | items.sets[k] if t in out else items.sets[k]
        return out

    def matches(self, items: Items, most: int = 1 << 20) -> Iterator[tuple]:
        """Longest matches, about `most` at a time: (text, first word, item, first word in the item, words).

        A match starts where the words before differ, or a text or an item begins.
        """
        if not len(self.window):
            return
        item_first = items.place == items.bounds[items.place_item]
        before_item = np.where(item_first, 0, items.words[np.maximum(items.place - 1, 0)])
        levels = _levels(self.words, items)
        held, size = [], 0
        for w, lo, hi in zip(self.window.tolist(), self.lo.tolist(), self.hi.tolist(), strict=True):
            at = self.order[lo:hi]
            before = np.where(at > 0, self.words[np.maximum(at - 1, 0)], 0)
            places = np.arange(items.first[w], items.first[w + 1])
            for word in np.unique(before_item[places]).tolist():
                own = places[before_item[places] == word]
                other = at if word == 0 else at[before != word]
                for k in range(0, len(own), max(1, most // max(len(other), 1))):
                    some = own[k : k + max(1, most // max(len(other), 1))]
                    held.append((np.tile(other, len(some)), np.repeat(some, len(other))))
                    size += len(some) * len(other)
                    if size >= most:
                        yield self._measured(held, items, levels)
                        held, size = [], 0
        if size:
            yield self._measured(held, items, levels)

    def _measured(self, held: list, items: Items, levels: list) -> tuple:
        at, place = (np.concatenate([h[c] for h in held]) for c in (0, 1))
        start, item = items.place[place], items.place_item[place]
        room = items.bounds[item + 1] - start
        length = np.zeros(len(at), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            here, there = levels[k]
            some = np.flatnonzero((length + (1 << k) <= room) & (at + length + (1 << k) <= len(self.words)))
            same = here[at[some] + length[some]] == there[start[some] + length[some]]
            length[some[same]] += 1 << k
        text = self.text_of(at)
        return text, at - self.begin[text], item, start - items.bounds[item], length


def _levels(words: np.ndarray, items: Items) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the 2**k words from each word on, of both arrays, up to the longest item."""
    out, width = [(words, items.words)], 1
    most = int(np.diff(items.bounds).max())
    step = lambda h: mix(h[: len(h) - width] * np.uint64(0x9E3779B97F4A7C15) + h[width:])
    while 2 * width <= most and 2 * width <= len(words):
        out.append(tuple(map(step, out[-1])))
        width *= 2
    return out


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
    ]
)
MATCHES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("doc_word", T.LongType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("item_word", T.LongType()),
        T.StructField("words", T.LongType()),
    ]
)
_SHARD_CHARS = 1_000_000


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """The benchmark's distinct rows in blocks of about so many characters: by far most often one."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block_chars) or 1
    return [rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _broadcast(block: DataFrame, window: int):
    rows = sorted(((r.item_id, r.text) for r in block.collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1] or ""))
    return block.sparkSession.sparkContext.broadcast(Items.of(rows, window))


def _items_sha(ids: frozenset[str] | set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _spans(hit: np.ndarray) -> bytes:
    """Runs of hit words as (first, end) pairs."""
    return np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).astype("<i8").tobytes()


def _rows(ids: pa.Array, n_words: list, n_hit: list, items: list[frozenset]) -> pa.RecordBatch:
    digest: dict[frozenset, str] = {}
    for i in items:
        if i not in digest:
            digest[i] = _items_sha(i)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([digest[i] for i in items], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())],
        names=SCHEMA.names,
    )


def overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: words, words inside benchmark windows, items found (a digest of their ids), contaminated."""
    blocks = item_blocks(benchmark, block_chars)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    if len(blocks) > 1:
        return _overlap_in_passes(rows, blocks, window)
    shared = _broadcast(blocks[0], window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for block, texts in text_blocks(batches, _SHARD_CHARS):
            shard = Shard.of(texts, items)
            found = shard.items(items)
            yield _rows(block.column("doc_id"), shard.n_words.tolist(), shard.per_text(shard.hits(items)).tolist(), [found.get(t, frozenset()) for t in range(len(texts))])

    return rows.mapInArrow(run, SCHEMA)


def _overlap_in_passes(rows: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """overlap() with one block of the benchmark after another: spans and items per row number are written, then united."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in text_blocks(batches, _SHARD_CHARS):
            n = np.diff(words_of(texts, ALNUM_LOWER, hashed=False).first)
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(n)], names=[*block.schema.names, "n_words"])

    numbered = save(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(count, "doc_id long, text string, row long, n_words long"), "numbered")
    parts = []
    for part in blocks:
        shared = _broadcast(part, window)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for block, texts in text_blocks(batches, _SHARD_CHARS):
                shard = Shard.of(texts, items)
                hit, found = shard.hits(items), shard.items(items)
                at = sorted(found)
                spans = [_spans(hit[shard.begin[t] : shard.begin[t] + shard.n_words[t]]) for t in at]
                number = block.column("row").take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([number, pa.array(spans, pa.binary()), pa.array([sorted(found[t]) for t in at], pa.list_(pa.string()))], names=["row", "spans", "items"])

        parts.append(save(numbered.select("row", "text").mapInArrow(run, "row long, spans binary, items array<string>"), "spans"))
        shared.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    united = every.groupBy("row").agg(F.collect_list("spans").alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit = []
            for spans in batch.column("spans").to_pylist():
                n, end = 0, 0
                for a, b in sorted(tuple(x) for s in spans or [] for x in np.frombuffer(s, "<i8").reshape(-1, 2).tolist()):
                    n += max(0, b - max(a, end))
                    end = max(end, b)
                n_hit.append(n)
            yield _rows(batch.column("doc_id"), batch.column("n_words").to_pylist(), n_hit, [frozenset(i or ()) for i in batch.column("items").to_pylist()])

    return numbered.select("doc_id", "row", "n_words").join(united, "row", "left").mapInArrow(unite, SCHEMA)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Longest verbatim matches of at least a window: where they stand in the document and in the item."""
    rows, parts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), []
    blocks = item_blocks(benchmark, block_chars)
    for part in blocks:
        shared = _broadcast(part, window)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for block, texts in text_blocks(batches, _SHARD_CHARS):
                ids = block.column("doc_id")
                for text, word, item, item_word, length in Shard.of(texts, items).matches(items):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(text)), pa.array(word), pa.array([items.ids[i] for i in item.tolist()], pa.string()), pa.array(item_word), pa.array(length)],
                        names=MATCHES.names,
                    )

        found = rows.mapInArrow(run, MATCHES)
        if len(blocks) > 1:
            found = save(found, "matches")
            shared.destroy()
        parts.append(found)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    return every


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all their columns, that hold no window of an item."""
    blocks, left, before = item_blocks(benchmark, block_chars), docs, None
    for part in blocks:
        shared = _broadcast(part, window)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for block, texts in text_blocks(batches, _SHARD_CHARS):
                shard = Shard.of(texts, shared.value)
                yield block.filter(pa.array(shard.per_text(shard.hits(shared.value)) == 0))

        left = left.mapInArrow(run, docs.schema)
        if len(blocks) > 1:
            left = save(left, "clean")
            shared.destroy()
            if before is not None:
                discard(before)
            before = left
    return left
