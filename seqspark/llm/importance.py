"""Importance resampling towards a target distribution over hashed word n-grams.

An untrained regex Split of the tokenizers library reads each text, A-Z
lower-cased, and returns its words with byte offsets.  Windows of one and two
neighbouring offset pairs are the features; the checksum of a window runs on from
the checksum of its first word, so no feature text is built.  Checksums modulo
10000 are the buckets.  Histograms of buckets over the whole corpus and over the
target texts give every bucket a gain, a document's weight is its floored mean
gain, and keyed Gumbel noise on top of the weights turns "the highest scores" into
a draw without replacement.

At scale: texts are read once and their buckets written (two bytes a feature);
each task sends one count per bucket at most.  What the driver holds is bounded
by the number of buckets, of distinct integer scores (about 10**5 whatever the
corpus) and of partitions.  Ranks come from a range partitioning with a row number
inside each range, so neither one task nor one tie holds them.

Defined results: null, empty and wordless texts have no features and weight 0;
repeated rows count and are ranked each; null ids are noised as the text '7:' and
come last among ties; very long texts are split piece by piece; empty tables give
none; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save, text_blocks, text_pieces

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
#: Everything that is no word: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` are the words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_BLOCK_CHARS = 1_000_000
#: Words of more bytes go to zlib one by one.
_SHORT = 48
_FEATURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("buckets", T.BinaryType())])
_COUNTS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
_WEIGHTS = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_features", "weight")])


def _checksum_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_TABLE = _checksum_table()


def slice_checksums(data: bytes, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """crc32 of data[start:end] for each pair of offsets, run on from the checksums `before`; one pass per byte place."""
    a = np.frombuffer(data, np.uint8)
    size = end - start
    state = ~(np.zeros(len(start), np.uint32) if before is None else before)
    left = np.flatnonzero((size > 0) & (size <= _SHORT))
    k = 0
    while len(left):
        c = state[left]
        state[left] = (c >> np.uint32(8)) ^ _TABLE[(c ^ a[start[left] + k]) & np.uint32(255)]
        k += 1
        left = left[size[left] > k]
    out = ~state
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]], int(out[i]))
    return out


class WordSplit:
    """Byte offsets of words, by the library's Split over a regular expression."""

    def __init__(self) -> None:
        from tokenizers import PreTokenizedString, Regex, pre_tokenizers

        self._text, self._split = PreTokenizedString, pre_tokenizers.Split(Regex(SEPARATORS), "removed")

    def offsets(self, text: str) -> np.ndarray:
        """(words, 2) byte offsets in the text's UTF-8."""
        parts, at = [], 0
        for piece in text_pieces(text, _BLOCK_CHARS):
            p = self._text(piece)
            self._split.pre_tokenize(p)
            parts.append(np.array([s[1] for s in p.get_splits("original", "byte")], np.int64).reshape(-1, 2) + at)
            at += len(piece.encode())
        return np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)


def feature_checksums(texts: list[str | None], split: WordSplit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, features per text, checksums of all texts' features, those of a text together)."""
    raw = [(t or "").encode().translate(_LOWER) for t in texts]
    pairs, n_words, at = [], np.zeros(len(raw), np.int64), 0
    for i, r in enumerate(raw):
        found = split.offsets(r.decode())
        n_words[i] = len(found)
        pairs.append(found + at)
        at += len(r) + 1
    data, off = b" ".join(raw) + b" ", np.concatenate([np.zeros((0, 2), np.int64), *pairs])
    one = slice_checksums(data, off[:, 0], off[:, 1])
    own = np.repeat(np.arange(len(raw)), n_words)
    first = np.flatnonzero(own[1:] == own[:-1])  # words with a next one in their text
    space = np.full(len(first), len(data) - 1)
    two = slice_checksums(data, off[first + 1, 0], off[first + 1, 1], slice_checksums(data, space, space + 1, one[first]))
    order = np.argsort(np.concatenate([own, own[first]]), kind="stable")
    return n_words, n_words + np.maximum(n_words - 1, 0), np.concatenate([one, two])[order]


def features(docs: DataFrame, doc_id: Column, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words and the buckets of each document's features (uint16, little-endian); buckets: 65536 at most."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("there must be 1 to 65536 buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = WordSplit()
        for block, texts in text_blocks(batches, _BLOCK_CHARS):
            n_words, n, sums = feature_checksums(texts, split)
            raw = (sums % np.uint32(buckets)).astype("<u2").tobytes()
            ends = (np.cumsum(n) * 2).tolist()
            cut = [raw[a:b] for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(n_words), pa.array(cut, pa.binary())], names=_FEATURES.names)

    return docs.select(doc_id.cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, _FEATURES)


def histogram(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: occurrences of features, summed inside each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("buckets").to_pylist()), "<u2"), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=_COUNTS.names)

    return found.select("buckets").mapInArrow(run, _COUNTS).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """1000 times the log of smoothed target over corpus share, floored, by bucket; takes two histograms."""
    s, t = (dict(map(tuple, h.collect())) for h in (corpus, target))  # one row a bucket
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    return [
        math.floor(1000 * math.log((t.get(b, 0) + 1.0) * (all_s + buckets) / ((s.get(b, 0) + 1.0) * (all_t + buckets))))
        for b in range(buckets)
    ]


def weigh(found: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean of the gains of a document's features."""
    held = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("buckets").to_pylist()
            n = np.array([len(r) // 2 for r in raw], np.int64)
            total = np.concatenate([[0], np.cumsum(held[np.frombuffer(b"".join(raw), "<u2")])])
            ends = np.cumsum(n)
            weight = (total[ends] - total[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n), pa.array(weight)], names=_WEIGHTS.names)

    return found.mapInArrow(run, _WEIGHTS)


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times Gumbel noise, floored, from a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def highest(rows: DataFrame, may: Column, percent: int) -> DataFrame:
    """rows with rank: 1, 2, ... by falling score, then rising doc_id, for the drawn percentage of the rows that `may` be drawn; null for others.

    rows: a table that was written (it is read several times), with score, doc_id, n_features and a distinct `uid`.
    """
    by_score = sorted(map(tuple, rows.where(may).groupBy("score").count().collect()), reverse=True)  # one row an integer score
    draw = sum(n for _, n in by_score) * percent // 100
    least, seen = None, 0
    for score, n in by_score:
        if seen >= draw:
            break
        least, seen = score, seen + n
    none = rows.withColumn("rank", F.lit(None).cast("long"))
    if least is None:
        return none
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("uid")]
    near = may & (F.col("score") >= least)
    ranged = save(rows.where(near).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    before, at = [], 0
    for r, n in sorted(map(tuple, ranged.groupBy("range").count().collect())):  # one row a partition
        before.append((r, at))
        at += n
    offsets = rows.sparkSession.createDataFrame(before, "range int, before long")
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before")
    ranked = ranged.join(F.broadcast(offsets), "range").withColumn("rank", F.when(place <= draw, place).cast("long"))
    return ranked.select(*none.columns).unionByName(none.where(~F.coalesce(near, F.lit(False))))


def resample(docs: DataFrame, target: DataFrame, seed: int = 7, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank in the draw (null: not drawn); target holds the texts to resemble."""
    found = save(features(docs, docs["doc_id"], buckets), "features")
    gain = gains(histogram(found, buckets), histogram(features(target, F.lit(None), buckets), buckets), buckets)
    scored = weigh(found, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("uid", F.monotonically_increasing_id())
    scored = save(scored, "scored")
    return highest(scored, F.col("n_words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
