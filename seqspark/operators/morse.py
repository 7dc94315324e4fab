"""The Morse test over the text of a whole corpus, and its shuffled control from counts.

A stretch of text is a piece: per pair of symbols and polarity the first and last two
letters of its reading, how many letters it has, and the weight of its common bigrams
and trigrams.  Two pieces in a row make one, so texts are read in ranges of their
order and only pieces are put together.

A shuffled reading depends on the groups' counts alone.  A random order is one by
independent keys: halving the range of keys deals every count by a binomial, down to
blocks that a task can lay out.  No group is moved, whatever the corpus' size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hypotheses import MORSE

#: Symbols of text that a task reads at a time.
CHARS = 1 << 22
#: Groups that a block of a shuffled reading is made of, on average at most.
BLOCK = 1 << 20
#: Longest group that is read.
LONGEST = 5
#: Blocks of a control that are put together at a time.
WIDTH = 4096

_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ?", np.uint8)
_PIECE = "head string, tail string, letters long, weight long"


def _table(dash: int) -> np.ndarray:
    """Letter of a group written as 1 and then a bit per symbol (`dash` being a dash); 26: none."""
    out = np.full(2 << LONGEST, 26, np.uint8)
    for letter, code in MORSE.items():
        out[int("1" + "".join(str(dash if c == "-" else 1 - dash) for c in code), 2)] = ord(letter) - 65
    return out


def _grams(names: list[str], n: int) -> np.ndarray:
    out = np.zeros(26**n, np.bool_)
    for g in names:
        out[sum((ord(c) - 65) * 26 ** (n - 1 - i) for i, c in enumerate(g))] = 1
    return out


def _measure(read: np.ndarray, two: np.ndarray, three: np.ndarray) -> tuple[str, str, int, int]:
    """A piece from letter numbers, unknown ones left out."""
    x = read[read < 26]
    pair = x[:-1].astype(np.int16) * np.int16(26) + x[1:]
    weight = np.count_nonzero(two[pair]) + 3 * np.count_nonzero(three[pair[:-1] * np.int16(26) + x[2:]])
    return _ALPHABET[x[:2]].tobytes().decode(), _ALPHABET[x[-2:]].tobytes().decode(), len(x), int(weight)


def _groups(x: np.ndarray, a: int, b: int) -> tuple[np.ndarray, int]:
    """Groups of symbols a (0) and b (1), as 1 and their bits, those too long left out; and the number of all."""
    own = np.zeros(len(x) + 2, np.int8)
    own[1:-1] = (x == a) | (x == b)
    edge = np.diff(own)
    start = np.flatnonzero(edge == 1)
    length = np.flatnonzero(edge == -1) - start
    every = len(start)
    start, length = start[length <= LONGEST], length[length <= LONGEST]
    code = np.ones(len(start), np.uint8)
    for k in range(LONGEST):
        on = length > k
        code[on] = code[on] * 2 + (x[start[on] + k] == b)
    return code, every


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[str]:
    """Texts in order, joined by a space and cut at spaces, of about so many characters."""
    held, size = [], 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            at = 0
            while at < len(text):
                end = len(text)
                if end - at > most:
                    space = text.rfind(" ", at, at + most)
                    space = space if space >= 0 else text.find(" ", at)
                    end = space + 1 if space >= 0 else end
                held.append(text[at:end])
                size += end - at
                at = end
                if size >= most:
                    yield " ".join(held)
                    held, size = [], 0
    if held:
        yield " ".join(held)


def text_pieces(texts: DataFrame, order: list[str], text: str, symbols: str) -> Callable[[list[str], list[str]], DataFrame]:
    """For given bigrams and trigrams: part, at, pair, polarity (0: the pair's first symbol is the dot) and the piece, with the reading's first 50 characters, all groups, groups of five symbols at most by code, and the counts of both symbols."""
    kept = F.regexp_replace(F.lower(text), f"[^{symbols}]+", " ")
    rows = texts.where(F.col(text).isNotNull()).select(*order, kept.alias("text"))
    dealt = rows.repartitionByRange(*order, "text").sortWithinPartitions(*order, "text").select("text")
    pairs = list(combinations(range(len(symbols)), 2))

    def pieces(bigrams: list[str], trigrams: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            two, three, tables = _grams(bigrams, 2), _grams(trigrams, 3), [_table(1), _table(0)]
            number = np.full(256, -1, np.int8)
            number[np.frombuffer(symbols.encode(), np.uint8)] = np.arange(len(symbols))
            part = TaskContext.get().partitionId()
            for at, stretch in enumerate(_stretches(batches, CHARS)):
                x = number[np.frombuffer(stretch.encode("ascii"), np.uint8)]
                n = np.bincount(x[x >= 0], minlength=len(symbols))
                out = []
                for pair, (a, b) in enumerate(pairs):
                    codes, every = _groups(x, a, b)
                    counts = np.bincount(codes, minlength=2 << LONGEST).tolist()
                    for polarity, table in enumerate(tables):
                        read = table[codes]
                        first = _ALPHABET[read[:50]].tobytes().decode()
                        out.append((part, at, pair, polarity, *_measure(read, two, three), first, every, counts, int(n[a]), int(n[b])))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

        fields = f"part long, at long, pair long, polarity long, {_PIECE}, first string, every long, counts array<long>, n1 long, n2 long"
        names = [f.split()[0] for f in fields.split(", ")]
        return dealt.mapInArrow(run, fields)

    return pieces


def _joined(x: Column, y: Column, bigrams: list[str], trigrams: list[str]) -> Column:
    """Two pieces in a row as one: what goes over the place where they meet is in the last two letters of one and the first two of the other."""
    over = F.concat(x["tail"], y["head"])
    meet = (F.length(x["tail"]) > 0) & (F.length(y["head"]) > 0)
    pair = meet & F.concat(F.right(x["tail"], F.lit(1)), F.left(y["head"], F.lit(1))).isin(bigrams)
    triple = lambda i: meet & F.substring(over, i, 3).isin(trigrams)
    weight = pair.cast("long") + 3 * (triple(1).cast("long") + (triple(2) & (F.length(over) == 4)).cast("long"))
    return F.struct(
        F.left(F.concat(x["head"], y["head"]), F.lit(2)).alias("head"), F.right(F.concat(x["tail"], y["tail"]), F.lit(2)).alias("tail"),
        (x["letters"] + y["letters"]).alias("letters"), (x["weight"] + y["weight"] + weight).alias("weight"),
    )


def whole(pieces: DataFrame, by: list[str], bigrams: list[str], trigrams: list[str]) -> DataFrame:
    """by, head, tail, letters, weight: pieces put together in the order of (part, at), first within parts."""
    none = F.struct(F.lit("").alias("head"), F.lit("").alias("tail"), F.lit(0).cast("long").alias("letters"), F.lit(0).cast("long").alias("weight"))

    def fold(df: DataFrame, keys: list[str], at: str) -> DataFrame:
        rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), "head", "tail", "letters", "weight"))).alias("x"))
        return rows.select(*keys, F.aggregate("x", none, lambda s, p: _joined(s, p, bigrams, trigrams)).alias("x")).select(*keys, "x.*")

    return fold(fold(pieces, [*by, "part"], "at"), by, "part")


def shuffled_pieces(counts: DataFrame, symbols: str, bigrams: list[str], trigrams: list[str], times: int, seed: int) -> DataFrame:
    """pair, perm, part, at and the piece of every block of so many shuffled readings, from pair and counts (groups by code).

    Groups come in random order and their symbols too; a group of both symbols is read
    with that which is first in the alphabet as the dot, one of a single symbol as dots.
    """
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n)
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(total, F.lit(1)) / F.lit(BLOCK)))).cast("int")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), "depth").cast("long") - 1))
    perm = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    blocks = counts.where(total > 0).select("pair", "counts", depth.alias("depth")).select("*", perm.alias("perm")).select("*", block.alias("block"))
    # rows are few but long work: a given number of partitions is not put together again
    dealt = blocks.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair", "perm", "block")
    swapped = [symbols[a] > symbols[b] for a, b in combinations(range(len(symbols)), 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, three = _grams(bigrams, 2), _grams(trigrams, 3)
        letter = _table(1)
        ones = np.array([bin(c).count("1") - 1 for c in range(2 << LONGEST)])
        length = np.array([max(0, c.bit_length() - 1) for c in range(2 << LONGEST)])
        same = [np.flatnonzero((length == length[c]) & (ones == ones[c])) for c in range(2 << LONGEST)]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                n = np.array(r["counts"], np.int64)
                for level in range(r["depth"]):
                    node = r["block"] >> (r["depth"] - level)
                    low = np.random.default_rng([seed, r["pair"], r["perm"], level, node]).binomial(n, 0.5)
                    n = n - low if r["block"] >> (r["depth"] - level - 1) & 1 else low
                rng = np.random.default_rng([seed, r["pair"], r["perm"], r["depth"], r["block"], 1])
                dealt = np.zeros_like(n)
                for c in np.flatnonzero(n):
                    of = same[c]
                    dealt[of] += rng.multinomial(n[c], np.full(len(of), 1 / len(of)))
                if swapped[r["pair"]]:  # the second symbol is the dot
                    dealt = dealt[[c ^ ((1 << length[c]) - 1) for c in range(len(dealt))]]
                for k in range(1, LONGEST + 1):  # groups of one symbol
                    dealt[1 << k] += dealt[(2 << k) - 1]
                    dealt[(2 << k) - 1] = 0
                dealt[letter == 26] = 0  # unknown groups leave the others' order as it is
                own = np.repeat(letter, dealt)
                keys = rng.integers(0, 1 << 59, len(own), np.uint64) << np.uint64(5) | own
                keys.sort()  # faster than rng.permutation
                read = (keys & np.uint64(31)).astype(np.uint8)
                out.append((r["pair"], r["perm"], r["block"] // WIDTH, r["block"] % WIDTH, *_measure(read, two, three)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

    fields = f"pair long, perm long, part long, at long, {_PIECE}"
    names = [f.split()[0] for f in fields.split(", ")]
    return dealt.mapInArrow(run, fields)


def _score() -> Column:
    """Weight of common bigrams and trigrams over that of all; 0 under 3 letters."""
    m = F.col("letters")
    return F.when(m < 3, 0.0).otherwise(F.col("weight") / ((m - 1) + 3 * (m - 2)))


def corpus_test(texts: DataFrame, order: list[str], text: str, symbols: str, bigrams: list[str], trigrams: list[str], least: int = 50, times: int = 15, seed: int = 42) -> DataFrame:
    """Every pair of symbols as dot and dash over all texts in order, as one text with a space between any two.

    pair, groups (of five symbols at most), n1, n2, ratio (null without a second symbol),
    dot (that of the better polarity, the first symbol at a tie), reading (its first 50
    characters), score, control and control_sd (of `times` shuffled readings), z (0
    without spread).  A pair of fewer than `least` groups of any length is left out, null
    texts too; texts of the same order are taken by their symbols; an empty table gives
    no row.
    """
    from ..functions.lineage import cut

    pieces = cut(text_pieces(texts, order, text, symbols)(bigrams, trigrams))  # a few numbers per stretch, read three times
    keys = ["pair", "polarity"]
    sums = pieces.where("polarity = 0").groupBy("pair").agg(
        F.sum("every").alias("every"), F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.array(*(F.sum(F.col("counts")[c]) for c in range(2 << LONGEST))).alias("counts"),
    ).where(F.col("every") >= least)
    firsts = pieces.where("first != ''").select(*keys, F.struct("part", "at", "first").alias("x")).groupBy(*keys)
    # 50 stretches with a character each are enough
    first = firsts.agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("x")), 1, 50), lambda p: p["first"]), "").alias("r")).select(*keys, F.left("r", F.lit(50)).alias("reading"))
    scored = whole(pieces, keys, bigrams, trigrams).withColumn("score", _score()).join(first, keys, "left")
    best = scored.groupBy("pair").agg(F.max_by(F.struct("polarity", "score", F.coalesce("reading", F.lit("")).alias("reading")), F.struct("score", -F.col("polarity"))).alias("x"))
    null = whole(shuffled_pieces(sums.select("pair", "counts"), symbols, bigrams, trigrams, times, seed), ["pair", "perm"], bigrams, trigrams)
    control = null.withColumn("s", _score()).groupBy("pair").agg(F.avg("s").alias("control"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("control_sd"))
    names = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in combinations(symbols, 2)))
    own = names[F.col("pair").cast("int")]
    groups = F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n)
    joined = sums.join(best, "pair").join(control, "pair", "left")
    z = F.when(F.col("control_sd") > 0, (F.col("x.score") - F.col("control")) / F.col("control_sd")).otherwise(0.0)
    return joined.select(
        F.concat(own["a"], own["b"]).alias("pair"), groups.alias("groups"), "n1", "n2", F.try_divide("n1", "n2").alias("ratio"), F.when(F.col("x.polarity") == 0, own["a"]).otherwise(own["b"]).alias("dot"),
        F.col("x.reading").alias("reading"), F.col("x.score").alias("score"), F.coalesce("control", F.lit(0.0)).alias("control"), F.coalesce("control_sd", F.lit(0.0)).alias("control_sd"), z.alias("z"),
    )
