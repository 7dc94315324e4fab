"""Hypothesis operators: Morse readings, local discordance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resample import place_hash

# Letters of the international Morse code (fixed values); groups that stand for digits are unknown.
MORSE = {
    "A": ".-", "B": "-...", "C": "-.-.", "D": "-..", "E": ".", "F": "..-.", "G": "--.", "H": "....", "I": "..", "J": ".---",
    "K": "-.-", "L": ".-..", "M": "--", "N": "-.", "O": "---", "P": ".--.", "Q": "--.-", "R": ".-.", "S": "...", "T": "-",
    "U": "..-", "V": "...-", "W": ".--", "X": "-..-", "Y": "-.--", "Z": "--..",
}


def symbol_groups(text: Column, a: str, b: str, longest: int = 5) -> Column:
    """Maximal runs of two symbols, up to a length."""
    return F.filter(F.split(F.lower(text), f"[^{a}{b}]+"), lambda x: (x != "") & (F.length(x) <= longest))


def decoded(groups: Column, dot: str, dash: str) -> Column:
    """Groups read as Morse with a symbol for dot and one for dash; unknown ones are '?'."""
    table = F.create_map(*(F.lit(x) for k, v in MORSE.items() for x in (v, k)))
    return F.array_join(F.transform(groups, lambda g: F.coalesce(table[F.translate(g, dot + dash, ".-")], F.lit("?"))), "")


def language_score(text: Column, bigrams: list[str], trigrams: list[str]) -> Column:
    """(common bigrams + 3 common trigrams) / (all bigrams + 3 all trigrams), unknown characters removed; 0 under 3 characters."""
    t = F.replace(text, F.lit("?"), F.lit(""))
    n, chars = F.length(t), F.split(t, "")
    two = F.zip_with(F.slice(chars, F.lit(1), n - 1), F.slice(chars, F.lit(2), n - 1), lambda x, y: F.concat(x, y))
    three = F.zip_with(F.slice(two, F.lit(1), n - 2), F.slice(chars, F.lit(3), n - 2), lambda x, y: F.concat(x, y))
    found = lambda grams, names: F.size(F.filter(grams, lambda g: g.isin(names)))
    return F.when(n < 3, 0.0).otherwise((found(two, bigrams) + 3 * found(three, trigrams)) / ((n - 1) + 3 * (n - 2)))


def morse_test(texts: DataFrame, key: str, text: str, pairs: list[tuple[str, str]], least: int = 50) -> DataFrame:
    """Per text and symbol pair: groups, counts of both symbols, their ratio, and the reading."""
    out = None
    for a, b in pairs:
        g = symbol_groups(F.col(text), a, b)
        joined = F.array_join("g", "")
        one = texts.select(key, F.lit(a + b).alias("pair"), g.alias("g")).where(F.size("g") >= least).select(
            key, "pair", F.size("g").alias("groups"),
            (F.length(joined) - F.length(F.replace(joined, F.lit(a), F.lit("")))).alias("n1"),
            (F.length(joined) - F.length(F.replace(joined, F.lit(b), F.lit("")))).alias("n2"),
            decoded(F.col("g"), a, b).alias("reading"),
        )
        out = one if out is None else out.unionByName(one)
    return out.withColumn("ratio", F.try_divide("n1", "n2"))


def shuffled_groups(groups: DataFrame, key: str, times: int, seed: int = 42) -> DataFrame:
    """Control of a reading: the groups in random orders, and letters within them, by hash order."""
    many = groups.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    letters = lambda g, i: F.array_join(F.transform(F.array_sort(F.transform(F.split(g, ""), lambda c, j: F.struct(place_hash(F.lit(seed), F.col("perm"), F.col(key), i, j).alias("h"), c.alias("c")))), lambda x: x["c"]), "")
    keyed = F.transform("g", lambda g, i: F.struct(place_hash(F.lit(seed), F.col("perm"), F.col(key), i).alias("h"), letters(g, i).alias("g")))
    return many.select(key, "perm", F.transform(F.array_sort(keyed), lambda x: x["g"]).alias("g"))


def morse_scores(texts: DataFrame, key: str, text: str, symbols: str, bigrams: list[str], trigrams: list[str], least: int = 50, times: int = 15, seed: int = 42) -> DataFrame:
    """Every pair of symbols as dot and dash, per text: groups, n1, n2, ratio, the better polarity's score, and its z against shuffled groups.

    A text with fewer than `least` groups of a pair is skipped for it; groups of more
    than five symbols are not read.  The control shuffles groups and letters by a
    generator that the md5 of seed, text and pair seeds, and reads a group's first symbol
    in order of the alphabet as the dot.  Pairs of a text are read in one Arrow batch.
    """
    two = {(a, b): k for k, (a, b) in enumerate((a, b) for i, a in enumerate(symbols) for b in symbols[i + 1 :])}
    kind = texts.schema[key].dataType.simpleString()
    t = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key_"), F.col(key).cast("string").alias("seed_"), F.lower(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .morse import LONGEST, _groups, _table

        tables = [_table(1), _table(0)]  # the pair's first symbol as the dot, the second one
        width = np.array([max(0, c.bit_length() - 1) for c in range(2 << LONGEST)])
        pair_grams, triple_grams = _gram_numbers(bigrams, 2), _gram_numbers(trigrams, 3)
        number = {c: i for i, c in enumerate(symbols)}

        def scores(read: np.ndarray) -> np.ndarray:
            """language_score() of every row of letter numbers, 26 being unknown."""
            out = np.zeros(len(read))
            for i, row in enumerate(read):
                x = row[row < 26].astype(np.int64)
                m = len(x)
                if m >= 3:
                    d = x[:-1] * 26 + x[1:]
                    out[i] = (np.count_nonzero(pair_grams[d]) + 3 * np.count_nonzero(triple_grams[d[:-1] * 26 + x[2:]])) / ((m - 1) + 3 * (m - 2))
            return out

        for batch in batches:
            at, out = [], []
            for i, (seed_, line) in enumerate(zip(batch.column("seed_").to_pylist(), batch.column("t").to_pylist(), strict=True)):
                x = np.array([number.get(c, -1) for c in line], np.int64) if line else np.zeros(0, np.int64)
                n = np.bincount(x[x >= 0], minlength=len(symbols))
                for (a, b), k in two.items():
                    ia, ib = number[a], number[b]
                    if n[ia] + n[ib] < least:  # a group has a symbol at least
                        continue
                    codes, every = _groups(x, ia, ib)
                    if every < least:
                        continue
                    first, second = (table[codes] for table in tables)
                    sa, sb = scores(first[None])[0], scores(second[None])[0]
                    better = first if sa >= sb else second
                    words = int.from_bytes(hashlib.md5(f"{seed}|{seed_}|{a}{b}".encode("utf-8", "surrogatepass")).digest(), "big")
                    null = scores(_shuffled_readings(codes, width, tables[0], a > b, times, np.random.default_rng(words)))
                    sd = float(null.std(ddof=1)) if times > 1 else 0.0
                    best = max(sa, sb)
                    at.append(i)
                    out.append((a, b, len(codes), int(n[ia]), int(n[ib]), int(n[ia]) / int(n[ib]) if n[ib] else None, a if sa >= sb else b, "".join(_LETTERS[c] for c in better[:50]), best, float(null.mean()), sd, (best - float(null.mean())) / sd if sd > 0 else 0.0))
            held = batch.column("key_").take(pa.array(at, pa.int64()))
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([held, *(pa.array(c, ty) for c, ty in zip(columns, types, strict=True))], names=[key, *names])

    names = ["a", "b", "groups", "n1", "n2", "ratio", "dot", "reading", "score", "control", "control_sd", "z"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string(), *[pa.float64()] * 4]
    fields = "a string, b string, groups int, n1 int, n2 int, ratio double, dot string, reading string, score double, control double, control_sd double, z double"
    # texts are short rows but long work: a given number of partitions is not put together again
    dealt = t.repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key_")
    return dealt.mapInArrow(run, f"`{key}` {kind}, {fields}")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ?"


def _gram_numbers(names: list[str], n: int) -> np.ndarray:
    out = np.zeros(26**n, bool)
    for g in names:
        out[sum((ord(c) - 65) * 26 ** (n - 1 - i) for i, c in enumerate(g))] = True
    return out


def _shuffled_readings(codes: np.ndarray, width: np.ndarray, letter: np.ndarray, swapped: bool, times: int, rng: np.random.Generator) -> np.ndarray:
    """Letter numbers of so many readings of groups (1 and their bits) in random order with their symbols in random order.

    A group of both symbols is read with that which is first in the alphabet as the dot (`swapped`: the second of the pair), one of a single symbol as dots.
    """
    n = len(codes)
    wide = width[codes]
    most = int(wide.max(initial=0))
    place = np.arange(most)
    bits = np.where(place < wide[:, None], codes[:, None] >> np.maximum(wide[:, None] - 1 - place, 0) & 1, 2).astype(np.int64)
    keys = rng.random((times, n, most)) + (bits == 2)  # what is beyond a group stays at its end
    mixed = np.take_along_axis(np.broadcast_to(bits, keys.shape), np.argsort(keys, 2), 2)
    ones = (bits == 1).sum(1)
    single = (ones == 0) | (ones == wide)
    value = np.ones((times, n), np.int64)
    for k in range(most):
        on = mixed[:, :, k] < 2
        value = np.where(on, value * 2 + (1 - mixed[:, :, k] if swapped else mixed[:, :, k]), value)
    value = np.where(single, 1 << wide, value)
    order = np.argsort(rng.random((times, n)), 1)
    return letter[np.take_along_axis(value, order, 1)]


def _array(x: np.ndarray | pa.Array) -> pa.Array:
    return x if isinstance(x, pa.Array) else pa.array(x)


def _odd_places(tokens: pa.Array, window: int, low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """row, position, at, symbol and ruler of the places that differ from the ruler of a window around them, each by the first such window of its row."""
    n = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy().astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    coded = tokens.flatten().dictionary_encode()
    x = pc.fill_null(coded.indices, -1).to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    start = np.flatnonzero(row[: max(len(x) - window + 1, 0)] == row[window - 1 :])
    # with one odd place at most, the ruler stands twice among the first three
    a, b, c = (x[start + k] for k in range(3))
    ruler = np.where((a >= 0) & ((a == b) | (a == c)), a, b)
    same = sum((x[start + k] == ruler).astype(np.int64) for k in range(window))
    odd = (ruler >= 0) & (same / window >= low) & (same < window)
    start, ruler = start[odd], ruler[odd]
    place = (start[:, None] + np.arange(window)).ravel()
    start, ruler = np.repeat(start, window), np.repeat(ruler, window)
    kept = (x[place] != ruler) & (x[place] >= 0)
    place, start, ruler = place[kept], start[kept], ruler[kept]
    turn = np.lexsort((start, place))
    place, start, ruler = place[turn], start[turn], ruler[turn]
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    place, start, ruler = place[new], start[new], ruler[new]
    of = row[place]
    names = lambda codes: coded.dictionary.take(pa.array(codes, pa.int32()))
    return of, (place - first[of]).astype(np.int32), (start - first[of] + 1).astype(np.int32), names(x[place]), names(ruler)


def local_discordance(lines: DataFrame, window: int = 8, low: float = 0.85, ties: list[str] | None = None) -> DataFrame:
    """Positions that differ from the symbol which rules a full window around them, once each, by the first window.

    In a window of 8 only 7 equal symbols reach the share, so the ruling symbol is
    that of at least 7 places.  Windows are counted within a batch of lines; only the
    places found are dealt out, as lines may share a (doc, line): the first window
    counts then too, of several the one of the line that is first by `ties`, then by
    symbol and ruler.
    """
    ties = ties or []
    keys = ["doc", "line", *ties]
    rows = lines.select(*keys, "tokens")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, *found = _odd_places(batch.column("tokens"), window, low)
            held = batch.select(keys).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([*held.columns, *map(_array, found)], names=[*keys, "position", "at", "symbol", "ruler"])

    places = rows.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "position int, at int, symbol string, ruler string"]))
    first_of = Window.partitionBy("doc", "line", "position").orderBy("at", *ties, "symbol", "ruler")
    return places.withColumn("r", F.row_number().over(first_of)).where("r = 1").select("doc", "line", "position", "symbol", "ruler")


def discordant_lines(lines: DataFrame, window: int = 8, low: float = 0.85) -> DataFrame:
    """doc, line, odd: has a line of its own tokens any place that local_discordance() gives? Every line has a row."""
    rows = lines.select("doc", "line", "tokens")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = np.zeros(batch.num_rows, bool)
            odd[_odd_places(batch.column("tokens"), window, low)[0]] = True
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("line"), pa.array(odd)], names=["doc", "line", "odd"])

    return rows.mapInArrow(run, f"doc {kinds['doc']}, line {kinds['line']}, odd boolean")
