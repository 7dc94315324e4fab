"""Repeated and shared patterns of tokens, and their genealogy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .quotations import holding

#: Rows of patterns that a task hands on together.
ROWS = 10_000


def shared_grams(lines: DataFrame, low: int = 2, high: int = 4, docs: int = 2) -> DataFrame:
    """Token n-grams found in several docs: pattern (tokens joined by spaces), length, docs, occurrences.

    Patterns of bounded length are row-local array slices, counted with partial aggregation.
    """
    one = lambda k: F.transform(F.sequence(F.lit(1), F.size("tokens") - (k - 1)), lambda i: F.array_join(F.slice("tokens", i, k), " "))
    parts = [
        lines.where(F.size("tokens") >= k).select("doc", F.explode(one(k)).alias("pattern")).groupBy("pattern", "doc").agg(F.count("*").alias("n")).withColumn("length", F.lit(k))
        for k in range(low, high + 1)
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("pattern", "length").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= docs)


def containment(patterns: DataFrame) -> DataFrame:
    """(parent, child): the child's tokens stand consecutively in the longer parent.

    All patterns are one automaton (blocks of them, if there are many), which reads
    every pattern once: linear in their lengths and in the answers, with no table of
    the parents' parts.  Repeated patterns count once; tokens hold no control characters.
    """
    own = cut(patterns.select("pattern").distinct())
    marked = F.concat(F.lit("\x1e"), F.replace("pattern", F.lit(" "), F.lit("\x1f\x1e")), F.lit("\x1f"))
    plain = lambda c: F.translate(F.replace(c, F.lit("\x1f\x1e"), F.lit(" ")), "\x1e\x1f", "")
    found = holding(own.select(marked.alias("text")), own.select(marked.alias("quote")))
    return found.select(plain("text").alias("parent"), plain("quote").alias("child"))


def reduced(edges: DataFrame) -> DataFrame:
    """Transitive reduction of a containment: edges without a pattern in between."""
    via = edges.select("parent", F.col("child").alias("mid")).join(edges.select(F.col("parent").alias("mid"), "child"), "mid")
    return edges.join(via.select("parent", "child").distinct(), ["parent", "child"], "left_anti")


def depths(edges: DataFrame, nodes: DataFrame, layers: int | None = None) -> DataFrame:
    """Longest path from a root to every node of an acyclic graph.

    layers: a bound on the longest path, where one is known (a part is shorter than
    its whole, so patterns of lengths low to high have high - low at most): that many
    joins, nothing is run.  Without it, layers are deepened and written to the
    checkpoint folder until nothing changes.
    """
    layer = nodes.select(F.col("pattern").alias("node"), F.lit(0).alias("depth"))

    def deeper(layer: DataFrame) -> DataFrame:
        pushed = edges.join(layer, F.col("parent") == F.col("node")).groupBy("child").agg((F.max("depth") + 1).alias("d"))
        return layer.join(pushed, F.col("node") == F.col("child"), "left").select("node", F.greatest("depth", F.coalesce("d", F.lit(0))).alias("depth"))

    if layers is not None:
        for _ in range(layers):
            layer = deeper(layer)
        return layer
    for _ in range(1 << 16):
        nxt = cut(deeper(layer))
        if nxt.join(layer, ["node", "depth"], "left_anti").isEmpty():
            return nxt
        layer = nxt
    raise ValueError("the graph has a cycle")


def _gram_ids(base: np.ndarray, longest: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """(size, id of the n-gram at each place), from the longest repeat down to pairs.

    Ids of sizes that are powers of two come by doubling until nothing repeats; the
    n-gram of any size in between is two of those, overlapping.
    """
    tokens = base
    powers = [base]  # of sizes 1, 2, 4 ...

    def ids(size: int) -> np.ndarray:
        j = size.bit_length() - 1
        m, own = len(tokens) - size + 1, powers[j]
        first, second = own[:m].astype(np.int64), own[size - (1 << j) : size - (1 << j) + m]
        return np.unique(first * (len(tokens) + 1) + second, return_inverse=True)[1]

    def repeats(x: np.ndarray) -> bool:
        return len(x) > 0 and len(np.unique(x)) < len(x)

    while repeats(powers[-1]) and 2 << (len(powers) - 1) <= len(tokens):
        size = 1 << len(powers)
        half = powers[-1]
        m = len(tokens) - size + 1
        powers.append(np.unique(half[:m].astype(np.int64) * (len(tokens) + 1) + half[size // 2 : size // 2 + m], return_inverse=True)[1])
    low, high = 1, min(2 << (len(powers) - 1), len(tokens)) - 1
    while low < high:  # a repeat holds shorter ones, so the longest is found by halving
        mid = (low + high + 1) // 2
        low, high = (mid, high) if repeats(ids(mid)) else (low, mid - 1)
    for size in range(low if longest is None else min(low, longest), 1, -1):
        yield size, ids(size)


def cover_of_lines(lines: list[list[str]], longest: int | None = None) -> list[tuple[str, int, int, int]]:
    """(pattern, occurrences, independent ones, tokens it covers first), by decreasing length and first place.

    A pattern is a sequence of two tokens or more that stands twice or more in the
    lines, never across them.  It is kept if an occurrence of it, an independent one, has
    a token that no kept longer one covers; kept patterns cover all their occurrences.
    Occurrences may overlap.  Lengths start at the longest repeat there is, or at
    `longest` if that is given.
    """
    tokens: list = []
    for line in lines:
        tokens += [*line, object()]  # an end that equals nothing
    ends = [i for i, t in enumerate(tokens) if not isinstance(t, str)]
    names = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    base = np.fromiter((names[t] for t in tokens), np.int64, len(tokens))
    covered = np.zeros(len(tokens), bool)
    covered[ends] = True
    out = []
    for size, grams in _gram_ids(base, longest) if len(tokens) > 1 else ():
        if covered.all():
            break
        order = np.argsort(grams, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(grams[order]) != 0]))
        end = np.append(start[1:], len(order))
        free = np.concatenate([[0], np.cumsum(~covered)])
        some = np.add.reduceat((free[size:] > free[:-size])[order], start, dtype=np.int64)  # what is covered stays so
        found = np.flatnonzero((end - start >= 2) & (some > 0))
        for g in found[np.argsort(order[start[found]])].tolist():
            at = order[start[g] : end[g]]
            spots = at[:, None] + np.arange(size)
            independent = int((~covered[spots]).any(1).sum())
            if independent:
                places = np.unique(spots)
                out.append((" ".join(tokens[at[0] : at[0] + size]), len(at), independent, int((~covered[places]).sum())))
                covered[places] = True
    return out


def greedy_cover(tokens: list[str], longest: int | None = None) -> list[tuple[str, int, int]]:
    """cover_of_lines() of one line, without the independent occurrences."""
    return [(p, n, c) for p, n, _, c in cover_of_lines([tokens], longest)]


def _covered(rows: DataFrame, column: str, longest: int | None) -> DataFrame:
    import pyarrow as pa

    doc, nested = rows.schema["doc"].dataType.simpleString(), column == "lines"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            out: list[tuple] = []

            def rows() -> pa.RecordBatch:
                own = [pa.array([r[k] for r in out], pa.string() if k == 0 else pa.int64()) for k in range(4)]  # noqa: B023
                return pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(at, pa.int64())), *own], names=["doc", "pattern", "n", "independent", "covers"])  # noqa: B023

            for i, t in enumerate(b.column(column)):
                found = cover_of_lines(t.as_py() if nested else [t.as_py()], longest)
                out += found
                at += [i] * len(found)
                if len(out) >= ROWS:
                    yield rows()
                    at.clear()
                    out.clear()
            if out:
                yield rows()

    return rows.select("doc", column).mapInArrow(run, f"doc {doc}, pattern string, n long, independent long, covers long")


def repeated_patterns(lines: DataFrame, longest: int | None = None) -> DataFrame:
    """Greedy longest-first cover of each line's token stream by its repeated patterns: order matters, so lines go through Arrow."""
    return _covered(lines, "tokens", longest).drop("independent")


def doc_patterns(lines: DataFrame, longest: int | None = 1000) -> DataFrame:
    """Greedy longest-first cover of each doc's lines by patterns repeated in it: doc, pattern, n, independent, covers.

    Each step depends on those before it, so a doc is one row of its lines in order.
    """
    whole = lines.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "tokens"))), lambda x: x["tokens"]).alias("lines"))
    return _covered(whole, "lines", longest)


def ranked_patterns(patterns: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("length").orderBy(F.desc("n"), "pattern")
    return patterns.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
