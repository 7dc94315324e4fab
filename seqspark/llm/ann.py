"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids and codebooks are fitted in numpy on a bounded sample of vectors
(chosen by id hash); every vector is then indexed in its COPIES nearest lists, its
code in each being the nearest codewords of its residual there.  A query visits its
nearest lists and ranks their members by asymmetric distance tables.  The best of
all lists together, ids alone, are the query's short list; only for these are
vectors fetched and exact distances taken.

How many lists are visited is found by a recall test: neighbours within the sample,
by brute force, for queries drawn from it.  In the whole table neighbours are
nearer than in a sample of it, so the test errs to more lists.

Lists are dealt to cells of a bounded number of members; a list that holds a third
of all rows is several cells.  Queries meet a cell in blocks of bounded size.  A
cell gives at most the short list's length of ids for each query.

Defined results: vectors that are null, zero, of another length than the most
common one, or that hold null or non-finite components take no part; of a query
that stands on several rows the smallest vector asks; a candidate on several rows
counts once, by its nearest vector; ties go to the smaller vec_id; where fewer
candidates exist than asked for, all are given; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save

#: Vectors that centroids and codebooks are fitted on at most.
SAMPLE = 32_768
#: Lists: this many times the root of the number of vectors, MAX_LISTS at most.
LISTS_BY_ROOT, MAX_LISTS = 4, 4096
CODEWORDS, SUB_DIMS = 256, 4
#: Lists that every vector is indexed in.
COPIES = 2
#: Queries of the recall test, and the share of their neighbours that the visited lists must hold.
TESTED, COARSE_RECALL = 512, 0.97
#: Members of a cell at most (a sixteenth of all, down to an eighth of this, so that small tables are not one task), and queries that meet it at once.
CELL_ROWS, QUERY_BLOCK = 16_384, 512
#: Length of a query's short list, as a multiple of k.
SHORT_LIST = 16


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of k clusters; an empty cluster takes a random row."""
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        n = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, weights=x[:, d], minlength=k) for d in range(x.shape[1])], 1)
        centers = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norms = (centers * centers).sum(1)
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = (norms - 2 * x[lo : lo + 4096] @ centers.T).argmin(1)
    return out


def by_nearness(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """For each row, all centers from near to far."""
    return ((centers * centers).sum(1) - 2 * x @ centers.T).argsort(1, kind="stable")


@dataclass
class Quantizer:
    centers: np.ndarray
    parts: list[np.ndarray]  # dimensions of each part
    books: list[np.ndarray]  # codewords of each part

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, seed: int = 3) -> Quantizer:
        rng = np.random.default_rng(seed)
        centers = kmeans(x, min(lists, len(x)), 12, rng)
        residual = x - centers[nearest(x, centers)]
        parts = np.array_split(np.arange(x.shape[1]), max(1, x.shape[1] // SUB_DIMS))
        some = residual[rng.choice(len(x), min(len(x), 16_384), replace=False)]
        books = [kmeans(some[:, p], min(CODEWORDS, len(some)), 8, rng) for p in parts]
        return cls(centers, parts, books)

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        """The COPIES nearest lists of each row."""
        out = np.empty((len(x), min(COPIES, len(self.centers))), np.int64)
        for lo in range(0, len(x), 4096):
            far = (self.centers * self.centers).sum(1) - 2 * x[lo : lo + 4096] @ self.centers.T
            for c in range(out.shape[1]):
                best = far.argmin(1)
                out[lo : lo + 4096, c] = best
                far[np.arange(len(far)), best] = np.inf
        return out

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        residual = x - self.centers[own]
        return np.stack([nearest(residual[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)

    def distances(self, queries: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the coded members of a list, by tables of each query's residual."""
        residual = queries - self.centers[at]
        out = np.zeros((len(queries), len(codes)), np.float32)
        for k, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            r = residual[:, p]
            table = ((r * r).sum(1)[:, None] + (b * b).sum(1) - 2 * r @ b.T).astype(np.float32)
            out += table[:, codes[:, k]]
        return out

    def probes(self, x: np.ndarray, k: int, seed: int = 5) -> int:
        """How many lists hold COARSE_RECALL of the k nearest in x of TESTED rows of x."""
        k = min(k, len(x) - 1)
        if k < 1:
            return 1
        at = np.random.default_rng(seed).choice(len(x), min(TESTED, len(x)), replace=False)
        own, norms = self.lists_of(x), (x * x).sum(1)
        needed = []
        for lo in range(0, len(at), 64):
            q = at[lo : lo + 64]
            far = norms - 2 * x[q] @ x.T
            far[np.arange(len(q)), q] = np.inf
            near = np.argpartition(far, k - 1, axis=1)[:, :k]
            order = by_nearness(x[q], self.centers)
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(order.shape[1])[None], 1)
            needed.append(np.take_along_axis(rank, own[near].reshape(len(q), -1), 1).reshape(len(q), k, -1).min(2).ravel())
        return int(np.quantile(np.concatenate(needed), COARSE_RECALL, method="higher")) + 1


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec) of the vectors that take part, as doubles, and their length."""
    v = F.col(vec_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    )
    most = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = most.n if most else 0
    return rows.where(F.size("vec") == dims), dims


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def cells(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first cell, number of cells) of each list: small lists share a cell, large ones have several."""
    first, number = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if n > rows:
            at, held = at + (held > 0), 0
            first[i], number[i] = at, -(-n // rows)
            at += int(number[i])
        else:
            if held + n > rows:
                at, held = at + 1, 0
            first[i] = at
            held += n
    return first, number


def best_of(far: np.ndarray, most: int) -> np.ndarray:
    """The places of the least finite values, at most so many, ties to the first places."""
    at = np.flatnonzero(np.isfinite(far))
    if len(at) > most:
        at = at[far[at] <= np.partition(far[at], most - 1)[most - 1]]
        at = at[np.argsort(far[at], kind="stable")[:most]]
    return at


SCHEMA = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def search(
    vectors: DataFrame,
    query_test,
    k: int = 10,
    probes: int | None = None,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """k nearest of every query among all other vectors: query_id, rank, vec_id, score.

    query_test: a condition on column `id` that tells which rows are queries.  A query
    visits `probes` lists (None: as many as the recall test asks for), and more until
    they hold enough candidates.
    """
    spark = vectors.sparkSession
    rows, dims = usable(vectors, id_col, vec_col)
    if not dims:
        return spark.createDataFrame([], SCHEMA)
    n = rows.count()
    lists = int(min(MAX_LISTS, max(1, 2 ** round(np.log2(LISTS_BY_ROOT * max(n, 1) ** 0.5)), 1)))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sample = np.unique(_matrix(drawn.column("vec").combine_chunks(), dims), axis=0)
    quantizer = Quantizer.fit(sample, lists)
    probes = quantizer.probes(sample, k) if probes is None else probes
    shared, short = spark.sparkContext.broadcast(quantizer), k * SHORT_LIST

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vec"), dims)
                for own in shared.value.lists_of(x).T:
                    codes = shared.value.encode(x, own)
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "id", "code"])

    indexed = save(rows.mapInArrow(index, "list int, id long, code binary"), "index")
    # a row per list, MAX_LISTS at most: members, and distinct ids
    held = {r.list: (r.ids, r.rows) for r in indexed.groupBy("list", "id").count().groupBy("list").agg(F.count("*").alias("ids"), F.sum("count").alias("rows")).collect()}
    sizes, rows_of = np.array([held.get(i, (0, 0)) for i in range(len(quantizer.centers))]).T
    first, number = cells(rows_of, min(CELL_ROWS, max(CELL_ROWS // 8, int(rows_of.sum()) // 16)))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                order = by_nearness(_matrix(part.column("vec"), dims), shared.value.centers)
                # members stand in COPIES lists, and the query is one of them
                enough = (np.cumsum(sizes[order], 1) > COPIES * (k + 1)).argmax(1) + 1
                enough = np.where(sizes.sum() > COPIES * (k + 1), enough, len(sizes))
                at, cell, lists = [], [], []
                for i, (o, e) in enumerate(zip(order, enough.tolist(), strict=True)):
                    own = o[: max(probes, e)]
                    by_cell: dict[int, list[int]] = {}
                    for x in own[sizes[own] > 0].tolist():
                        for c in range(number[x]):
                            by_cell.setdefault(int(first[x]) + c, []).append(x)
                    at += [i] * len(by_cell)
                    cell += by_cell.keys()
                    lists += by_cell.values()
                some = part.select(["id", "vec"]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["id", "vec", "cell", "lists"])

    queries = rows.where(query_test).groupBy("id").agg(F.min("vec").alias("vec"))
    n_blocks = -(-queries.count() // QUERY_BLOCK) or 1
    block = F.pmod(F.xxhash64(F.col("id") + 1), F.lit(n_blocks)).cast("int").alias("block")
    visits = queries.mapInArrow(visit, "id long, vec array<double>, cell int, lists array<int>").select("*", block)
    places = F.broadcast(spark.createDataFrame([(i, int(f), int(c)) for i, (f, c) in enumerate(zip(first, number, strict=True))], "list int, first int, number int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    members = indexed.join(places, "list").select("list", "id", "code", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("number"))).cast("int").alias("cell"), every)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, own = right.column("id").to_numpy(), right.column("list").to_numpy()
            code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            order = np.lexsort((own, ids))
            ids, own, code = ids[order], own[order], code[order]
            once = np.ones(len(ids), bool)  # a row that repeats with its vector is one member
            once[1:] = (ids[1:] != ids[:-1]) | (own[1:] != own[:-1]) | (code[1:] != code[:-1]).any(1)
            ids, own, code = ids[once], own[once], code[once]
            qid, q = left.column("id").to_numpy(), _matrix(left.column("vec").combine_chunks(), dims)
            visited = left.column("lists").to_pylist()
            by_list: dict[int, list[int]] = {}
            for i, ls in enumerate(visited):
                for x in ls:
                    by_list.setdefault(x, []).append(i)
            for lo in range(0, len(qid), QUERY_BLOCK):
                hi = min(lo + QUERY_BLOCK, len(qid))
                far = np.full((hi - lo, len(ids)), np.inf, np.float32)
                for x, who in by_list.items():
                    some, at = np.array([i for i in who if lo <= i < hi], np.int64), np.flatnonzero(own == x)
                    if len(some) and len(at):
                        far[np.ix_(some - lo, at)] = shared.value.distances(q[some], x, code[at])
                far[qid[lo:hi, None] == ids[None]] = np.inf
                for i in range(hi - lo):
                    best = best_of(far[i], short)
                    found.append((np.full(len(best), qid[lo + i]), ids[best], far[i][best]))
        join = [np.concatenate([f[c] for f in found]) if found else [] for c in range(3)]
        return pa.table({"query_id": pa.array(join[0], pa.int64()), "vec_id": pa.array(join[1], pa.int64()), "far": pa.array(join[2], pa.float32())})

    ranked = visits.groupBy("cell", "block").cogroup(members.groupBy("cell", "block")).applyInArrow(compare, "query_id long, vec_id long, far float")
    nearest_first = Window.partitionBy("query_id").orderBy("far", "vec_id")
    listed = ranked.withColumn("r", F.row_number().over(nearest_first)).where(F.col("r") <= COPIES * short).select("query_id", "vec_id").distinct()
    candidates = rows.select(F.col("id").alias("vec_id"), "vec").join(listed, "vec_id").join(queries.select(F.col("id").alias("query_id"), F.col("vec").alias("asked")), "query_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                off = _matrix(batch.column("vec"), dims) - _matrix(batch.column("asked"), dims)
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(np.sqrt((off * off).sum(1)))], names=["query_id", "vec_id", "score"])

    exact = candidates.select("query_id", "vec_id", "vec", "asked").mapInArrow(measure, "query_id long, vec_id long, score double")
    once = exact.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
