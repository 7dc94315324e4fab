"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

Every document's word shingles give a signature of COORDINATES minima and as many
more for a finer sketch; minima that are only probed are cut to a byte.  Documents
with equal shingle sets are one class first, so copies are never paired.  The
classes' signatures are posted under (coordinate, value) pairs.  Two documents at the threshold collide in
about three of four coordinates; pairs below MATCHES collisions are not retained.
So a short prefix of the coordinates is merged: a pair to retain meets in several of
their lists all but surely.  The other lists are skipped and only probed, by
comparing the two signatures.

Lists are never expanded into all pairs.  Short lists give their pairs; a long
list gives pairs with its most central member alone.  Retained pairs are confirmed
on the full shingle sets, confirmed links give components.  What may still be
missing are links between members of a long list that are by then in different
components.  In such a list only the members outside its largest component are
compared with the others, in blocks of bounded size.  Where they are many (a passage
that stands in many documents), they are posted under all COORDINATES instead: long
lists are skipped, and as a pair to retain collides MATCHES times, it meets in a short
list unless MATCHES of its coordinates or more are in skipped ones; documents with so
many skipped coordinates alone are still compared in blocks.  Long lists are joined
by list and salt.

Defined results: texts of fewer words than a shingle are one shingle; texts
without words and null texts link with nothing; rows with equal doc_id are one
document, linked by any of their texts, and share a result; a row without doc_id
links with nothing and is kept; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, save, text_blocks
from .wordarrays import PLAIN_LOWER, mix, window_hashes, words_of

SHINGLE = 5
#: Jaccard similarity of a link, as a fraction of whole numbers.
NUMERATOR, DENOMINATOR = 75, 100
#: Retained pairs collide in MATCHES of COORDINATES, and in FINE_MATCHES of all FINE minima; a pair at the
#: threshold falls short of either with a probability of about 1e-6.
COORDINATES, MATCHES = 128, 72
FINE, FINE_MATCHES = 1024, 696
#: Lists are merged for the first PREFIX coordinates; a pair at the threshold meets in fewer than
#: PREFIX_MATCHES of them with probability under 2e-7. All other lists are skipped and only probed.
PREFIX, PREFIX_MATCHES = 14, 2
#: Lists up to SHORT members give all their pairs; members of longer ones meet in blocks of BLOCK, or, if more than
#: WIDE are outside the largest component, under all coordinates.
SHORT, BLOCK, WIDE = 24, 2048, 8192

_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(0, 1 << 32, FINE, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADDENDS = _rng.integers(0, 1 << 32, FINE, dtype=np.uint64).astype(np.uint32)
_SEED = [mix(np.array([s], np.uint64))[0] for s in (1, 2)]


def shingle_sets(texts: list, length: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = words_of(texts, PLAIN_LOWER)
    h = window_hashes(words.hash, length)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= length:
            out.append(np.unique(h[a : b - length + 1]))
        elif b > a:
            out.append(window_hashes(words.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """FINE minima of a non-empty set under as many linear permutations of 32-bit values."""
    x = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    out = np.full(FINE, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 512):  # blocks that stay in cache
        part = x[lo : lo + 512]
        np.minimum(out, (part[None, :] * _FACTORS[:, None] + _ADDENDS[:, None]).min(1), out=out)
    return mix(out.astype(np.uint64)).astype(np.uint32)  # low bytes as good as high ones


_SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_id", T.BinaryType()),
        T.StructField("sketch", T.BinaryType()),
    ]
)


def _sketch(sig: np.ndarray) -> bytes:
    """The PREFIX whole values, then the low byte of all."""
    return sig[:PREFIX].astype("<u4").tobytes() + sig.astype(np.uint8).tobytes()


def _sketches(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of sketches, by rows."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.ascontiguousarray(raw[:, : 4 * PREFIX]).view("<u4"), raw[:, 4 * PREFIX :]


def _lists(values: np.ndarray) -> np.ndarray:
    """Ids of the lists of (coordinate, value), by rows of values."""
    salt = mix(np.arange(1, values.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(values.astype(np.uint64) ^ salt).view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, sketch); the last two null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, bytes] = {}  # sketches of sets met before: copies cost a digest
        for block, texts in text_blocks(batches, 1_500_000):
            sets = shingle_sets(texts)
            ids, sketches = [], []
            for s in sets:
                if not len(s):
                    ids.append(None)
                    sketches.append(None)
                    continue
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if key not in held:
                    if len(held) > 20_000:
                        held.clear()
                    held[key] = _sketch(signature(s))
                ids.append(key)
                sketches.append(held[key])
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(sketches, pa.binary())],
                names=_SIGNED.names,
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, _SIGNED)


def _batch_of_postings(values: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    lists = _lists(values)
    return pa.RecordBatch.from_arrays([pa.array(lists.ravel()), pa.array(np.repeat(nodes, lists.shape[1]))], names=["list", "node"])


def _postings(classes: DataFrame) -> DataFrame:
    """(list, node) for the prefix coordinates of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _batch_of_postings(_sketches(batch.column("sketch"))[0], batch.column("node").to_numpy())

    return classes.select("node", "sketch").mapInArrow(run, "list long, node long")


def _wide_postings(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(list, node) for all COORDINATES of the documents whose ids are nodes; their texts are signed again."""
    texts = _maybe_in(docs, nodes.select(F.col("node").alias("doc_id"))).join(nodes.select(F.col("node").alias("doc_id")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in text_blocks(batches, 1_500_000):
            own = [(i, s) for i, s in zip(block.column("doc_id").to_pylist(), shingle_sets(rows), strict=True) if len(s)]
            if own:
                yield _batch_of_postings(np.stack([signature(s)[:COORDINATES] for _, s in own]), np.array([i for i, _ in own]))

    return texts.mapInArrow(run, "list long, node long").distinct()


def _pairs_of_lists(lists: DataFrame) -> DataFrame:
    """(a, b, met): all pairs of members of short lists (list, node), and in how many of them they meet."""
    members = lists.groupBy("list").agg(F.array_sort(F.collect_set("node")).alias("m"))
    return (
        members.select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x AS a, y AS b))))")).alias("p"))
        .groupBy("p.a", "p.b")
        .agg(F.count("*").alias("met"))
    )


def _salts(size):
    """Keys that the members of a list of so many are dealt to."""
    return F.ceil(size / BLOCK).cast("int")


def _by_list(members: DataFrame, lists: DataFrame) -> DataFrame:
    """members (list, node, size, ...) joined with one row of each list, by list and salt."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node"), _salts(F.col("size"))).cast("int"))
    return salted.join(lists.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(F.col("size")) - 1))).drop("size"), ["list", "salt"]).drop("salt")


def _retained(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose sketches collide often enough and whose sizes allow a link."""
    own = classes.select("node", "n_shingles", "sketch")
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa")), "a").join(
        own.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb")), "b"
    )
    sizes = F.least("na", "nb") * DENOMINATOR >= F.greatest("na", "nb") * NUMERATOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                if part.num_rows:
                    yield part.select(["a", "b"]).filter(pa.array(alike(_sketches(part.column("sa"))[1], _sketches(part.column("sb"))[1])))

    return both.where(sizes).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def alike(sa: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """Rows of minima that collide in MATCHES coordinates and FINE_MATCHES of all."""
    same = sa == sb
    return (same[:, :COORDINATES].sum(1) >= MATCHES) & (same.sum(1) >= FINE_MATCHES)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * shared >= NUMERATOR * (len(a) + len(b) - shared)


#: Bits of the filter that keeps texts without any pair out of the shuffle; its size is fixed.
FILTER_BITS = 1 << 24


def _id_filter(ids: DataFrame):
    """A broadcast bitmap of hashed ids (at most FILTER_BITS / 64 rows reach the driver)."""
    words = (
        ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit"))
        .groupBy(F.shiftright("bit", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return ids.sparkSession.sparkContext.broadcast(bitmap)


def _maybe_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the documents whose id is in ids, and few others."""
    bitmap = _id_filter(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            on = bitmap.value[bit >> 6].view(np.uint64) >> (bit & 63).astype(np.uint64) & np.uint64(1) == 1
            yield batch.select(["doc_id", "text"]).filter(pa.array(on))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return rows.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))).mapInArrow(run, "doc_id long, text string")


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of doc ids that are links on their full shingle sets."""
    some = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    # a doc_id with several texts has several sets
    texts = _maybe_in(docs, some).join(some, "doc_id").groupBy("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")).agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in text_blocks(batches, 1_500_000):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(rows)], pa.binary())], names=["node", "shingles"])

    sets = save(texts.mapInArrow(run, "node long, shingles binary"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"
    )

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [linked(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    out = save(both.select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long").distinct(), "links")
    discard(sets)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links (a, b): the least node reachable.

    Rounds of large-star and small-star, each written to shared storage, until a
    round changes nothing; every round groups by node with bounded values.
    """
    edges = save(links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct(), "edges")
    before = None
    while True:
        both = edges.select(F.col("low").alias("n"), F.col("high").alias("m")).unionAll(edges.select("high", "low"))
        root = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("root"))
        large = both.join(root, "n").where("m > n").select(F.col("root").alias("low"), F.col("m").alias("high")).where("low < high").distinct()
        down = large.groupBy("high").agg(F.min("low").alias("root"))
        small = large.join(down, "high")
        step = (
            small.select(F.col("root").alias("low"), "high")
            .unionAll(small.where("low > root").select(F.col("root").alias("low"), F.col("low").alias("high")))
            .distinct()
        )
        old, edges = edges, save(step, "edges")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionAll(
                edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
            )
        before = now


def _crossing(long_lists: DataFrame, classes: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Retained pairs (a, b) of members of one long list that are in different components; None if there is no such list."""
    named = long_lists.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # lists whose members are all in one component by now are done
    open_ = named.groupBy("list").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("list")
    named = save(named.join(open_, "list", "left_semi"), "named")
    parts = named.groupBy("list", "component").agg(F.count("*").alias("n"))
    mixed = save(
        parts.groupBy("list")
        .agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("outside"), F.sum("n").alias("size"), F.count("*").alias("parts"))
        .where("parts > 1"),
        "mixed",
    )
    if mixed.isEmpty():
        return None
    classes = classes.join(named.select("node").distinct(), "node", "left_semi")
    members = save(_by_list(named, mixed).withColumn("out", F.col("component") != F.col("main")).select("list", "node", "component", "out", "outside", "size"), "members")
    found = _in_blocks(members.where(F.col("outside") <= WIDE), classes)
    many = members.where(F.col("outside") > WIDE)
    if not many.isEmpty():
        wide, full = _under_all_coordinates(many.select("node", "component").distinct(), classes, docs)
        some = many.join(full, "node")
        again = _by_list(some, some.groupBy("list").agg(F.sum(F.col("out").cast("int")).alias("left_out"), F.first("size").alias("size"), F.count("*").alias("left")))
        found = found.unionAll(wide).unionAll(_in_blocks(again.select("list", "node", "component", "out", F.col("left_out").alias("outside"), F.col("left").alias("size")), classes))
    return found.distinct()


def _under_all_coordinates(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Retained pairs of nodes (node, component) that meet in a short list of any coordinate, and the nodes that skip MATCHES lists or more."""
    postings = save(_wide_postings(docs, nodes), "wide")
    lists = save(postings.join(postings.groupBy("list").agg(F.count("*").alias("size")).where("size > 1"), "list"), "wide_lists")
    skipped = save(lists.where(F.col("size") > SHORT).groupBy("node").agg(F.count("*").alias("lists")), "skipped")
    met = _pairs_of_lists(lists.where(F.col("size") <= SHORT))
    for side in ("a", "b"):
        met = met.join(skipped.select(F.col("node").alias(side), F.col("lists").alias(f"l{side}")), side, "left")
        met = met.join(nodes.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side)
    hopeful = met.where((F.col("ca") != F.col("cb")) & (F.col("met") + F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0))) >= MATCHES))
    pairs = save(_retained(hopeful.select("a", "b"), classes), "wide_pairs")
    discard(postings, lists)
    return pairs, skipped.where(F.col("lists") >= MATCHES).select("node")


def _in_blocks(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Retained pairs across components of lists' members (list, node, component, out, outside, size).

    Members that are `out` of their list's largest component are compared with all:
    a block of the former and one of the latter are a group.  A pair is given by the
    first list of the prefix in which it meets.
    """
    left = F.greatest(F.lit(1), F.ceil(F.col("outside") / BLOCK).cast("int"))
    right = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK).cast("int"))
    own = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = members.withColumn("own_x", own(left)).withColumn("own_y", own(right))
    # a member is asked in all groups of its block of members; one that asks is in all groups of its block of those, too
    asked = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), left - 1))).select("list", "node", "component", "x", F.col("own_y").alias("y"), (F.col("out") & (F.col("x") == F.col("own_x"))).alias("asks"), F.lit(True).alias("asked"))
    asking = dealt.where(F.col("out") & (right > 1)).withColumn("y", F.explode(F.sequence(F.lit(0), right - 1))).where("y <> own_y")
    every = asked.unionAll(asking.select("list", "node", "component", F.col("own_x").alias("x"), "y", F.lit(True).alias("asks"), F.lit(False).alias("asked")))
    rows = every.join(classes.select("node", "n_shingles", "sketch"), "node")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        node, comp, n = (table.column(c).to_numpy() for c in ("node", "component", "n_shingles"))
        head, minima = _sketches(table.column("sketch"))
        here = int(np.flatnonzero((_lists(head) == key[0].as_py()).any(0))[0])
        asks, asked = (table.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "asked"))
        both = np.isin(node, node[asks])  # of two that ask in this block, the smaller one does
        others = np.flatnonzero(asked)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(asks).tolist():
            js = others[(comp[others] != comp[i]) & (~both[others] | (node[others] > node[i]))]
            js = js[np.minimum(n[js], n[i]) * DENOMINATOR >= np.maximum(n[js], n[i]) * NUMERATOR]
            if here:
                js = js[~(head[js, :here] == head[i, :here]).any(1)]
            if len(js):
                js = js[alike(minima[i][None], minima[js])]
                found.append((np.full(len(js), i), js))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        a, b = node[i], node[j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rows.select("list", "x", "y", "asks", "asked", "node", "component", "n_shingles", "sketch").groupBy("list", "x", "y").applyInArrow(compare, "a long, b long")


def near_components(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept (is it the least id of its component)."""
    whole = save(signed(docs), "signed")
    own = save(whole.select("doc_id", "n_shingles", "set_id"), "own")
    # the least document of each set stands for it; ids alone are reduced
    chosen = save(own.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node")), "chosen")
    one = whole.where("set_id is not null").join(chosen.select("set_id", F.col("node").alias("doc_id")), ["set_id", "doc_id"])
    classes = save(one.select(F.col("doc_id").alias("node"), "set_id", "n_shingles", "sketch").dropDuplicates(["node", "set_id"]), "classes")
    discard(whole)
    # rows of one doc_id are one document: their sets are linked
    repeats = save(own.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeats")
    some = not repeats.isEmpty()
    same = None
    if some:
        nodes = own.join(repeats, "doc_id").join(chosen, "set_id").select("doc_id", "node").distinct()
        same = save(nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a < node").select("a", F.col("node").alias("b")).distinct(), "same")
    labels = class_components(classes, docs, same)
    discard(classes)
    by_set = chosen.join(labels, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    rows = own.join(by_set, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component"))
    if some:
        rows = save(rows, "rows")
        shared = rows.join(repeats, "doc_id").groupBy("doc_id").agg(F.min("component").alias("shared"))
        rows = rows.join(shared, "doc_id", "left").withColumn("component", F.coalesce("shared", "component"))
    return rows.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def class_components(classes: DataFrame, docs: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """(node, component) of the classes (node, n_shingles, sketch) that have links; docs holds their texts, same more links (a, b)."""
    # lists of one member give no pair; the counts are combined before they are moved
    postings = save(_postings(classes), "postings")
    sizes = postings.groupBy("list").agg(F.count("*").alias("size")).where("size > 1")
    lists = save(postings.join(sizes, "list"), "lists")
    discard(postings)
    short_pairs = _pairs_of_lists(lists.where(F.col("size") <= SHORT))
    long_lists = save(lists.where(F.col("size") > SHORT), "long")
    # the most central member: that with most company over all its long lists
    company = long_lists.groupBy("node").agg(F.sum("size").alias("company"))
    ranked = long_lists.join(company, "node")
    center = ranked.groupBy("list").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("center"), F.max("size").alias("size"))
    star = _by_list(long_lists, center).where("node <> center").select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b"))
    # pairs that cannot reach enough collisions in the prefix, their long lists counted in full, are skipped
    in_long = save(long_lists.groupBy("node").agg(F.count("*").alias("lists")), "in_long")
    more = F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    hopeful = (
        short_pairs.join(in_long.select(F.col("node").alias("a"), F.col("lists").alias("la")), "a", "left")
        .join(in_long.select(F.col("node").alias("b"), F.col("lists").alias("lb")), "b", "left")
        .where(F.col("met") + more >= PREFIX_MATCHES)
        .select("a", "b")
    )
    met = save(hopeful.unionAll(star).distinct(), "met")
    pairs = save(_retained(met, classes), "pairs")
    discard(lists, met, in_long)
    links = _confirmed(pairs, docs)
    if same is not None:
        links = links.unionAll(same)
    labels = save(components(links), "labels")
    if long_lists.isEmpty():
        return labels
    found = _crossing(long_lists, classes, labels, docs)
    if found is None:
        return labels
    crossing = save(found.join(pairs, ["a", "b"], "left_anti"), "crossing")
    discard(long_lists, pairs)
    if crossing.isEmpty():
        return labels
    return save(components(links.unionAll(_confirmed(crossing, docs))), "labels")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, whose doc_id is the least of its component."""
    kept = near_components(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(docs.columns)
    return named.unionAll(docs.where("doc_id is null"))
