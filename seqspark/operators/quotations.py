"""Literal quotations in lines: equal, a quotation inside a line, or a line inside a quotation.

Quotations inside lines are found by an Aho-Corasick automaton over a block of
quotations, broadcast, in one pass of Arrow batches without a shuffle of the lines.
Lines equal to a quotation or inside one are found by an equality join: a line's key
is its beginning, a quotation's keys are all its parts of that length.  No pair of a
line and a quotation is compared that shares no key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a key.
KEY = 16
#: Keys (two numbers and 16 characters each) that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000
#: Characters of quotations in one automaton (some 80 bytes each in every worker). Further blocks take further passes.
BLOCK_CHARS = 1_000_000

_BUILT: dict[str, object] = {}


def _automaton(name: str, quotes: list[str]):
    """The worker's automaton of a block; the one before is dropped."""
    if name not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        found = ahocorasick.Automaton()
        for i, q in enumerate(quotes):
            found.add_word(q, i)
        found.make_automaton()
        _BUILT[name] = found
    return _BUILT[name]


def quotation_blocks(quotes: DataFrame, most: int) -> Iterator[list[str]]:
    """Distinct quotations in lists of so many characters; one that is longer is a list of its own. The driver holds one at a time."""
    block, size = [], 0
    for (q,) in quotes.select("quote").distinct().toLocalIterator():
        if block and size + len(q) > most:
            yield block
            block, size = [], 0
        block.append(q)
        size += len(q)
    if block:
        yield block


def holding(lines: DataFrame, quotes: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """lines' columns and `quote` for every distinct quotation that stands inside a longer line, once each; quotes are not empty."""
    schema = T.StructType([*lines.schema, T.StructField("quote", T.StringType())])
    names, found = schema.names, None
    for block in quotation_blocks(quotes.where(F.length("quote") > 0), block_chars):
        shared = lines.sparkSession.sparkContext.broadcast(block)
        name, least = f"{lines.sparkSession.sparkContext.applicationId}-{shared._jbroadcast.id()}", min(map(len, block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name, least=least) -> Iterator[pa.RecordBatch]:
            block = shared.value
            automaton = _automaton(name, block)
            for batch in batches:
                rows, held = [], []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    if text is None or len(text) <= least:
                        continue
                    for i in sorted({i for _, i in automaton.iter(text)}):
                        if len(block[i]) < len(text):
                            rows.append(k)
                            held.append(block[i])
                if rows:
                    part = batch.take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.string())], names=names)

        part = lines.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return lines.withColumn("quote", F.lit(None).cast("string")).where("false") if found is None else found


def keys(quotes: DataFrame, part_over: int, least: int) -> DataFrame:
    """of (a hash of the quotation), key: its beginning; of quotations over part_over characters every part of least to KEY characters too."""
    q, n = F.col("quote"), F.length("quote")
    sizes = F.sequence(F.lit(min(least, KEY)), F.lit(KEY))
    parts = F.flatten(F.transform(sizes, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(n - w + 1, F.lit(1))), lambda p: F.substring(q, p, w))))
    every = F.when(n > part_over, F.array_union(F.array(F.substring(q, 1, KEY)), parts)).otherwise(F.array(F.substring(q, 1, KEY)))
    return quotes.select("quote").distinct().select(F.xxhash64("quote").alias("of"), F.explode(F.array_distinct(every)).alias("key"))


def quotation_matches(lines: DataFrame, quotes: DataFrame, part_over: int = 15, least: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Pairs of a line (`text`) and a quotation (`quote`), with the columns of both and kind: IDENTICA (equal) or SUBCADENA (one inside the other).

    Parts count for quotations of more than part_over characters only, lines of fewer
    than `least` characters take no part.  Nulls match nothing, repeated rows match each.
    """
    lines, quotes = lines.where(F.length("text") >= least), quotes.where("quote IS NOT NULL")
    longest, total, count = quotes.agg(F.coalesce(F.max(F.length("quote")), F.lit(-1)), F.coalesce(F.sum(F.length("quote")), F.lit(0)), F.count("*")).first()
    x, y = F.col("text"), F.col("quote")
    few = (KEY + 1) * total + count <= BROADCAST_KEYS  # as many keys as parts of each size at most
    table = keys(quotes, part_over, least)
    near = lines.where(F.length("text") <= longest).withColumn("key", F.substring("text", 1, KEY)).join(F.broadcast(table) if few else table.hint("merge"), "key")
    texts = quotes.select("quote", F.xxhash64("quote").alias("of")).distinct()
    inside = near.join(F.broadcast(texts) if few else texts.hint("merge"), "of").where((x == y) | (F.length(y) > part_over) & y.contains(x))
    held = holding(lines, quotes.where(F.length("quote") > part_over), block_chars)
    found = inside.select(*lines.columns, "quote").unionByName(held.select(*lines.columns, "quote"))
    return found.join(quotes, "quote").withColumn("kind", F.when(x == y, "IDENTICA").otherwise("SUBCADENA"))
