"""How often patterns of any length stand in lines: one automaton over all of them.

Every token is written between two marks, so that a sequence of tokens stands in a
line exactly where its text stands in the line's text.  A block of patterns is one
Aho-Corasick automaton (a trie with failure links), broadcast; each line is read once
for all patterns of a block, whatever their lengths.  Tasks add up their docs' counts
before these are moved.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import doc_patterns
from .quotations import BLOCK_CHARS, _automaton, quotation_blocks

BEGIN, END = "\x1e", "\x1f"
#: (doc, pattern) counts that a task holds before it passes them on.
HELD = 200_000


def marked(tokens: Column) -> Column:
    """Tokens as one text, each between two control characters, which tokens must not hold."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.lit(BEGIN), t, F.lit(END))), "")


def pattern_counts(lines: DataFrame, patterns: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc, pattern, n: occurrences of each distinct pattern (an array of tokens, not empty) in a doc's lines that do not overlap, from a line's left end; none: no row.

    Null lines and tokens match nothing; repeated lines count each.
    """
    doc = lines.schema["doc"].dataType.simpleString()
    text = lines.select("doc", marked(F.filter("tokens", lambda t: t.isNotNull())).alias("text")).where("text != ''")
    given = patterns.where(F.size("pattern") > 0).select(marked(F.col("pattern")).alias("quote")).where("quote IS NOT NULL")
    found = None
    sc = lines.sparkSession.sparkContext
    for block in quotation_blocks(given, block_chars):
        shared = sc.broadcast(block)
        name = f"{sc.applicationId}-{shared._jbroadcast.id()}"

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            automaton, size, total, kind = None, None, Counter(), None

            def rows() -> pa.RecordBatch:
                docs, at = zip(*total, strict=True)
                columns = [pa.array(docs, kind), pa.array([shared.value[i] for i in at], pa.string()), pa.array(total.values(), pa.int64())]
                return pa.RecordBatch.from_arrays(columns, names=["doc", "pattern", "n"])

            for batch in batches:
                automaton = automaton or _automaton(name, shared.value)
                size, kind = size or [len(q) for q in shared.value], batch.schema.field("doc").type
                for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    over: dict[int, int] = {}
                    for last, i in automaton.iter(text):
                        if last - size[i] >= over.get(i, -1):  # it begins after the end of the one before
                            over[i] = last
                            total[doc, i] += 1
                    if len(total) > HELD:
                        yield rows()
                        total.clear()
            if total:
                yield rows()

        part = text.mapInArrow(run, f"doc {doc}, pattern string, n long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return lines.select("doc", F.lit("").alias("pattern"), F.lit(0).cast("long").alias("n")).where("false")
    plain = F.translate(F.replace("pattern", F.lit(END + BEGIN), F.lit(" ")), BEGIN + END, "")
    return found.groupBy("doc", "pattern").agg(F.sum("n").alias("n")).select("doc", plain.alias("pattern"), "n")


def shared_patterns_of_docs(lines: DataFrame, docs: int = 2, longest: int | None = 1000) -> DataFrame:
    """Repeated patterns, of two tokens or more, that the covers of several docs hold: pattern (array of tokens)."""
    covers = doc_patterns(lines, longest).select("doc", "pattern").distinct()
    return covers.groupBy("pattern").agg(F.count("*").alias("docs")).where(F.col("docs") >= docs).select(F.split("pattern", " ").alias("pattern"), "docs")
