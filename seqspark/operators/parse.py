"""Parsing instruction notation: rows, names, tokens, repeats."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_macro, paren_depth

#: Letters that are instructions (fixed values of the notation).
INSTRUCTION_LETTERS = "lpagxr"
#: Tokens without nested groups: a group, a number with '>', a number, '<' and a number, a letter.
FLAT = rf"(\([^()]*\)|\d+>?|<\d+|[{INSTRUCTION_LETTERS}])"


def header_points(value: Column) -> Column:
    """The starting points of a first line such as 8/10p; empty for others."""
    return F.regexp_extract(value, r"(?i)^\s*(\d+(?:/\d+)?)p\s*$", 1)


def numbered_rows(rows: DataFrame, column: str) -> DataFrame:
    """Rows that begin with a number: line, raw; others are dropped."""
    return rows.where(F.trim(column).rlike(r"^\d+\s+\S")).withColumns(
        {"line": F.regexp_extract(F.trim(column), r"^(\d+)\s", 1).cast("int"), "raw": F.regexp_extract(F.trim(column), r"^\d+\s+(.*)$", 1)}
    )


def numbered_or_dashed_rows(rows: DataFrame, column: str) -> DataFrame:
    """The second row form: number, then white space or a dash."""
    return rows.where(F.col(column).rlike(r"^\d+[\s\-]")).withColumns(
        {"line": F.regexp_extract(column, r"^(\d+)", 1).cast("int"), "raw": F.regexp_extract(column, r"^\d+[\s\-]\s*(.*)$", 1)}
    )


def clean_name(file_name: Column) -> Column:
    """'CM. 4. Name.txt' or 'CM. 17-18. Name.txt' as CM_Name; other names without their suffix."""
    stem = F.regexp_replace(file_name, r"\.txt$", "")
    form = r"^([A-Za-z]+)\.\s*[\d\-]+\.\s*(.+)$"
    return F.when(stem.rlike(form), F.concat_ws("_", F.regexp_extract(stem, form, 1), F.trim(F.regexp_extract(stem, form, 2)))).otherwise(stem)


def tokenize_flat(text: Column) -> Column:
    """Tokens of lower-cased notation without nested groups; anything else is dropped."""
    return F.regexp_extract_all(F.lower(text), F.lit(FLAT), F.lit(1))


def tokenize(text: Column) -> Column:
    """Tokens of lower-cased notation; a group with its nested groups is one token, open groups run to the end.

    A fold over characters that holds the group depth, keeps plain stretches apart
    from groups, and then tokenises the plain ones by pattern.
    """
    state = F.struct(F.lit(0).alias("depth"), F.array(F.lit("")).alias("parts"))

    def step(acc: Column, c: Column) -> Column:
        depth, parts = acc["depth"], acc["parts"]
        last = F.element_at(parts, -1)
        body = F.slice(parts, F.lit(1), F.size(parts) - 1)
        opens, closes = (c == "(") & (depth == 0), (c == ")") & (depth == 1)
        grown = F.concat(body, F.array(F.concat(last, c)))
        nxt = F.when(opens, F.concat(parts, F.array(c))).when(closes, F.concat(grown, F.array(F.lit("")))).otherwise(grown)
        return F.struct((depth + F.when(c == "(", 1).when((c == ")") & (depth > 0), -1).otherwise(0)).alias("depth"), nxt.alias("parts"))

    parts = F.aggregate(F.split(F.lower(text), ""), state, step, lambda acc: acc["parts"])
    plain = F.lit(rf"(\d+>?|<\d+|[{INSTRUCTION_LETTERS}])")
    return F.flatten(F.transform(parts, lambda p: F.when(p.startswith("("), F.array(p)).otherwise(F.regexp_extract_all(p, plain, F.lit(1)))))


def token_properties(df: DataFrame) -> DataFrame:
    """Adds what a token itself tells: length, macro flag and group depth."""
    return df.withColumns({"length": F.length("token"), "is_macro": is_macro(F.col("token")), "depth": paren_depth(F.col("token"))})


def relative_position(index: Column, n: Column) -> Column:
    """A place in [0, 1] of a line of n tokens."""
    return F.round(F.when(n > 1, index / (n - 1)).otherwise(0.0), 4)


def enrich(lines: DataFrame) -> DataFrame:
    """One row per token: index, position in [0, 1], length, macro flag and group depth."""
    rows = lines.select("doc", "line", F.size("tokens").alias("n"), F.posexplode("tokens").alias("index", "token"))
    return token_properties(rows.withColumn("pos_norm", relative_position(F.col("index"), F.col("n"))).drop("n"))


def enriched_counts(lines: DataFrame) -> DataFrame:
    """Rows of enrich() without doc and line, and how many there are of each.

    Occurrences are counted first, so properties are read off once for each distinct
    token and place.
    """
    places = lines.select(F.size("tokens").alias("n"), F.posexplode("tokens").alias("index", "token")).groupBy("n", "index", "token").agg(F.count("*").alias("rows"))
    placed = places.groupBy("index", "token", relative_position(F.col("index"), F.col("n")).alias("pos_norm")).agg(F.sum("rows").alias("rows"))
    return token_properties(placed)


def expand_flat(text: Column) -> Column:
    """Repeats of letters written out: 3a2l as a a a l l; groups of digits and N> stay; native."""
    parts = F.regexp_extract_all(text, F.lit(r"(\(\d+\)|\d+>|<\d+|\d*[A-Za-z]|\d+)"), F.lit(1))

    def one(p: Column) -> Column:
        count = F.regexp_extract(p, r"^(\d+)[A-Za-z]$", 1)
        letter = F.regexp_extract(p, r"([A-Za-z])$", 1)
        return F.when(p.rlike(r"^\d+[A-Za-z]$"), F.array_repeat(letter, count.cast("int"))).otherwise(F.array(p))

    return F.flatten(F.transform(parts, one))


EXPANDED = T.StructType(
    [
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("seq", T.StringType()), T.StructField("n", T.IntegerType())]))),
    ]
)


# Repeats, numbers and literals of the full notation, in the order in which they are tried.
_ARROW, _REPEAT, _LITERAL = re.compile(r"\d+>"), re.compile(r"(\d+)(IMZ|MZ|[^\W\d_])"), re.compile(r"IMZ|MZ|\d+|<\d+")


def _closings(text: str) -> dict[int, int]:
    """The place of the parenthesis that closes each one opened; the text's end for those that stay open."""
    out: dict[int, int] = {}
    opened: list[int] = []
    for i, c in enumerate(text):
        if c == "(":
            opened.append(i)
        elif c == ")" and opened:
            out[opened.pop()] = i
    return out | dict.fromkeys(opened, len(text))


def _block(text: str, begin: int, end: int, hyphens: dict[int, int]) -> tuple[str, int] | None:
    """(sequence, repeats) of a group text[begin:end] of the form sequence-Nv, with something for the sequence; hyphens: those of the ends seen before."""
    if end not in hyphens:
        i = end - 1
        if text[i : i + 1] == "v":
            while i > 0 and text[i - 1].isdecimal():
                i -= 1
        hyphens[end] = i - 1 if 0 < i < end - 1 and text[i - 1] == "-" else -1
    at = hyphens[end]
    if at <= begin:
        return None
    return text[begin:at], int(text[at + 1 : end - 1])


def expand_text(text: str) -> tuple[list[str], list[tuple[int, str, int]]]:
    """Full notation: nested groups, vertical blocks (seq-Nv), IMZ and MZ, repeats; case is kept.

    Groups that are neither blocks nor digits are read in place, however deep they nest.
    """
    closing = _closings(text)
    hyphens: dict[int, int] = {}
    tokens: list[str] = []
    blocks: list[tuple[int, str, int]] = []
    passed: set[int] = set()  # closing parentheses of groups that are read in place
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c.isspace() or i in passed:
            i += 1
        elif c == "(":
            end = closing[i]
            block = _block(text, i + 1, end, hyphens)
            if block:
                blocks.append((len(tokens), *block))
                tokens.append(f"<{block[0]}>")
                i = end + 1
            elif text[i + 1 : i + 2].isdigit() and text[i + 1 : end].isdigit():
                tokens.append(f"({text[i + 1 : end]})")
                i = end + 1
            else:
                passed.add(end)
                i += 1
        elif m := _ARROW.match(text, i):
            tokens.append(m[0])
            i = m.end()
        elif m := _REPEAT.match(text, i):
            tokens += [m[2]] * int(m[1])
            i = m.end()
        elif m := _LITERAL.match(text, i):
            tokens.append(m[0])
            i = m.end()
        else:
            tokens.append(c)
            i += 1
    return tokens, blocks


def expand(rows: DataFrame, text: str) -> DataFrame:
    """Adds tokens and blocks of the full notation; the grammar nests, so batches go through Arrow."""
    import pyarrow as pa

    kind = pa.struct([("pos", pa.int32()), ("seq", pa.string()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(None, None) if t is None else expand_text(t) for t in b.column(text).to_pylist()]
            tokens = pa.array([p[0] for p in pairs], pa.list_(pa.string()))
            found = pa.array([None if p[1] is None else [{"pos": x, "seq": s, "n": k} for x, s, k in p[1]] for p in pairs], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([*b.columns, tokens, found], names=[*b.schema.names, "tokens", "blocks"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *EXPANDED.fields]))


def block_stats(expanded: DataFrame) -> DataFrame:
    """Adds the number of vertical blocks, their repeats in all, the most repeats and the longest sequence."""
    b = F.col("blocks")
    return expanded.withColumns(
        {
            "n_blocks": F.size(b),
            "repeats": F.aggregate(b, F.lit(0), lambda acc, x: acc + x["n"]),
            "most_repeats": F.array_max(F.transform(b, lambda x: x["n"])),
            "longest": F.array_max(F.transform(b, lambda x: F.length(x["seq"]))),
        }
    )


def expand_row(text: Column) -> Column:
    """The second expander, native: (N) is N times l, (seq-Nv) N times what seq gives, a single digit d is d times l, other letters stay."""
    plain, group = r"(\d|[lpgavxr])", r"^\(([^()]+)-(\d+)v\)$"
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\(\d+\)|\([^()]+-\d+v\)|\d|[lpgavxr])"), F.lit(1))
    times = lambda n: F.coalesce(n.try_cast("int"), F.lit(0))
    letters = lambda p: F.when(p.rlike(r"^\d+$"), F.array_repeat(F.lit("l"), times(p))).otherwise(F.array(p))
    inner = lambda p: F.flatten(F.transform(F.regexp_extract_all(F.regexp_extract(p, group, 1), F.lit(plain), F.lit(1)), letters))
    block = lambda p: F.flatten(F.array_repeat(inner(p), times(F.regexp_extract(p, group, 2))))
    return F.flatten(F.transform(parts, lambda p: F.when(p.rlike(group), block(p)).otherwise(letters(F.regexp_replace(p, r"[()]", "")))))


def normalized_instruction(text: Column) -> Column:
    """Lower case without spaces, '.)' as ')', without a leading number and its separator."""
    t = F.regexp_replace(F.lower(text), r"\s+", "")
    t = F.replace(t, F.lit(".)"), F.lit(")"))
    return F.regexp_replace(t, r"^\d+[.\-]", "")


def palindromes(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(F.col(text) == F.reverse(text))
