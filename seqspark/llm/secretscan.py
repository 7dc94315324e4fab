"""Secrets in whole texts: keyword prefilter, anchored expressions, embedded checksums.

An Aho-Corasick automaton reads the text once, A-Z lower-cased, and gives every
place of a keyword.  Only there the expression of the keyword's kind is tried,
anchored at that place; a kind without a keyword (runs of hexadecimal digits) takes
a run of its least length as keyword, in the text mapped to 'digit' and 'other'.
Kinds whose tokens carry a checksum are kept if it holds:

* github, npm: the last 6 of 36 characters are crc32 of the 30 before, in base 62;
* age, nostr: private keys in bech32.

Matches of a kind are leftmost and do not overlap, those that fail the length or
the checksum are dropped (and still use up their characters), as a scan of the whole
text by the expression alone would have it: every match begins at a keyword.

No shuffle: one pass of Arrow batches.  Texts are read as UTF-8 bytes, as keywords
and expressions are ASCII; only the places of spans are turned into code points.

Defined results: null and empty texts have no spans; repeated rows are scanned each;
very long texts are read whole, in linear time; empty tables give none; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_blocks

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
)

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Fixed values of the bech32 standard.
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def crc_holds(token: str) -> bool:
    """prefix_ + 30 characters + their crc32 in base 62, 6 digits."""
    body, digits = token[-36:-6], token[-6:]
    c, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        c, d = divmod(c, 62)
        out = BASE62[d] + out
    return out == digits


def bech32_holds(token: str) -> bool:
    """Human-readable part, 1, data with its checksum; in one case of letters."""
    human, _, data = token.lower().rpartition("1")
    if any(c not in BECH32 for c in data):
        return False
    c = 1
    for v in [*(ord(x) >> 5 for x in human), 0, *(ord(x) & 31 for x in human), *map(BECH32.index, data)]:
        top = c >> 25
        c = (c & 0x1FFFFFF) << 5 ^ v
        for k, g in enumerate(BECH32_GENERATOR):
            if top >> k & 1:
                c ^= g
    return c == 1


@dataclass(frozen=True)
class Kind:
    """What a kind of secret looks like. keywords: lower-case, every match begins with one; none: `digits` of the expression's one class."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    least: int
    most: int | None = None
    group: int = 0
    holds: Callable[[str], bool] | None = None
    base: bool = False

    def kept(self, m: re.Match) -> bool:
        size = m.end(self.group) - m.start(self.group)
        return size >= self.least and (self.most is None or size <= self.most) and (self.holds is None or self.holds(m[0].decode()))


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGNED = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: In the order in which spans of one place are listed.
KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), rf"""({_ASSIGNED})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, group=2, base=True),
    Kind("access", ("akia",), "AKIA[A-Z0-9]+", 20, base=True),
    Kind("hex", (), "[0-9a-f]+", 24, base=True),
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "gh[pousr]_[0-9A-Za-z]+", 40, 40, holds=crc_holds),
    Kind("npm", ("npm_",), "npm_[0-9A-Za-z]+", 40, 40, holds=crc_holds),
    Kind("age", ("age-secret-key-1",), "AGE-SECRET-KEY-1[A-Z0-9]+", 74, 74, holds=bech32_holds),
    Kind("nostr", ("nsec1",), "nsec1[a-z0-9]+", 63, 63, holds=bech32_holds),
)

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


class Scanner:
    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        self.kinds = kinds
        self.patterns = [re.compile(k.pattern.encode()) for k in kinds]
        by_word: dict[str, list[int]] = {}
        for i, k in enumerate(kinds):
            for w in k.keywords:
                by_word.setdefault(w, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for w, of in by_word.items():
            self.automaton.add_word(w, (len(w) - 1, tuple(of)))
        self.automaton.make_automaton()
        # kinds of one character class: which bytes are in it, and a run of the least length
        self.runs = [
            (i, bytes(0x31 if p.fullmatch(bytes([c])) else 0x30 for c in range(256)), b"1" * k.least)
            for i, (k, p) in enumerate(zip(kinds, self.patterns, strict=True))
            if not k.keywords
        ]

    def _places(self, raw: bytes) -> Iterator[tuple[int, int]]:
        """(kind, first byte) where its expression may match; of a kind in rising order, as no keyword of a kind holds another."""
        for last, (back, of) in self.automaton.iter(raw.translate(_LOWER).decode("latin-1")):
            for i in of:
                yield i, last - back
        for i, table, run in self.runs:
            mapped, at = raw.translate(table), 0
            while (at := mapped.find(run, at)) >= 0:
                yield i, at
                at = mapped.find(b"0", at)
                if at < 0:
                    break

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) in code points, in order."""
        raw = text.encode()
        over, found = [0] * len(self.kinds), []
        for i, at in self._places(raw):
            if at >= over[i] and (m := self.patterns[i].match(raw, at)):
                over[i] = m.end()
                if self.kinds[i].kept(m):
                    found.append((at, i, m.end()))
        if len(raw) != len(text):
            found = _code_points(raw, found)
        return sorted(found)


def _code_points(raw: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    place, before, n = {}, 0, 0
    for at in sorted({x for a, _, b in found for x in (a, b)}):
        n += len(raw[before:at].decode())
        place[at], before = n, at
    return [(place[a], i, place[b]) for a, i, b in found]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document: places of the base kinds, a digest of these, and all spans as kind:start:end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        names, base = [k.name for k in KINDS], [k.base for k in KINDS]
        for block, texts in text_blocks(batches, 4_000_000):
            rows = []
            for text in texts:
                found = scanner.spans(text) if text else []
                listed = [f"{names[i]}:{a}:{b}" for a, i, b in found]
                own = ",".join(s for s, (_, i, _) in zip(listed, found, strict=True) if base[i])
                n = [sum(i == k for _, i, _ in found) for k in range(3)]
                rows.append((*n, hashlib.sha256(own.encode()).hexdigest(), ",".join(listed)))
            columns = [pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *columns], names=SCHEMA.names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA)
