"""Alignment of two tokenizers' tokens over the same bytes, and which tokens go together.

Both tokenizers read space + text.  Where a token of A and one of B end at the same
byte, a group ends.  Groups are found by diagonal run skipping: at the current shift
between the two indices the arrays of ends are compared over 1, 2, 4, ... tokens, so
that one-to-one stretches are jumped; where they differ, the smaller end moves on
until the ends meet (an irregular group), which gives the next shift.  Tokens of no
bytes do not occur, so every group has one link: its last A token with its last B
token.

Neither tokenizer has tokens that go on over a space after a character that is no
white space, so texts are cut there; a worker keeps the ids of distinct pieces (words
with the spaces before them).  Only new ones go to the libraries.

At scale: texts are encoded once; the links are written (four bytes each).  Counts of
id pairs are summed in each task before they are moved.  Of two tokens that end
together one is a suffix of the other, so there are no more pairs than the vocabularies
have bytes, about half a million, however large the corpus is: that table alone is
collected and broadcast, and `pair_counts` refuses one over that bound.

Defined results: null and empty texts, and texts that one of the tokenizers does not
give back byte by byte, have no tokens (zeros and ''); special tokens' strings are plain
text; repeated rows count each; very long texts are aligned piece by piece; empty
tables give none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save, slices, text_blocks
from .tokencounts import byte_alphabet

_ALIGNED = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "n_a", "n_b", "n_groups")] + [T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.BinaryType())]
)
_COUNTS = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])
SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [T.StructField("groups_sha256", T.StringType())]
)
_BLOCK_BYTES = 1_000_000


class ByteTokens:
    """A: a byte-level vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_alphabet()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else b""

    def one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """B: a sentencepiece model, which adds the space before a text by itself."""

    SPACE = "▁"
    #: Stands before every text, so that no space is added to those it begins with; its tokens are taken off again.
    BEFORE = "a"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(self.SPACE, " ").encode())
            if self.SPACE in piece.lstrip(self.SPACE):
                raise ValueError("a piece of the model goes on over a space")
        self.before = len(self.model.encode(self.BEFORE))

    def one(self, text: str) -> list[int]:
        return self.model.encode(self.BEFORE + text)[self.before :]


def cuts(raw: bytes) -> np.ndarray:
    """Places in UTF-8 where a space follows something that is surely no white space."""
    a = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(a == 0x20)
    at = at[at > 0]
    last = a[at - 1]
    # white space beyond ASCII is C2 85, C2 A0, or three bytes from E1, E2 or E3 on
    wide = (a[np.maximum(at - 2, 0)] == 0xC2) | np.isin(a[np.maximum(at - 3, 0)], (0xE1, 0xE2, 0xE3))
    return at[(last > 0x20) & (last < 0x7F) | (last >= 0x80) & ~wide]


def ends_sure(piece: bytes) -> bool:
    """Whether cuts() would cut before a space that follows the piece."""
    c = piece[-1]
    return 0x20 < c < 0x7F or c >= 0x80 and piece[-2] != 0xC2 and (len(piece) < 3 or not 0xE1 <= piece[-3] <= 0xE3)


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the last A and last B token of every group; both arrays rise and end with the same byte."""
    a, b = ends_a.tolist(), ends_b.tolist()
    n = len(a)
    a.append(-1)  # never equal beyond the end
    b.append(-2)
    first, shifts, sizes = [], [], []
    i = j = 0
    while i < n:
        x, y = a[i], b[j]
        while x != y:  # an irregular group
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        begin = i
        i += 1
        j += 1
        step = 1
        while a[i] == b[j]:  # the diagonal goes on
            if step == 1 or a[i : i + step] == b[j : j + step]:
                i += step
                j += step
                step *= 2
            else:
                while step > 1:
                    step //= 2
                    if a[i : i + step] == b[j : j + step]:
                        i += step
                        j += step
        first.append(begin)
        shifts.append(j - i)
        sizes.append(i - begin)
    size = np.array(sizes, np.int64)
    total = np.cumsum(size)
    last_a = np.repeat(np.array(first, np.int64) - (total - size), size) + np.arange(total[-1] if n else 0)
    return last_a, last_a + np.repeat(np.array(shifts, np.int64), size)


class _Side:
    """One tokenizer, and the bytes of its tokens."""

    def __init__(self, tokens: ByteTokens | PieceTokens):
        self.tokens = tokens
        self.sizes = np.array([len(x) for x in tokens.bytes], np.int64)

    def read(self, raw: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and ends of the tokens of a text; None if they do not give it back."""
        ids = self.tokens.one(raw.decode())
        if b"".join(map(self.tokens.bytes.__getitem__, ids)) != raw:
            return None
        at = np.array(ids, np.int64)
        return at, np.cumsum(self.sizes[at])


Aligned = tuple[int, int, bytes, bytes]  # A tokens, B tokens, link codes, groups as text, each ended by ';'


class Aligner:
    #: Distinct pieces in each of the two generations that a worker keeps.
    HELD = 250_000
    #: Longer pieces are not kept.
    LONG = 200
    #: New pieces that are read and aligned as one text.
    JOINED = 4000

    def __init__(self, a: str, b: str):
        self.a, self.b = _Side(ByteTokens(a)), _Side(PieceTokens(b))
        self.size_b = len(self.b.sizes)
        self.code = np.dtype("<u4") if len(self.a.sizes) * self.size_b <= 1 << 32 else np.dtype("<u8")
        self.bound = int(self.a.sizes.sum() + self.b.sizes.sum())
        self.young: dict[bytes, Aligned | None] = {}
        self.old: dict[bytes, Aligned | None] = {}
        # ids as decimals with each separator, as rows of bytes of one width: A ',' A '|' B ',' B ';'
        digits = [[f"{i}{s}".encode() for i in range(len(x.sizes))] for x, pair in ((self.a, ",|"), (self.b, ",;")) for s in pair]
        texts = [t for part in digits for t in part]
        self.text = np.array(texts).view(np.uint8).reshape(len(texts), -1)
        self.text_size = np.array([len(t) for t in texts])
        self.text_from = np.cumsum([0, *(len(part) for part in digits[:-1])])

    def joined(self, pieces: list[bytes]) -> list[Aligned] | None:
        """Each piece's alignment, by one alignment of all in a row; None if the tokens do not give them back or do not end with them."""
        raw = b"".join(pieces)
        a, b = self.a.read(raw), self.b.read(raw)
        if a is None or b is None:
            return None
        last_a, last_b = align(a[1], b[1])
        stop = np.cumsum([len(p) for p in pieces])
        group = np.searchsorted(a[1][last_a], stop)
        if (a[1][last_a][group] != stop).any():
            return None
        n_a, n_b = last_a[group] + 1, last_b[group] + 1
        links = (a[0][last_a] * self.size_b + b[0][last_b]).astype(self.code)
        text, end = self._written([a[0], b[0]], last_a, last_b)
        bounds = zip([0, *(group + 1).tolist()], (group + 1).tolist(), [0, *end[n_a + n_b].tolist()], end[n_a + n_b].tolist())
        size = zip(np.diff(n_a, prepend=0).tolist(), np.diff(n_b, prepend=0).tolist())
        return [(x, y, links[g:h].tobytes(), text[s:t]) for (x, y), (g, h, s, t) in zip(size, bounds, strict=True)]

    def _learn(self, pieces: list[bytes]) -> dict[bytes, Aligned | None]:
        """Alignments of distinct pieces; those that may end in white space by themselves."""
        sure = [p for p in pieces if ends_sure(p)]
        alone, out = [p for p in pieces if not ends_sure(p)], {}
        for lo in range(0, len(sure), self.JOINED):
            part = sure[lo : lo + self.JOINED]
            found = self.joined(part)
            if found is None:
                alone += part
            else:
                out.update(zip(part, found, strict=True))
        for p in alone:
            out[p] = (self.joined([p]) or [None])[0]
        return out

    def pieces(self, pieces: list[bytes]) -> list[Aligned | None]:
        """The alignment of each piece, new ones learned."""
        if len(self.young) > self.HELD:
            self.young, self.old = {}, self.young
        young, missing = self.young, []
        for p in set(pieces).difference(young):
            if p in self.old:
                young[p] = self.old[p]
            else:
                missing.append(p)
        new = self._learn(missing)
        young.update((p, x) for p, x in new.items() if len(p) <= self.LONG)
        return [young[p] if p in young else new[p] for p in pieces]

    def block(self, raws: list[bytes]) -> list[Aligned | None]:
        """The alignment of each text, which begins with a space; None: not given back byte by byte."""
        bounds, pieces = [0], []
        for raw in raws:
            at = [0, *cuts(raw).tolist(), len(raw)]
            pieces += [raw[x:y] for x, y in zip(at, at[1:])]
            bounds.append(len(pieces))
        found, out = self.pieces(pieces), []
        for x, y in zip(bounds, bounds[1:]):
            if None in (part := found[x:y]):
                out.append(None)
            else:
                a, b, links, text = zip(*part, strict=True)
                out.append((sum(a), sum(b), b"".join(links), b"".join(text)))
        return out

    def _written(self, ids: list[np.ndarray], last_a: np.ndarray, last_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Groups as text, each ended by ';', and where the text of each number of tokens ends."""
        of_a, of_b = (np.diff(last, prepend=-1) for last in (last_a, last_b))
        row = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        a, b = ids[0] + self.text_from[0], ids[1] + self.text_from[2]
        a[last_a] += self.text_from[1]
        b[last_b] += self.text_from[3] - self.text_from[2]
        row[np.arange(len(a)) + np.repeat(last_b + 1 - of_b, of_a)] = a
        row[np.arange(len(b)) + np.repeat(last_a + 1, of_b)] = b
        return self.text[row].tobytes().translate(None, b"\0"), np.concatenate([[0], np.cumsum(self.text_size[row])])

    def long(self, raw: bytes) -> tuple[int, int, bytes, str] | None:
        """As many(), for one long text, cut between pieces."""
        at = [0, *cuts(raw).tolist(), len(raw)]
        n_a = n_b = 0
        links, digest, rest = [], hashlib.sha256(), b""
        for lo, hi in slices(np.diff(at).tolist(), _BLOCK_BYTES):
            part = self.block([raw[at[lo] : at[hi]]])[0]
            if part is None:
                return None
            n_a, n_b = n_a + part[0], n_b + part[1]
            links.append(part[2])
            digest.update(rest + part[3][:-1])
            rest = b";"
        return n_a, n_b, b"".join(links), digest.hexdigest()

    def many(self, texts: list[str | None]) -> list[tuple[int, int, bytes, str] | None]:
        """(A tokens, B tokens, link codes, digest of the groups) of each text; None: no tokens."""
        raws = [(" " + t).encode() if t else b"" for t in texts]
        out: list = [self.long(r) if len(r) > _BLOCK_BYTES else None for r in raws]
        short = [i for i, r in enumerate(raws) if 0 < len(r) <= _BLOCK_BYTES]
        for lo, hi in slices([len(raws[i]) for i in short], _BLOCK_BYTES):
            for i, part in zip(short[lo:hi], self.block([raws[i] for i in short[lo:hi]]), strict=True):
                out[i] = part and (*part[:3], hashlib.sha256(part[3][:-1]).hexdigest())
        return out


_HELD: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """The worker's own aligner for two vocabulary files."""
    if (a, b) not in _HELD:
        _HELD[a, b] = Aligner(a, b)
    return _HELD[a, b]


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, numbers of tokens and groups, digest of the groups, and the code of every link (A id * size of B + B id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(a, b)
        for block, texts in text_blocks(batches, 4_000_000):
            rows = [(x[0], x[1], len(x[2]) // by.code.itemsize, x[3], x[2]) if x else (0, 0, 0, "", b"") for x in by.many(texts)]
            columns = [pa.array(c, f.dataType.typeName() == "string" and pa.string() or f.dataType.typeName() == "binary" and pa.binary() or pa.int64()) for c, f in zip(zip(*rows, strict=True), _ALIGNED[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *columns], names=_ALIGNED.names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, _ALIGNED)


def _summed(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pair, own = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.zeros(len(pair), np.int64)
    np.add.at(total, own, np.concatenate(counts))
    return pair, total


def pair_counts(found: DataFrame, code: np.dtype, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of linked id pairs, rising, and how many links have each; summed inside each task first. bound: of their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            raw = batch.column("links").to_pylist()
            for lo, hi in slices(list(map(len, raw)), 32_000_000):
                new, times = np.unique(np.frombuffer(b"".join(raw[lo:hi]), code), return_counts=True)
                pair, n = _summed([pair, new.astype(np.int64)], [n, times])
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=_COUNTS.names)

    rows = found.select("links").mapInArrow(run, _COUNTS).groupBy("pair").agg(F.sum("n").alias("n")).limit(bound + 1).toArrow()
    if rows.num_rows > bound:
        raise ValueError(f"more than {bound} pairs: some link joins tokens of which none is the other's suffix")
    pair, n = (rows.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    return pair[order], n[order]


def cross_alignment(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Per document: tokens, groups, links, links of a B id's most frequent A ids, and the links' counts in the corpus summed; a, b: vocabulary files."""
    by = aligner(a, b)
    size_b, code = by.size_b, by.code
    found = save(aligned(docs, a, b), "aligned")
    pair, n = pair_counts(found, code, by.bound)
    most = np.zeros(size_b, np.int64)
    np.maximum.at(most, pair % size_b, n)
    table = docs.sparkSession.sparkContext.broadcast((pair, n, n == most[pair % size_b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        for batch in batches:
            raw = batch.column("links").to_pylist()
            n_best, total = [], []
            for links in raw:
                at = np.searchsorted(pair, np.frombuffer(links, code).astype(np.int64))
                n_best.append(int(best[at].sum()))
                total.append(int(n[at].sum()))
            columns = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), batch.column("groups_sha256")], names=SCHEMA.names)

    return found.mapInArrow(run, SCHEMA)
