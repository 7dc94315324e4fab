"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie of bytes with two roots: one for pieces that begin a
word, one for pieces that continue it.  Every node has a failure link, the node
reached after the longest match so far is popped off, and the number of pieces
that this pops.  A word is read byte by byte; on a missing edge the link is
followed and its count added, so lengths come without building pieces, in time
linear in the text (after "Fast WordPiece Tokenization", 2021).

Vocabulary: a byte-level file whose 256 single bytes are all pieces, so every
word has a length.  Words are `[^\\x20\\x09-\\x0D]+`; a word begins with the
space marker of that vocabulary, which makes its first piece a word-initial one.

Defined results: null and empty texts have 0 words and 0 pieces; repeated rows
are counted each; very long words are read like others; empty tables give none.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_blocks

SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_words", "n_pieces", "max_word_pieces")])
MARK = b" "


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes: character -> byte.

    Bytes that print keep their own character; the others take those from 256 on.
    """
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_pieces(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file as bytes; word-initial ones begin with MARK."""
    alphabet = byte_alphabet()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return [bytes(alphabet[c] for c in piece) for piece in vocab if all(c in alphabet for c in piece)]


class Automaton:
    """length(word) is the number of pieces that greedy longest match gives for MARK + word."""

    def __init__(self, pieces: list[bytes]):
        known = set(pieces)
        missing = [b for b in range(256) if bytes([b]) not in known]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        # node 0: the initial root, entered by MARK alone; node 1: the root of continuing pieces
        self.children: list[dict[int, int]] = [{}, {}]
        accepts = [False, False]
        for piece in known:
            node = 0 if piece[:1] == MARK else 1
            for b in piece:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    accepts.append(False)
                node = nxt
            accepts[node] = True
        self.link, self.popped = [-1] * len(accepts), [0] * len(accepts)
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for b, v in self.children[u].items():
                if accepts[v]:
                    self.link[v], self.popped[v] = 1, 1
                else:
                    # pop what the parent pops, then go on with this byte
                    z, n = self.link[u], self.popped[u]
                    while z != -1 and b not in self.children[z]:
                        z, n = self.link[z], n + self.popped[z]
                    if z != -1:
                        self.link[v], self.popped[v] = self.children[z][b], n
                queue.append(v)
        self.rest: list[int] = [0] * len(accepts)  # pieces popped from a node at the end of a word
        for v in range(2, len(accepts)):
            z, n = v, 0
            while z not in (-1, 1):
                n += self.popped[z]
                z = self.link[z]
            self.rest[v] = n
        self.begin = self.children[0][MARK[0]]

    def length(self, word: bytes) -> int:
        children, link, popped = self.children, self.link, self.popped
        node, n = self.begin, 0
        for b in word:
            nxt = children[node].get(b)
            while nxt is None:
                n += popped[node]
                node = link[node]
                nxt = children[node].get(b)
            node = nxt
        return n + self.rest[node]


_HELD: dict[str, tuple[Automaton, dict[bytes, int]]] = {}
WORDS_HELD = 400_000  # lengths a worker remembers


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: words, pieces, and the most pieces in one word; vocabulary is a file's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _HELD:
            _HELD[vocabulary] = (Automaton(load_pieces(vocabulary)), {})
        automaton, known = _HELD[vocabulary]
        for block, texts in text_blocks(batches, 4_000_000):
            counts = []
            for text in texts:
                words = (text or "").encode("utf-8", "surrogatepass").split()
                try:
                    lengths = list(map(known.__getitem__, words))
                except KeyError:
                    if len(known) > WORDS_HELD:
                        known.clear()
                    for w in words:
                        if w not in known:
                            known[w] = automaton.length(w)
                    lengths = list(map(known.__getitem__, words))
                counts.append((len(words), sum(lengths), max(lengths, default=0)))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True))], names=SCHEMA.names
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA)
