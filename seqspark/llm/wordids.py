"""Token ids of whole texts by a public tokenizer, one library call per many distinct words.

The tokenizer drops white space and never joins across it, so a text's ids are
its words' ids in a row.  The words of a block of texts are numpy arrays; distinct
ones are looked up in a two-generation cache that each worker keeps, and the ids of
the block are gathered from those of its distinct words.  New words that are plain
letters go to the library many at a time, as one text, whose ids are cut where a
piece ends a word.  A text that spells a special token is left to the library as a
whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from .common import slices, text_pieces
from .wordarrays import PLAIN_LOWER, words_of

# UTF-8 letters that are one pre-token together with their like, whatever follows: Latin ones up to U+017E that lower-case
# to one letter (not U+0130); then punctuation, which is a pre-token of its own.
_LETTERS = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\x88\x8a-\xbe])+"
_LETTERS_AND_POINTS = re.compile(rb"(" + _LETTERS + rb")([!-&(-/:-@\[-`{-~]*)")


class WordIds:
    """Bytes of little-endian uint32 ids for texts, with one tokenizer file."""

    #: Words held in each of the two cache generations.
    HELD = 500_000
    #: Bytes held in each of the two cache generations, about: of words, their ids, and WORD_BYTES more a word.
    HELD_BYTES, WORD_BYTES = 96_000_000, 150
    #: Characters that are split into words at once.
    BLOCK_CHARS = 4_000_000
    #: New words that go to the library as one text.
    JOINED = 1000

    def __init__(self, path: str, held_bytes: int = HELD_BYTES):
        self.HELD_BYTES = held_bytes
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0  # bytes of the young generation

    def _put(self, words: list[bytes], ids: list[bytes]) -> None:
        self.young.update(zip(words, ids, strict=True))
        self.held += sum(map(len, words)) + sum(map(len, ids)) + self.WORD_BYTES * len(words)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are one pre-token each."""
        out: list[bytes] = []
        for lo in range(0, len(words), self.JOINED):
            part = words[lo : lo + self.JOINED]
            raw = self._library([b" ".join(part).decode()])[0]
            ends = ((np.flatnonzero(self.ends[np.frombuffer(raw, np.uint32)]) + 1) * 4).tolist()
            if len(ends) != len(part):  # not one pre-token each after all
                out += self._library([w.decode() for w in part])
            else:
                out += [raw[i:j] for i, j in zip([0, *ends], ends)]
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Puts the ids of words that no generation holds into the young one."""
        letters: set[bytes] = set()
        other: set[bytes] = set()
        split: list[tuple[bytes, bytes, bytes]] = []
        for w in words:
            m = _LETTERS_AND_POINTS.fullmatch(w)
            if m is None:
                other.add(w)
            elif m[2]:
                split.append((w, m[1], m[2]))
            else:
                letters.add(w)
        young = self.young
        for some, of in ((letters, 1), (other, 2)):
            parts = {s[of] for s in split} - some
            some.update(p for p in parts if p not in young and not self._again(p))
        new = list(letters)
        self._put(new, self._letters(new))
        new = list(other)
        self._put(new, self._library([w.decode() for w in new]))
        self._put([w for w, _, _ in split], [young[stem] + young[points] for _, stem, points in split])

    def _again(self, word: bytes) -> bool:
        """Takes a word over from the old generation, if it is there."""
        ids = self.old.get(word)
        if ids is None:
            return False
        self._put([word], [ids])
        return True

    def _of_distinct(self, words: list[bytes]) -> list[bytes]:
        if len(self.young) > self.HELD or self.held > self.HELD_BYTES:
            self.young, self.old, self.held = {}, self.young, 0
        young = self.young
        found = list(map(young.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            self._learn([w for i in missing if not self._again(w := words[i])])
            for i in missing:
                found[i] = young[words[i]]
        return found

    def _block(self, texts: list[str]) -> list[bytes]:
        words = words_of(texts, PLAIN_LOWER)
        if not len(words):
            return [b""] * len(texts)
        _, at, own = np.unique(words.hash, return_index=True, return_inverse=True)
        size = words.end - words.start
        if (size[at][own] != size).any():  # words of one hash that differ
            return [b"".join(self._of_distinct([words.word(i) for i in range(a, b)])) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
        buffer = words.buffer
        ids = self._of_distinct([buffer[a:b] for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)])
        length = np.array([len(i) // 4 for i in ids])
        pool, begin = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(length) - length
        n = length[own]
        total = np.cumsum(n)
        raw = pool[np.repeat(begin[own] - (total - n), n) + np.arange(total[-1])].tobytes()
        bounds = (np.concatenate([[0], total])[words.first] * 4).tolist()
        return [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none."""
        out = [b""] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if "<|" in t:
                out[i] = self._library([t])[0]
            elif len(t) > self.BLOCK_CHARS:
                out[i] = b"".join(x for piece in text_pieces(t, self.BLOCK_CHARS) for x in self._block([piece]))
            else:
                plain.append(i)
        for lo, hi in slices([len(texts[i]) for i in plain], self.BLOCK_CHARS):
            for i, ids in zip(plain[lo:hi], self._block([texts[i] for i in plain[lo:hi]]), strict=True):
                out[i] = ids
        return out

    def ids(self, text: str | None) -> bytes:
        return self.many([text])[0]


_HELD: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, held_bytes: int = WordIds.HELD_BYTES) -> WordIds:
    """The worker's own encoder for a tokenizer file, with a cache of so many bytes in each generation."""
    if (path, held_bytes) not in _HELD:
        _HELD[path, held_bytes] = WordIds(path, held_bytes)
    return _HELD[path, held_bytes]
