"""Words of many texts as numpy arrays, inside one task.

A batch of texts becomes one byte buffer in which every separator byte is a
space; words are then runs of other bytes, and each gets a 64-bit hash from
prefix sums of a polynomial over random byte weights.  No Python object is made
per word, so a task can walk texts of any length at some tens of nanoseconds a
word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Byte weights of two independent hashes.
_WEIGHTS, SECOND = (np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (20240607, 20251128))


def byte_table(separators: bytes, lower: bool) -> bytes:
    """A bytes.translate table: separators become spaces, A-Z become a-z on request."""
    table = bytearray(range(256))
    if lower:
        for c in range(0x41, 0x5B):
            table[c] = c + 32
    for c in separators:
        table[c] = 0x20
    return bytes(table)


#: Words are `[^\x20\x09-\x0D]+`, as they stand.
PLAIN = byte_table(bytes([0x20, *range(0x09, 0x0E)]), lower=False)
#: The same words, A-Z lower-cased.
PLAIN_LOWER = byte_table(bytes([0x20, *range(0x09, 0x0E)]), lower=True)
#: Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lower-cased.
ALNUM_LOWER = byte_table(
    bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True
)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


class _Powers:
    up = _powers(_BASE, 1 << 12)
    down = _powers(_INVERSE, 1 << 12)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return cls.up[:n], cls.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a batch: buffer, word bounds in it, hashes, and each text's first word."""

    buffer: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(texts) + 1 entries: words of text i are first[i]:first[i + 1]

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.end[i]]


def words_of(texts: list, table: bytes, hashed: bool = True, weights: np.ndarray = _WEIGHTS) -> Words:
    """Words of texts (str or None); a null text has none. weights: of bytes, for another hash."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass").translate(table) for t in texts]
    buffer = b" ".join(raw) + b" "
    a = np.frombuffer(buffer, np.uint8)
    inside = a != 0x20
    flips = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(a) and inside[0]:
        flips = np.concatenate([np.zeros(1, flips.dtype), flips])
    start, end = flips[0::2], flips[1::2]
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=bounds[1:])
    first = np.searchsorted(start, bounds)
    h = np.zeros(0, np.uint64)
    if hashed and len(start):
        h = np.empty(len(start), np.uint64)
        block = 1 << 20  # the prefix sums of one block of bytes at a time
        lo = 0
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(end, start[lo] + block)))
            b0, b1 = int(start[lo]), int(end[hi - 1])
            up, down = _Powers.get(b1 - b0 + 1)
            total = np.zeros(b1 - b0 + 1, np.uint64)
            np.cumsum(weights[a[b0:b1]] * up[: b1 - b0], out=total[1:])
            s, e = start[lo:hi] - b0, end[lo:hi] - b0
            h[lo:hi] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
            lo = hi
        h = mix(h)
    return Words(buffer, start, end, h, first)


def windows(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of every window of so many words of one text."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    room = np.maximum(np.diff(words.first) - length + 1, 0)
    at = np.repeat(words.first[:-1], room) + (np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room))
    return at, window_hashes(words.hash, length)[at]


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each `length` consecutive words, regardless of texts; doubling keeps it to log2(length) passes."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    out, done, power, width = None, 0, h, 1
    left = length
    while left:
        if left & 1:
            out = power.copy() if out is None else mix(out[: len(power) - done] * np.uint64(_BASE) + power[done : done + len(out)][: len(power) - done])
            done += width
        left >>= 1
        if left:
            power = mix(power[:-width] * np.uint64(_BASE) + power[width:])
            width *= 2
    return out[: len(h) - length + 1]
