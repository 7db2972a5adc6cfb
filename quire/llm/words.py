"""Words of whole Arrow text columns as numpy arrays: places, 64-bit hashes and n-gram hashes.

Works on the UTF-8 bytes of a column at once, so no Python code runs per word.
A word's hash is a polynomial of its bytes modulo 2^64, then mixed; a word is
looked at whole, whatever its length.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time; a longer single word gets a digest instead.
_SPAN = 1 << 18
_powers: dict[str, np.ndarray] = {}


def _blank_rule() -> tuple[np.ndarray, np.ndarray]:
    """Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return."""
    inside = np.ones(256, dtype=bool)
    inside[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return inside, np.arange(256, dtype=np.uint8)


def _plain_rule() -> tuple[np.ndarray, np.ndarray]:
    """A-Z lower-cased; words are runs of digits, ASCII letters and everything beyond ASCII."""
    inside = np.zeros(256, dtype=bool)
    inside[0x30:0x3A] = inside[0x41:0x5B] = inside[0x61:0x7B] = inside[0x80:] = True
    to = np.arange(256, dtype=np.uint8)
    to[0x41:0x5B] += 0x20
    return inside, to


RULES = {"blank": _blank_rule(), "plain": _plain_rule()}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(of: int, key: str) -> np.ndarray:
    if key not in _powers:
        out = np.full(_SPAN + 1, of, dtype=U64)
        out[0] = 1
        _powers[key] = np.cumprod(out, dtype=U64)
    return _powers[key]


@dataclass
class Words:
    """Words of a text column: ``data[starts[i]:ends[i]]``; row r has words ``offsets[r]`` up to ``offsets[r + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    _hashes: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = _hash(self.data, self.starts, self.ends)
        return self._hashes

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def text(self, i: int, j: int | None = None) -> str:
        """Words i up to j (one word by default), blank-joined."""
        return " ".join(bytes(self.data[s:e]).decode() for s, e in zip(self.starts[i:(j or i + 1)].tolist(),
                                                                        self.ends[i:(j or i + 1)].tolist()))

    def full(self, n: int) -> np.ndarray:
        """Whether n words of the same row begin at each word."""
        out = np.ones(len(self.starts), dtype=bool)
        first, end = self.offsets[:-1], self.offsets[1:]
        for k in range(1, n):
            at = end - k
            out[at[at >= first]] = False
        return out

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words that begin at each word; meaningless where ``full(n)`` is false."""
        h = self.hashes
        if not len(h):
            return h
        out = h.copy()
        for k in range(1, n):
            out *= U64(_BASE)
            if k < len(h):
                out[:len(h) - k] += h[k:]
        return mix(out)


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), dtype=U64)
    up, down = _power(_BASE, "up"), _power(_INVERSE, "down")
    i, n = 0, len(starts)
    while i < n:
        base = starts[i]
        j = int(np.searchsorted(ends, base + _SPAN, side="right"))
        if j <= i:
            out[i] = int.from_bytes(hashlib.blake2b(data[base:ends[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        span = data[base:ends[j - 1]]
        total = np.zeros(len(span) + 1, dtype=U64)
        np.cumsum((span.astype(U64) + U64(1)) * up[:len(span)], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))
        i = j
    return out


def words(texts: pa.Array, rule: str) -> Words:
    """The words of every row by ``rule`` ("blank" or "plain"); a null has none."""
    inside, to = RULES[rule]
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=np.uint8), none, none, np.zeros(1, dtype=np.int64))
    _, bounds, body = texts.buffers()
    at = np.frombuffer(bounds, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(body, dtype=np.uint8)[at[0]:at[-1]] if body is not None else np.zeros(0, dtype=np.uint8)
    at = at - at[0]
    is_in = inside[raw]
    before = np.empty(len(raw), dtype=bool)
    before[:1], before[1:] = False, is_in[:-1]
    first = at[:-1][at[:-1] < len(raw)]
    before[first] = False
    starts = np.flatnonzero(is_in & ~before)
    after = np.empty(len(raw), dtype=bool)
    after[-1:], after[:-1] = False, is_in[1:]
    last = first[first > 0] - 1
    after[last] = False
    ends = np.flatnonzero(is_in & ~after) + 1
    return Words(to[raw], starts, ends, np.searchsorted(starts, at))
