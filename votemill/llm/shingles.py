"""Words and shingles of many texts as 64-bit hashes, computed with numpy on whole buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, after A-Z went to lower case. Its hash is
a polynomial over random byte values modulo 2**64, taken from running sums, then mixed with its length.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        have = np.cumprod(have, dtype=U)
        if n <= 1 << 23:
            _powers[base] = have
    return have[:n]


class Words:
    """The words of many texts in one buffer: hash h, byte range [start, end) and, by text, the offsets off."""

    def __init__(self, texts: list[bytes]):
        lengths = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        space = _SPACE[raw]
        before = np.concatenate([[True], space[:-1]])
        start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        total = np.zeros(len(raw) + 1, U)
        np.cumsum(_BYTES[raw] * _power(_P, len(raw)), out=total[1:])
        h = (total[end] - total[start]) * _power(_INV, len(raw))[start]
        self.h = mix(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93))
        self.raw, self.start, self.end = raw, start, end
        self.first = np.cumsum(lengths + 1) - (lengths + 1)  # the byte at which each text starts
        self.off = np.append(np.searchsorted(start, self.first), len(start))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the offsets of each text's words."""
    words = Words(texts)
    return words.h, words.off


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each place where n are left (over text borders too)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = h[:m].copy()
    for k in range(1, n):
        out = out * U(0xA0761D6478BD642F) + h[k : k + m]
    return mix(out ^ U(n))


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: its n-word windows, or all its words if there are fewer."""
    h, off = word_hashes(texts)
    grams = ngrams(h, n)
    out = []
    for s, e in zip(off[:-1].tolist(), off[1:].tolist()):
        if e - s >= n:
            out.append(np.unique(grams[s : e - n + 1]))
        elif e > s:
            out.append(ngrams(h[s:e], e - s))
        else:
            out.append(grams[:0])
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))
