"""Vectorised words, word hashes and word shingles over UTF-8 buffers.

A word is ``[^\\x20\\x09-\\x0D]+``; those bytes never occur inside a longer
UTF-8 sequence, so byte-wise splitting equals code-point-wise splitting.
"""

from __future__ import annotations

import numpy as np
import xxhash

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
LONG = 64  # bytes; longer words are hashed one by one

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_FOLDED = _BYTE[FOLD]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of the documents ``off`` delimits, and each document's first word."""
    lo, hi = int(off[0]), int(off[-1])
    inside = ~WHITE[buf[lo:hi]]
    if hi == lo:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = off[1:-1] - lo  # a document's edge also ends a word
    cut = cut[(cut > 0) & (cut < hi - lo)]
    begin[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    s = np.flatnonzero(begin) + lo
    return s, np.flatnonzero(end) + 1 + lo, np.searchsorted(s, off)


def span_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each byte span; ``fold`` makes A-Z equal a-z."""
    table = _BYTE_FOLDED if fold else _BYTE
    size = e - s
    order = np.argsort(np.uint8(LONG + 1) - np.minimum(size, LONG + 1).astype(np.uint8), kind="stable")
    at, left = s[order], np.minimum(size, LONG + 1)[order]
    n_long = int(np.searchsorted(-left, -LONG, "left"))
    h = np.zeros(len(s), np.uint64)
    more = np.searchsorted(-left, -np.arange(1, LONG + 1), "right")
    for t in range(LONG):
        k = int(more[t])
        if k == 0:
            break
        part = h[:k]
        part *= _STEP
        part += table[buf[at[:k] + t]]
    out = np.empty(len(s), np.uint64)
    out[order] = mix(h)
    for i in order[:n_long]:
        raw = buf[s[i] : e[i]]
        out[i] = xxhash.xxh3_64_intdigest((FOLD[raw] if fold else raw).tobytes())
    return out


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of one document's ``size``-word shingles in order; shorter ones are one shingle, no words none."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, size)
    total = words[: n - k + 1] * _PLACE[0]
    for j in range(1, k):
        total += words[j : n - k + 1 + j] * _PLACE[j]
    return mix(total + np.uint64(k))
