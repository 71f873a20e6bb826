"""Word shingles of whole texts as 64-bit hashes, computed with numpy over many texts at once.

Words are maximal runs of bytes other than space and 0x09-0x0D, after lower-casing A-Z. All separators are ASCII, so
working on UTF-8 bytes gives the same words as working on code points. A text with fewer than ``k`` words has one
shingle, its whole word sequence; a text without words has none.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_U64 = (1 << 64) - 1
_CHUNK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values; arithmetic wraps."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers = both[0], both[1]
    return _powers


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in a byte buffer, and the byte offset at which each starts."""
    if not len(buf):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    sep = np.empty(len(buf) + 2, dtype=bool)
    sep[0] = sep[-1] = True
    sep[1:-1] = _IS_SEP[buf]
    edges = np.flatnonzero(sep[1:] != sep[:-1])
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _power_tables(len(buf) + 1)
    prefix = np.empty(len(buf) + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum(_BYTE[_LOWER[buf]] * power[: len(buf)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    return _mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), starts


def _combine(w: np.ndarray, n: int, k: int) -> np.ndarray:
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0xE7037ED1A0B428DB) + w[j : j + n]
    return _mix(acc + np.uint64(k))


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes (uint64)."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < _CHUNK):
            size += len(texts[end]) + 1
            end += 1
        out += _some_sets(texts[at:end], k)
        at = end
    return out


def _some_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    buf = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    w, starts = word_hashes(buf)
    limits = np.cumsum([len(t) + 1 for t in texts])
    to = np.searchsorted(starts, limits)
    whole = _combine(w, max(0, len(w) - k + 1), k)
    out, a = [], 0
    for b in to.tolist():
        n = b - a
        if n >= k:
            s = np.sort(whole[a : b - k + 1])
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif n:
            out.append(_combine(w[a:b], 1, n))
        else:
            out.append(np.empty(0, np.uint64))
        a = b
    return out
