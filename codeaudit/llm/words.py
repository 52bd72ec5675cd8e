"""Words of UTF-8 texts as 64-bit hashes, and hashes of word runs, in numpy.

A word is a maximal run of bytes that `table` maps to non-zero; the mapped
(case-folded) bytes are what is hashed.  Every byte above 0x7F maps to itself
where non-ASCII characters belong to words, so byte classes and character
classes agree.  Hashes are polynomials modulo 2**64 with a final mix.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 21
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _table(is_word) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for c in range(1, 256):
        if is_word(c):
            t[c] = c + 32 if 65 <= c <= 90 else c
    return t


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased.
ALNUM = _table(lambda c: c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)
#: [^\x20\x09-\x0D]+ of the text with A-Z lower-cased.  Byte 0 is a word byte
#: too and shares its code with 0xFF, which no UTF-8 text holds.
SPACED = _table(lambda c: c != 32 and not 9 <= c <= 13)
SPACED[0] = 255


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _INVERSE)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _segment(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f = table[data]
    inside = np.zeros(len(f) + 2, bool)
    np.not_equal(f, 0, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    p, q = _power(len(f) + 1)
    total = np.zeros(len(f) + 1, np.uint64)
    np.cumsum(_CODE[f] * p[:-1], out=total[1:])
    return start, end, mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))


def words(text: bytes | None, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of `text`; starts and ends in bytes.
    Long texts go through in pieces cut between words, in bounded memory."""
    data = np.frombuffer(text or b"", np.uint8)
    if len(data) <= _CHUNK:
        return _segment(data, table)
    parts, at = [], 0
    while at < len(data):
        cut = min(at + _CHUNK, len(data))
        while cut < len(data) and table[data[cut]]:
            gap = np.flatnonzero(table[data[cut:cut + _CHUNK]] == 0)
            cut = cut + int(gap[0]) if len(gap) else min(cut + _CHUNK, len(data))
        s, e, h = _segment(data[at:cut], table)
        parts.append((s + at, e + at, h))
        at = cut
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of `k` neighbouring words; empty if there are fewer."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    p, q = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * p[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * q[:n - k + 1])


def _sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    size, m = 1, a
    while size * 2 <= w:
        m = op(m[:-size], m[size:])
        size *= 2
    return m if size == w else op(m[:len(a) - w + 1], m[w - size:w - size + len(a) - w + 1])


def minimisers(h: np.ndarray, w: int) -> np.ndarray:
    """Positions whose value is the least of some window of `w` neighbours
    (every tied position); all of a shorter, non-empty row is one window."""
    if not len(h):
        return np.zeros(0, np.int64)
    w = min(w, len(h))
    low = _sliding(h, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), w, np.maximum) == h)
