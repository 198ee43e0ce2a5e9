"""Words and n-grams of whole Arrow batches as 64-bit hashes, in NumPy: no loop over words, none over documents.

A word is a run of letters, marks and digits in lower case, as in ``common.plain``.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE, INV = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SEGMENT = 1 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, SEGMENT)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(m - 1, b, U)])) for b in (BASE, INV)]
    return _powers[0], _powers[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if at else np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), off


def segments(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``SEGMENT`` that end at a space or at a row's end, so that no word is cut."""
    a, end = int(off[0]), int(off[-1])
    while a < end:
        b = min(end, a + SEGMENT)
        if b < end:
            row = int(off[np.searchsorted(off, b, "right") - 1])
            if row > a:
                b = row
            else:
                while b < end and data[b] != 32 and b not in off[np.searchsorted(off, b) : np.searchsorted(off, b) + 1]:
                    b += 1
        yield a, b
        a = b


@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    """For each code point, whether it is a letter, a mark or a digit."""
    return np.fromiter((unicodedata.category(chr(i))[0] in "LMN" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``buffers`` of the texts in lower case, with a space for every byte that isn't part of a word."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    try:
        texts = pc.utf8_lower(texts)
    except pa.ArrowInvalid:  # bytes that are no text
        texts = pa.array([None if t is None else t.decode("utf-8", "replace").lower() for t in texts.cast(pa.binary()).to_pylist()], pa.large_string())
    data, off = buffers(texts)
    lo, hi = int(off[0]), int(off[-1])
    data, off, inside = data[lo:hi].copy(), off - lo, _in_words()
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        point = data[lead].astype(np.int64) & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        for i in range(1, 4):
            more = size > i
            point[more] = point[more] << 6 | data[lead[more] + i] & 0x3F
        out = ~inside[np.minimum(point, sys.maxunicode)]
        for i in range(4):
            data[lead[out & (size > i)] + i] = 32
    ascii_ = np.arange(256, dtype=np.uint8)
    ascii_[:128][~inside[:128]] = 32
    return ascii_[data], off


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and for each row the place of its first word (n + 1 offsets)."""
    return split_words(*folded(texts))


def split_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``words`` of bytes, with spaces between words, and row offsets."""
    hashes, firsts = [], []
    for a, b in segments(data, off):
        x = data[a:b]
        n = len(x)
        w = np.zeros(n + 2, bool)
        w[1:-1] = x != 32
        cut = np.zeros(n + 1, bool)
        lo, hi = np.searchsorted(off, [a, b])
        rows = off[lo : hi + 1]
        cut[rows[(rows >= a) & (rows <= b)] - a] = True
        s = np.flatnonzero(w[1:-1] & (~w[:-2] | cut[:-1]))
        e = np.flatnonzero(w[1:-1] & (~w[2:] | cut[1:])) + 1
        p, q = powers(n)
        c = np.zeros(n + 1, U)
        np.cumsum((x.astype(U) + U(1)) * p[:n], out=c[1:])
        hashes.append(mix((c[e] - c[s]) * q[s] + (e - s).astype(U) * U(0x9FB21C651E98DF25)))
        firsts.append(s + a)
    h = np.concatenate(hashes) if hashes else np.zeros(0, U)
    s = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, off)


def ngrams(h: np.ndarray, at: np.ndarray, n: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words within each row, and the offsets by row.

    With ``whole``, a row of fewer than n words but at least one has one gram, of all its words.
    """
    if len(h) >= n and n > 1:
        g = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            g = g * BASE + h[i : len(h) - n + 1 + i]
        g = mix(g)
    else:
        g = h.copy() if n == 1 else h[:0]
    size = np.diff(at)
    keep = np.repeat(size >= n, size)[: len(g)]
    last = at[1:][size >= n]
    for i in range(1, n):
        keep[(last - i)[(last - i) < len(keep)]] = False
    count = np.maximum(size - n + 1, 0)
    g = g[keep]
    if whole and n > 1 and (short := np.flatnonzero((size > 0) & (size < n))).size:
        extra = np.zeros(len(short), U)
        for i in range(n - 1):
            has = size[short] > i
            extra[has] = extra[has] * BASE + h[at[short[has]] + i]
        new = np.concatenate([[0], np.cumsum(count)])
        g = np.insert(g, new[short], mix(extra ^ U(0xA5A5A5A5)))
        count[short] = 1
    return g, np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
