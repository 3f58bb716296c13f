"""Whole-batch text scanning with numpy.

Arrow string columns are viewed as one byte buffer plus row offsets, so words,
word hashes and n-gram hashes of thousands of documents come out of a handful
of vectorised passes instead of a Python loop over words.  All functions take
whole texts; a null text is the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_SEED = 0x5DEECE66D


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix64 = _mixed

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MULT = 0xD1342543DE82EF95 | 1
_TAB = _mixed(np.arange(1, 257, dtype=np.uint64) * _GOLD + np.uint64(_SEED))
_pow: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse modulo 2**64; those that a chunk needs are kept, more (of one very long text) are not."""
    if not _pow or len(_pow[0]) < n:
        both = np.empty((2, max(n, CHUNK_BYTES + 1)), np.uint64)
        both[0], both[1] = np.uint64(_MULT), np.uint64(pow(_MULT, -1, 1 << 64))
        both[:, 0] = 1
        for x in both:
            np.cumprod(x, out=x)
        if n > CHUNK_BYTES + 1:
            return both[0], both[1]
        _pow[:] = list(both)
    return _pow[0], _pow[1]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: letters, digits and every non-ASCII byte
WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: everything but the six ASCII blanks
NONBLANK = ~byte_class((0x09, 0x0D), (0x20, 0x20))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_TAB_LOWER = _TAB[LOWER]


class Chunk:
    """Some consecutive rows of a batch: their bytes and the offsets of each."""

    def __init__(self, first_row: int, buf: np.ndarray, offsets: np.ndarray):
        self.first_row, self.buf, self.offsets = first_row, buf, offsets
        self.n_rows = len(offsets) - 1

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte start and end of every maximal run of ``inside`` bytes, and for each row where its words begin in these arrays (one entry more than rows)."""
        n, off = len(self.buf), self.offsets
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n_rows + 1, np.int64)
        is_in = inside[self.buf]
        s, e = is_in.copy(), is_in.copy()
        s[1:] &= ~is_in[:-1]
        e[:-1] &= ~is_in[1:]
        edge = off[(off > 0) & (off < n)]
        s[edge] = is_in[edge]
        e[edge - 1] = is_in[edge - 1]
        starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
        return starts, ends, np.searchsorted(starts, off)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of the bytes of each span, A-Z read as a-z where ``lower``."""
        n = len(self.buf)
        p, inv = _powers(n + 1)
        h = np.empty(n + 1, np.uint64)
        h[0] = 0
        np.cumsum((_TAB_LOWER if lower else _TAB)[self.buf] * p[:n], out=h[1:])
        return _mixed((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * _GOLD)


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Splits a string column into chunks of about ``max_bytes``; a row is never cut, so one longer text is a chunk alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n, lo + 65536)
        yield Chunk(lo, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def row_of(word_off: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(word_off) - 1), np.diff(word_off))


def ngrams(h: np.ndarray, word_off: np.ndarray, n: int, whole_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of n words.  ``whole_short``: a row of fewer words, but not none, counts as one run."""
    total, counts = len(h), np.diff(word_off)
    rows = np.repeat(np.arange(len(counts)), counts)
    if total >= n:
        g = h[: total - n + 1] * _GOLD
        for i in range(1, n):
            g = (g ^ (g >> np.uint64(29))) * np.uint64(_MULT) + h[i : total - n + 1 + i]
        ok = (np.repeat(word_off[1:], counts) - np.arange(total))[: total - n + 1] >= n
        g, r = _mixed(g[ok]), rows[: total - n + 1][ok]
    else:
        g, r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if whole_short:
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            at = word_off[short]
            s = np.zeros(len(short), np.uint64)
            for i in range(n - 1):
                more = counts[short] > i
                s[more] = (s[more] ^ (s[more] >> np.uint64(29))) * np.uint64(_MULT) + h[at[more] + i]
            g, r = np.concatenate((g, _mixed(s + _GOLD))), np.concatenate((r, short))
    return g, r


def row_digest(h: np.ndarray, word_off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the sequence of words of each row (0: no words)."""
    n = len(h)
    p, inv = _powers(n + 1)
    c = np.empty(n + 1, np.uint64)
    c[0] = 0
    np.cumsum(h * p[:n], out=c[1:])
    counts = np.diff(word_off)
    out = _mixed((c[word_off[1:]] - c[word_off[:-1]]) * inv[np.minimum(word_off[:-1], n)] + counts.astype(np.uint64) * _GOLD)
    out[counts == 0] = 0
    return out


def counted(rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) and how often each occurs, by row and hash."""
    if not len(h):
        return rows, h, np.zeros(0, np.int64)
    order = np.lexsort((h, rows))
    r, x = rows[order], h[order]
    first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (x[1:] != x[:-1]))))
    return r[first], x[first], np.diff(np.append(first, len(r)))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
