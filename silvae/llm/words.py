"""Vectorised word and shingle kernels over Arrow string columns (numpy, no per-word Python).

A batch of texts is handled as one byte buffer plus offsets. Work goes on in blocks of about
``BLOCK`` bytes, cut between texts or, in a long text, at a byte that is in no word, so memory
does not grow with the length of a text unless a single word is longer than a block.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that are separated by space and the control characters 9 to 13.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of digits, letters and everything beyond ASCII (after LOWER).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x41:0x5B] = True
ALNUM[0x80:] = True


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: np.uint64) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table(_P), table(_P_INV)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(column: pa.Array, limit: int = 1 << 20, beside: pa.Array | None = None):
    """(start, stop) row ranges of a string column, each of about ``limit`` bytes, those of a column ``beside`` included, or a single row."""
    _, offsets = buffers(column)
    if beside is not None:
        offsets = offsets + buffers(beside)[1]
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, stop
        start = stop


def _cuts(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    """Block borders: text borders, and in texts of over a block the first byte that is in no word after each block."""
    out = [offsets]
    for k in np.flatnonzero(np.diff(offsets) > 2 * BLOCK):
        at, end, extra = int(offsets[k]) + BLOCK, int(offsets[k + 1]), []
        while at < end:
            step = BLOCK
            free = np.flatnonzero(~is_word[data[at : min(at + step, end)]])
            if len(free):
                extra.append(at + int(free[0]))
                at = extra[-1] + BLOCK
            else:
                at += step
        out.append(np.array(extra, dtype=np.int64))
    return np.unique(np.concatenate(out))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word of the lower-cased texts, and each text's first word (len + 1)."""
    cuts = _cuts(data, offsets, is_word)
    starts, ends, hashes = [], [], []
    k = 0
    while k < len(cuts) - 1:
        last = int(np.searchsorted(cuts, cuts[k] + BLOCK, side="right")) - 1
        last = max(last, k + 1)
        a, b = int(cuts[k]), int(cuts[last])
        inner = cuts[k + 1 : last] - a
        k = last
        low = LOWER[data[a:b]]
        w = is_word[low]
        before, after = np.zeros(b - a, bool), np.zeros(b - a, bool)
        before[1:] = w[:-1]
        before[inner] = False
        after[:-1] = w[1:]
        after[inner - 1] = False
        s = np.flatnonzero(w & ~before)
        e = np.flatnonzero(w & ~after) + 1
        if not len(s):
            continue
        size = max(2 * BLOCK, b - a)
        power, inverse = _powers(size)
        total = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: b - a], out=total[1:])
        h = (total[e] - total[s]) * inverse[s]
        h ^= (e - s).astype(np.uint64) << np.uint64(56)
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(mix(h))
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    s, e, h = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    return s, e, h, np.searchsorted(s, offsets).astype(np.int64)


_TURN = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA6B9F0D3A27)]


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words; len(h) - size + 1 values (text borders are the caller's)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out *= _TURN[0]
        out += h[k : k + n]
        if k % 4 == 3:
            out ^= out >> np.uint64(29)
    return mix(out)


def shingle_sets(column: pa.Array, size: int = 5, is_word: np.ndarray = NOT_SPACE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes. Fewer than ``size`` words make one shingle; none make none."""
    data, offsets = buffers(column)
    _, _, h, first = words(data, offsets, is_word)
    g = grams(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        elif b > a:
            out.append(grams(h[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
