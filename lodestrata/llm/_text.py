"""Words of Arrow text columns as flat numpy arrays: no Python object for each word or document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _POW = np.cumprod(np.full(4096, 0x100000001B3, dtype=np.uint64))
    _STEP = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values and the offset of each value; null counts as empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    off = np.frombuffer(arr.buffers()[1], dtype=np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(arr: pa.Array, prefixes: tuple[int, ...] = ()) -> tuple:
    """A 64-bit hash of each word (a run of ASCII letters and digits and of any bytes above 127, in lower
    case) in order, and for each document the number of its first word, one more at the end. With
    ``prefixes`` also, for each of these lengths in bytes, the numbers of the words that are longer and a hash
    of their first bytes, so many."""
    none = np.zeros(0, np.uint64)
    bare = [(np.zeros(0, np.int64), none)] * len(prefixes)
    buf, off = flat(pc.utf8_lower(arr))
    n = len(buf)
    if not n:
        return none, np.zeros(len(off), np.int64), *[bare] * bool(prefixes)
    inside = _WORD[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < n]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return none, np.zeros(len(off), np.int64), *[bare] * bool(prefixes)
    at = np.zeros(n, dtype=np.int32)
    at[starts] = starts
    at = np.arange(n, dtype=np.int32) - np.maximum.accumulate(at)
    part = _POW[at & 4095]
    part *= buf.astype(np.uint64) + np.uint64(1)
    part[~inside] = 0
    found = mix(np.add.reduceat(part, starts)), np.searchsorted(starts, off)
    if not prefixes:
        return found
    total = np.cumsum(part)
    before = total[starts] - part[starts]
    more = []
    for size in prefixes:
        end = starts + size  # the byte after; in the same word if it is so far from the word's start
        own = np.flatnonzero((end < n) & inside[np.minimum(end, n - 1)] & (at[np.minimum(end, n - 1)] == size))
        more.append((own, mix(total[end[own] - 1] - before[own] + np.uint64(size))))
    return *found, more


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and for each document the number of its first run. A document
    of fewer words has one run, of all its words; one without words has none."""
    n = len(hashes)
    counts = np.diff(first)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    end = np.repeat(first[1:], counts)
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        m = n - j
        part = hashes[j:] * _STEP[j]
        if j:
            part[(np.arange(m) + j) >= end[:m]] = 0
        acc[:m] += part
    k = np.arange(n)
    keep = k + width <= end
    short = (counts > 0) & (counts < width)
    keep[first[:-1][short]] = True
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    return mix(acc[keep]), np.concatenate([[0], np.cumsum(runs)])
