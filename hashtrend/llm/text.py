"""Vectorised byte, word and n-gram helpers shared by the operators of this subpackage.

Everything works on flat numpy arrays built from one Arrow column: ``data`` (the concatenated UTF-8 bytes)
and ``offsets`` (where each text begins; one longer than the number of texts).  A null text counts as empty.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_P = 0x9E3779B97F4A7C15
_STRIP = 1 << 20

# Byte classes of the two word definitions in use.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: a word is a run of bytes other than space and \t \n \v \f \r
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: after lower-casing: digits, a-z and every byte of a non-ASCII character
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.binary())
    if not pa.types.is_large_binary(array.type):
        if not pa.types.is_binary(array.type):
            array = array.cast(pa.binary()) if pa.types.is_string(array.type) else array.cast(pa.large_binary())
        array = array.cast(pa.large_binary())
    if array.null_count:
        array = pc.fill_null(array, b"")
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, array.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def longs(column) -> np.ndarray:
    """An id column as int64; null counts as the largest value."""
    return pc.fill_null(column, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False) if isinstance(
        column, pa.Array
    ) else np.asarray(pc.fill_null(column, np.iinfo(np.int64).max).to_numpy())


NO_ID = np.iinfo(np.int64).max


def ids_out(values) -> pa.Array:
    """int64 ids back to Arrow, the largest value as null."""
    values = np.asarray(values, np.int64)
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (in place)."""
    z ^= z >> U64(32)
    z *= U64(0xD6E8FEB86659FD93)
    z ^= z >> U64(32)
    return z


@lru_cache(maxsize=8)
def _position_keys(size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (np.arange(1, size + 1, dtype=np.uint64)) * U64(_P)
        mix(z)
        mix(z)
    return z | U64(1)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Word spans: (starts, ends, first) with ``first[i]:first[i+1]`` the words of text ``i``; no word spans two texts."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    w = is_word[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    before[cut] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lens = ends - starts
    size = 64
    while size < lens.max():
        size *= 4
    keys = _position_keys(size)
    out = np.empty(len(starts), np.uint64)
    total = np.concatenate(([0], np.cumsum(lens)))
    lo = 0
    while lo < len(starts):  # a bounded number of bytes at a time
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + _STRIP, side="right")) - 1)
        at = total[lo:hi] - total[lo]
        inside = np.arange(total[hi] - total[lo], dtype=np.int64)
        inside -= np.repeat(at, lens[lo:hi])
        where = inside + np.repeat(starts[lo:hi], lens[lo:hi])
        with np.errstate(over="ignore"):
            value = data[where].astype(np.uint64)
            value += U64(1)
            value *= keys[inside]
            h = np.add.reduceat(value, at)
            h += lens[lo:hi].astype(np.uint64) * U64(0x2545F4914F6CDD1D)
            out[lo:hi] = mix(h)
        lo = hi
    return out


def shingles(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words (position i: words i .. i+size-1)."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = word_hash[:n].copy()
        for k in range(1, size):
            h *= U64(_P)
            h += word_hash[k : k + n]
            h ^= h >> U64(29)
        return mix(h)


def byte_grams(b: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k-byte substring, by doubling."""
    acc, have, size = None, 0, 1
    with np.errstate(over="ignore"):
        h = b.astype(np.uint64)
        h += U64(1)
        while True:
            if k & size:
                if acc is None:
                    acc, have = h, size
                else:
                    m = len(b) - have - size + 1
                    acc = acc[:m] * U64(pow(_P, size, 1 << 64)) + h[have : have + m]
                    have += size
            size *= 2
            if size > k:
                break
            half = size // 2
            h = h[:-half] * U64(pow(_P, half, 1 << 64)) + h[half:]
        z = acc[: len(b) - k + 1] * U64(0xA24BAED4963EE407)
        return mix(z)


def byte_grams_at(b: np.ndarray, k: int, pos: np.ndarray) -> np.ndarray:
    """Hashes of the k-byte substrings at the given ascending places, a bounded number of bytes at a time."""
    out = np.empty(len(pos), np.uint64)
    for lo in range(0, len(b), _STRIP):
        i, j = np.searchsorted(pos, (lo, lo + _STRIP))
        if j > i:
            out[i:j] = byte_grams(b[lo : lo + _STRIP + k - 1], k)[pos[i:j] - lo]
    return out


def sliding_min(z: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    span, m = 1, z
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + len)."""
    total = int(lens.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    at = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(starts - at, lens)
