"""Vectorised text kernels shared by the corpus operators.

Texts arrive as Arrow batches and are read as one UTF-8 byte array with offsets. Words are the runs of
bytes outside ``0x20`` and ``0x09-0x0D``; in UTF-8 that is exactly ``[^\\x20\\x09-\\x0D]+`` over code points.
A word is known by 64-bit names: its blocks of eight bytes are each mixed with their place and a seed, and their sum
is mixed with the length; names of two seeds are independent. A run of words is known by a polynomial over
their names modulo the prime ``2**61 - 1`` with a random base, so two given runs of n words share a name with probability
n / 2**61, whatever their words (polynomials modulo a power of two collide on Thue-Morse sequences). Nulls read as
empty texts. Long batches are cut into slices of ``SLICE_BYTES``; a single longer text stays whole, with memory in
proportion to its size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 2_000_000
#: After so many bytes of text free memory is released.
RELEASE_BYTES = 16_000_000
_CHUNK = 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The low bytes of an eight-byte block, by how many of them belong to the word.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_rng = np.random.Generator(np.random.PCG64(20240607))
#: Seeds of the names of words, by kind.
_SEEDS = {kind: (U64(int(_rng.integers(1, 1 << 63)) * 2 + 1), U64(int(_rng.integers(1, 1 << 63)) * 2 + 1)) for kind in "ab"}
PRIME = (1 << 61) - 1
_BASES = {kind: int(_rng.integers(1 << 40, PRIME - 1)) for kind in "ab"}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}
_M32, _M29, _P = U64((1 << 32) - 1), U64((1 << 29) - 1), U64(PRIME)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo ``2**61 - 1`` of values below it."""
    a_low, a_high, b_low, b_high = a & _M32, a >> U64(32), b & _M32, b >> U64(32)
    middle = a_low * b_high + a_high * b_low
    low = a_low * b_low
    out = (a_high * b_high << U64(3)) + (middle >> U64(29)) + ((middle & _M29) << U64(32)) + (low & _P) + (low >> U64(61))
    return reduced(out)


def reduced(x: np.ndarray) -> np.ndarray:
    """Any values modulo ``2**61 - 1``."""
    x = (x & _P) + (x >> U64(61))
    return np.where(x >= _P, x - _P, x)


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a fixed base and of its inverse, modulo ``2**61 - 1``."""
    held = _POWERS.get(kind)
    if held is None or len(held[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        both = []
        for base in (_BASES[kind], pow(_BASES[kind], -1, PRIME)):
            p, have = np.ones(size, np.uint64), 1
            while have < size:
                step = min(have, size - have)
                p[have : have + step] = times(p[:step], U64(pow(base, have, PRIME)))
                have += step
            both.append(p)
        held = (both[0], both[1])
        if size <= 1 << 20:  # the tables of longer texts go with them
            _POWERS[kind] = held
    return held[0][:n], held[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte array and n + 1 offsets of a string or binary column; nulls are empty."""
    column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives the memory that Arrow's pool and the allocator hold without use back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


_read = 0


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, and one row at least; free memory is released now and then."""
    global _read
    at = batch.schema.get_field_index(text)
    _, offsets = utf8(batch.column(at))
    k = 0
    while k < batch.num_rows:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + limit, "right")) - 1)
        yield batch.slice(k, end - k)
        _read += int(offsets[end] - offsets[k])
        if _read >= RELEASE_BYTES:
            _read = 0
            release()
        k = end


@dataclass
class Words:
    """Words of a slice: byte ranges, fingerprints, and for each text the index of its first word (n + 1 values)."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    name: np.ndarray
    first: np.ndarray

    @property
    def of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of all words; a text's end ends its last word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def fingerprints(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: str = "a") -> np.ndarray:
    """Names of the byte ranges, which must not be empty."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
    by, seed = _SEEDS[kind]
    n_blocks = (end - start + 7) >> 3
    first = np.concatenate(([0], np.cumsum(n_blocks)))
    low = 0
    while low < len(start):
        high = max(low + 1, int(np.searchsorted(first, first[low] + _CHUNK, "right")) - 1)
        n, s, e = n_blocks[low:high], start[low:high], end[low:high]
        begin = first[low:high] - first[low]
        if int(n.max()) == 1:
            block = mix((eight[s] & _LOW[e - s]) * by + seed)
        else:
            k = np.arange(first[high] - first[low]) - np.repeat(begin, n)
            at = np.repeat(s, n) + 8 * k
            block = eight[at] & _LOW[np.minimum(np.repeat(e, n) - at, 8)]
            block = mix(mix(block * by + seed) + k.astype(np.uint64) * U64(0x9E3779B97F4A7C15))
            single = n == 1  # as in a part where all words are short
            block = np.add.reduceat(block, begin)
            block[single] = mix((eight[s[single]] & _LOW[(e - s)[single]]) * by + seed)
        out[low:high] = mix(block + (e - s).astype(np.uint64) * U64(0xA0761D6478BD642F))
        low = high
    return out


def words(column: pa.Array) -> Words:
    data, offsets = utf8(column)
    start, end = spans(data, offsets)
    return Words(data, offsets, start, end, fingerprints(data, start, end), np.searchsorted(start, offsets))


def grams(names: np.ndarray, size: int) -> np.ndarray:
    """Names of all runs of ``size`` consecutive items, wherever they begin (sums with random odd factors, mixed)."""
    n = max(0, len(names) - size + 1)
    out = np.zeros(n, np.uint64)
    rng = np.random.Generator(np.random.PCG64(size))
    for k in range(size):
        out += names[k : k + n] * U64(int(rng.integers(1, 1 << 63)) * 2 + 1)
    return mix(out + U64(size))


class Runs:
    """Names of any run of consecutive items of an array of names."""

    def __init__(self, names: np.ndarray, kind: str = "a"):
        n = len(names)
        p, self.inverse = powers(kind, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        low, high = U64(0), U64(0)
        for k in range(0, n, _CHUNK):
            part = times(reduced(names[k : k + _CHUNK]), p[k : min(k + _CHUNK, n)])
            lows, highs = np.cumsum(part & _M32) + low, np.cumsum(part >> U64(32)) + high
            # sums of high parts stay below 2**61: the multiples of 2**29 among them count as ones
            self.sums[k + 1 : k + 1 + len(part)] = reduced(((highs & _M29) << U64(32)) + (highs >> U64(29)) + lows)
            low, high = lows[-1], highs[-1]

    def __call__(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        salt = (np.asarray(end - start).astype(np.uint64) * U64(0xE7037ED1A0B428DB)) + np.asarray(salt).astype(np.uint64)
        difference = self.sums[end] + (_P - self.sums[start])
        return mix(times(np.where(difference >= _P, difference - _P, difference), self.inverse[start]) + salt)
