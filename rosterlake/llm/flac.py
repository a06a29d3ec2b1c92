"""Media columns in FLAC.

``Stream.decode`` reads a native FLAC stream of one or more channels: it checks the header CRC-8 and frame CRC-16 of every
frame and the stream's MD5, decodes constant, verbatim, fixed and linear-predictor subframes with Rice residuals
of both kinds, and gives PCM samples with the place of each block, so readers can seek. ``encode`` writes mono 8-bit
streams of blocks of 576 samples with fixed predictors, a Rice parameter for each block and a seek table.

All streams of a slice are worked on at once: bits are arrays over all blocks, predictors are differences and running sums along
blocks, checksums go byte by byte over all frames, and Rice codes are decoded in lockstep, the next code of every block
in one step. Memory follows ``SLICE`` bytes, not the table. A text that is longer than a slice is coded in one piece.

Edge cases: a null or empty text is one block of padding; texts that aren't multiples of 576 are padded with byte 255; equal
texts give equal streams; a stream with a wrong checksum or an unfinished frame raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import slices, utf8

BLOCK, SLICE, RATE = 576, 1_000_000, 8000
#: Seek points a stream carries at most, as the format has no bound: one for each so many blocks.
SEEK_BLOCKS = 64


def _table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for x in range(256):
        c = x << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly) if c >> (bits - 1) & 1 else c << 1
        out[x] = c & ((1 << bits) - 1)
    return out


#: CRC polynomials of the format.
_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for x in data:
        c = int(_CRC8[c ^ x])
    return c


def crc16s(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of each byte range; ranges of any lengths, in lockstep from the longest down."""
    order = np.argsort(start - end, kind="stable")
    s, n = start[order], (end - start)[order]
    c, live = np.zeros(len(s), np.uint32), len(s)
    for k in range(int(n[0]) if len(n) else 0):
        while live and n[live - 1] <= k:
            live -= 1
        x = c[:live]
        c[:live] = (x << 8 & 0xFFFF) ^ _CRC16[(x >> 8) ^ data[s[:live] + k]]
    out = np.empty_like(c)
    out[order] = c
    return out


def _number(k: int) -> bytes:
    """A frame number in the format's UTF-8 like code."""
    if k < 0x80:
        return bytes((k,))
    n = next(n for n in range(2, 8) if k < 1 << (5 * n + 1))
    tail = [0x80 | k >> 6 * j & 0x3F for j in range(n - 2, -1, -1)]
    return bytes(((0xFF00 >> n & 0xFF) | k >> 6 * (n - 1), *tail))


_HEADERS: dict[int, bytes] = {}


def _header(k: int) -> bytes:
    """Header of the k-th block: fixed block size 576, rate from the stream, mono, 8 bits."""
    held = _HEADERS.get(k)
    if held is None:
        head = bytes((0xFF, 0xF8, 0x20, 0x02)) + _number(k)
        held = head + bytes((crc8(head),))
        if len(_HEADERS) < 1 << 16:
            _HEADERS[k] = held
    return held


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = values >> (width - 1 - j) & 1


def encode(payloads: list[bytes]) -> list[bytes]:
    """Streams of 8-bit payloads (sample = byte - 128) whose lengths are positive multiples of ``BLOCK``."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK).astype(np.int32) - 128
    frames = len(x)
    first = np.diff(x, axis=1, prepend=0)
    second = np.diff(first, axis=1, prepend=0)
    candidates = [x, first, second]
    cost = np.stack([np.abs(r[:, k:]).sum(1) for k, r in enumerate(candidates)])
    order = cost.argmin(0)
    residual = x.copy()
    for k in (1, 2):
        residual[order == k] = candidates[k][order == k]
    warm = np.arange(BLOCK)[None, :] < order[:, None]
    z = np.where(warm, 0, residual << 1 ^ residual >> 31).astype(np.int64)  # zigzag
    sizes = np.stack([((z >> k) + 1 + k).sum(1) for k in range(8)]) - (order * (1 + np.arange(8)[:, None]))
    k = sizes.argmin(0)
    coded = np.where(warm, 8, (z >> k[:, None]) + 1 + k[:, None])
    constant = (x == x[:, :1]).all(1)
    body = 8 + 10 + coded.sum(1)  # subframe header, method + order + parameter, samples
    verbatim = ~constant & (body > 8 + 8 * BLOCK)
    rice = ~constant & ~verbatim
    body = np.where(constant, 16, np.where(verbatim, 8 + 8 * BLOCK, body))
    number = np.arange(frames) - np.repeat(np.cumsum(counts) - counts, counts)
    heads = [_header(int(j)) for j in number]
    head_size = np.fromiter(map(len, heads), np.int64, frames)
    size = head_size + (body + 7) // 8 + 2
    start = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()) * 8, np.uint8)
    at = (start + head_size) * 8
    kind = np.where(constant, 0, np.where(verbatim, 2, 16 + 2 * order))
    _put(bits, at, kind, 8)
    _put(bits, at[constant] + 8, x[constant, 0] & 0xFF, 8)
    if verbatim.any():
        _put(bits, (at[verbatim] + 8)[:, None] + 8 * np.arange(BLOCK), x[verbatim] & 0xFF, 8)
    if rice.any():
        coded, z, order, k, x, at = coded[rice], z[rice], order[rice], k[rice], x[rice], at[rice]
        ends = np.cumsum(coded, 1)
        place = at[:, None] + 8 + np.where(warm[rice], 0, 10) + ends - coded
        for j in (0, 1):
            rows = np.flatnonzero(order > j)
            _put(bits, place[rows, j], x[rows, j] & 0xFF, 8)
        # method 0 (2 bits) and partition order 0 (4 bits) are zeros
        _put(bits, at + 8 + 8 * order + 6, k, 4)
        live = ~warm[rice]
        place, z, of = place[live], z[live], np.broadcast_to(k[:, None], live.shape)[live]
        stop = place + (z >> of)
        bits[stop] = 1
        for width in np.unique(of).tolist():
            rows = np.flatnonzero(of == width)
            _put(bits, stop[rows] + 1, z[rows], width)
    data = np.packbits(bits)
    joined, into = np.frombuffer(b"".join(heads), np.uint8), np.arange(int(head_size.sum()))
    data[into - np.repeat(np.cumsum(head_size) - head_size, head_size) + np.repeat(start, head_size)] = joined
    crc = crc16s(data, start, start + size - 2)
    data[start + size - 2], data[start + size - 1] = crc >> 8, crc & 0xFF
    raw, out, f = data.tobytes(), [], 0
    for payload, n in zip(payloads, counts.tolist(), strict=True):
        at, sizes = int(start[f]), size[f : f + n]
        info = (BLOCK << 16 | BLOCK).to_bytes(4, "big") + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | n * BLOCK).to_bytes(8, "big")
        info += hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        points = b"".join(
            (j * BLOCK).to_bytes(8, "big") + (int(start[f + j]) - at).to_bytes(8, "big") + BLOCK.to_bytes(2, "big") for j in range(0, n, SEEK_BLOCKS)
        )
        stop = int(start[f + n - 1] + size[f + n - 1])
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + raw[at:stop])
        f += n
    return out


@dataclass
class Pcm:
    """Samples (blocks one after the other, channels side by side), first sample and byte of each block, bits a sample."""

    samples: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    bits: int
    rate: int


class _Bits:
    """Reads at many places at once; positions are in bits."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate((data, np.zeros(16, np.uint8)))
        self.n = 8 * len(data)
        windows = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data) + 8]
        self.words = np.ascontiguousarray(windows).view(">u8").ravel().astype(np.uint64)
        self.data = data

    @cached_property
    def ones(self) -> np.ndarray:
        """Places of all set bits, then the end."""
        return np.append(np.flatnonzero(np.unpackbits(self.data)), self.n)

    def get(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Up to 56 bits each."""
        width = np.asarray(width, np.uint64)
        word = self.words[at >> 3] << (at & 7).astype(np.uint64)
        return np.where(width > 0, word >> np.minimum(np.uint64(64) - width, np.uint64(63)), np.uint64(0)).astype(np.int64)


def _signed(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return x - (x >> (bits - 1) << bits)


def _utf8_number(data: memoryview, at: int) -> tuple[int, int]:
    lead = data[at]
    n = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if n == 1 or n > 7:
        raise ValueError("a frame's number is wrong")
    value = lead if not n else lead & (0x7F >> n)
    for x in data[at + 1 : at + max(1, n)]:
        value = value << 6 | x & 0x3F
    return value, at + max(1, n)


#: Block sizes and bits a sample by their codes.
_SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}


class Stream:
    """A parsed stream: metadata, and frames found by their headers' checksums and their own."""

    def __init__(self, data: bytes):
        self.data, view = data, memoryview(data)
        if data[:4] != b"fLaC":
            raise ValueError("not FLAC")
        at, last, self.seek = 4, False, []
        while not last:
            last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(view[at + 1 : at + 4], "big")
            body = view[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.bits, self.n = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
                self.least, self.md5 = int.from_bytes(body[4:7], "big"), bytes(body[18:34])
                self.most_block = int.from_bytes(body[2:4], "big")
            elif kind == 3:
                self.seek = [(int.from_bytes(body[j : j + 8], "big"), int.from_bytes(body[j + 8 : j + 16], "big")) for j in range(0, size, 18)]
            at += 4 + size
        self.audio = at

    def header(self, at: int) -> tuple[int, int, int, int] | None:
        """(first sample, samples, channel code, end of the header) if a frame header is at ``at``."""
        view = memoryview(self.data)
        if at + 6 > len(view) or view[at] != 0xFF or view[at + 1] & 0xFE != 0xF8 or view[at + 3] & 1:
            return None
        size, rate = view[at + 2] >> 4, view[at + 2] & 15
        try:
            number, end = _utf8_number(view, at + 4)
        except (ValueError, IndexError):
            return None
        block = _SIZES.get(size)
        if size in (6, 7):
            block, end = int.from_bytes(view[end : end + size - 5], "big") + 1, end + size - 5
        end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
        if block is None or end >= len(view) or crc8(view[at:end]) != view[end]:
            return None
        first = number if view[at + 1] & 1 else number * self.most_block
        return first, block, view[at + 3] >> 4, end + 1


def _one_partition(bits: _Bits, at: np.ndarray, k: np.ndarray, order: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``_residuals`` for one size of block, one Rice parameter each and no escapes."""
    at, z, rows = at.copy(), np.zeros((width, len(at)), np.int64), np.arange(len(at))
    low, shift = (np.int64(1) << k) - 1, (63 - k).astype(np.uint64)
    for j in range(width):
        if j >= width - order.max(initial=0):
            rows = np.flatnonzero(order + j < width)
            if not len(rows):
                break
        p = at[rows]
        word = bits.words[p >> 3] << (p & 7).astype(np.uint64)
        # the exponent of the upper 52 bits tells how many zeros lead
        zeros = 52 - np.frexp((word >> np.uint64(12)).astype(np.float64))[1].astype(np.int64)
        rest = (word << (zeros + 1).astype(np.uint64)) >> np.uint64(1)
        value = zeros << k[rows] | (rest >> shift[rows]).astype(np.int64) & low[rows]
        long = np.flatnonzero((zeros >= 52) | (zeros + 1 + k[rows] > 56))
        if len(long):
            stop = bits.ones[np.searchsorted(bits.ones, p[long])]
            if (stop >= bits.n).any():
                raise ValueError("an unfinished frame")
            zeros[long] = stop - p[long]
            value[long] = zeros[long] << k[rows][long] | bits.get(stop + 1, k[rows][long])
        z[j, rows] = value
        at[rows] = p + zeros + 1 + k[rows]
    z = z >> 1 ^ -(z & 1)
    out = np.zeros((len(at), width), np.int64)
    for n in np.unique(order).tolist():
        rows = np.flatnonzero(order == n)
        out[rows, n:] = z[: width - n, rows].T
    return out, at


def _residuals(bits: _Bits, at: np.ndarray, block: np.ndarray, order: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rice coded residuals of all subframes in lockstep (places before ``order`` stay 0), and where each ends."""
    method = bits.get(at, 2)
    if (method > 1).any():
        raise ValueError("unknown residual coding")
    parts = bits.get(at + 2, 4)
    at = at + 6
    field = 4 + method
    if not parts.any() and (block == width).all() and not ((k := bits.get(at, field)) == (1 << field) - 1).any():
        return _one_partition(bits, at + field, k, order, width)
    out = np.zeros((len(at), width), np.int64)
    in_part = block >> parts
    k, raw = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
    nxt = order.copy()
    next_part = np.zeros(len(at), np.int64)  # sample at which the next parameter is read
    rows_all = np.arange(len(at))
    for _ in range(width):
        rows = rows_all[nxt < block]
        if not len(rows):
            break
        fresh = rows[(nxt[rows] >= next_part[rows])]
        while len(fresh):
            k[fresh] = bits.get(at[fresh], field[fresh])
            at[fresh] += field[fresh]
            escape = k[fresh] == (1 << field[fresh]) - 1
            raw[fresh] = np.where(escape, bits.get(at[fresh], 5), -1)
            at[fresh] += np.where(escape, 5, 0)
            next_part[fresh] += in_part[fresh]
            fresh = fresh[next_part[fresh] <= nxt[fresh]]
        p, kk, rr = at[rows], k[rows], raw[rows]
        plain = rr >= 0
        stop = bits.ones[np.searchsorted(bits.ones, p)]
        if (stop[~plain] >= bits.n).any():
            raise ValueError("an unfinished frame")
        z = (stop - p) << kk | bits.get(stop + 1, np.where(plain, 0, kk))
        value = z >> 1 ^ -(z & 1)
        if plain.any():
            exact = bits.get(p, np.maximum(rr, 0))
            value = np.where(plain, np.where(rr > 0, _signed(exact, np.maximum(rr, 1)), 0), value)
        at[rows] = np.where(plain, p + np.maximum(rr, 0), stop + 1 + kk)
        out[rows, nxt[rows]] = value
        nxt[rows] += 1
    return out, at


def _predict(x: np.ndarray, order: np.ndarray) -> None:
    """Undoes fixed predictors in place: ``x`` has warm-up samples, then residuals."""
    for n in np.unique(order).tolist():
        rows = np.flatnonzero(order == n)
        y = x[rows]
        # the warm-up's own differences, then n running sums
        for j in range(n):
            y[:, j + 1 : n] = np.diff(y[:, j:n], axis=1) if n - j > 1 else y[:, j + 1 : n]
        for j in range(n - 1, -1, -1):
            y[:, j:] = np.cumsum(y[:, j:], axis=1)
        x[rows] = y


def _subframes(bits: _Bits, at: np.ndarray, block: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of one subframe for each place, and the bit where each ends."""
    kind, wasted = bits.get(at + 1, 6), bits.get(at + 7, 1)
    at = at + 8
    some = np.flatnonzero(wasted)
    if len(some):
        stop = bits.ones[np.searchsorted(bits.ones, at[some])]
        wasted[some], at[some] = stop - at[some] + 1, stop + 1
    depth, width = depth - wasted, int(block.max())
    x = np.zeros((len(at), width), np.int64)
    inside = np.arange(width)[None, :] < block[:, None]
    for rows in [np.flatnonzero(kind == 0)]:
        x[rows] = _signed(bits.get(at[rows], depth[rows]), depth[rows])[:, None]
        at[rows] += depth[rows]
    for rows in [np.flatnonzero(kind == 1)]:
        if len(rows):
            where = at[rows][:, None] + depth[rows][:, None] * np.arange(width)
            x[rows] = _signed(bits.get(np.minimum(where, bits.n - 1), depth[rows][:, None]), depth[rows][:, None])
            at[rows] += depth[rows] * block[rows]
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | linear | (kind < 2)).all():
        raise ValueError("an unknown subframe")
    coded = np.flatnonzero(fixed | linear)
    if len(coded):
        order = np.where(fixed, kind - 8, kind - 31)[coded]
        warm = np.zeros((len(coded), int(order.max()) if len(order) else 0), np.int64)
        for j in range(warm.shape[1]):
            rows = np.flatnonzero(order > j)
            warm[rows, j] = _signed(bits.get(at[coded[rows]], depth[coded[rows]]), depth[coded[rows]])
            at[coded[rows]] += depth[coded[rows]]
        is_linear = linear[coded]
        lpc = coded[is_linear]
        coefficients, shift = np.zeros((len(lpc), 32), np.int64), np.zeros(len(lpc), np.int64)
        if len(lpc):
            precision = bits.get(at[lpc], 4) + 1
            shift = _signed(bits.get(at[lpc] + 4, 5), np.full(len(lpc), 5))
            at[lpc] += 9
            for j in range(32):
                rows = np.flatnonzero(order[is_linear] > j)
                coefficients[rows, j] = _signed(bits.get(at[lpc[rows]], precision[rows]), precision[rows])
                at[lpc[rows]] += precision[rows]
        y, at[coded] = _residuals(bits, at[coded], block[coded], order, width)
        for j in range(warm.shape[1]):
            rows = np.flatnonzero(order > j)
            y[rows, j] = warm[rows, j]
        rows = np.flatnonzero(~is_linear)
        fixed_rows = y[rows]
        _predict(fixed_rows, order[rows])
        y[rows] = fixed_rows
        if len(lpc):
            z, n = y[is_linear], order[is_linear]
            for t in range(1, width):
                rows = np.flatnonzero(n <= t)
                back = np.minimum(32, t)
                z[rows, t] += (coefficients[rows, :back] * z[rows, t - back : t][:, ::-1]).sum(1) >> shift[rows]
            y[is_linear] = z
        x[coded] = y
    x <<= wasted[:, None]
    x[~inside] = 0
    return x, at


def _frames(stream: Stream, careful: bool) -> list[tuple[int, tuple[int, int, int, int]]]:
    """Place and header of each frame. A frame ends where the header of the next block begins or the stream ends;
    ``careful`` also asks that the frame's checksum is right there."""
    data, at, out = stream.data, stream.audio, []
    head = stream.header(at) if at < len(data) else None
    if at < len(data) and head is None:
        raise ValueError("no frame where one should be")
    while head is not None:
        out.append((at, head))
        want, k, head = head[0] + head[1], data.find(b"\xff", max(head[3], at + stream.least)), None
        while k >= 0:
            found = stream.header(k)
            if found is not None and found[0] == want and not (careful and _crc16(data[at : k - 2]) != int.from_bytes(data[k - 2 : k], "big")):
                at, head = k, found
                break
            k = data.find(b"\xff", k + 1)
    return out


def _crc16(data: bytes) -> int:
    return int(crc16s(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])


def decode(streams: list[bytes]) -> list[Pcm]:
    """PCM of each stream; raises ``ValueError`` where a checksum or the number of samples is wrong."""
    parsed = [Stream(s) for s in streams]
    base = np.cumsum([0, *map(len, streams)])
    data = np.frombuffer(b"".join(streams), np.uint8)
    bits = _Bits(data)
    frames, careful = [_frames(p, False) for p in parsed], False
    while True:
        of = np.repeat(np.arange(len(parsed)), [len(f) for f in frames])
        heads = [head for f in frames for _, head in f]
        start = base[of] + np.array([at for f in frames for at, _ in f], np.int64)
        end = np.append(start[1:], 0)
        last = np.append(of[1:] != of[:-1], True)[: len(of)]
        end[: len(of)][last] = base[1:][of[last]]
        end = end[: len(of)]
        wrong = crc16s(data, start, end - 2) != (data[end - 2].astype(np.uint32) << 8 | data[end - 1])
        if not wrong.any():
            break
        if careful:
            raise ValueError("a frame's checksum is wrong")
        for s in np.unique(of[wrong]).tolist():  # samples that look like a header are rare
            frames[s] = _frames(parsed[s], True)
        careful = True
    block = np.array([h[1] for h in heads], np.int64)
    code = np.array([h[2] for h in heads], np.int64)
    at = 8 * (base[of] + np.array([h[3] for h in heads], np.int64))
    channels = np.where(code < 8, code + 1, 2)
    depth = np.array([p.bits for p in parsed], np.int64)[of]
    most = int(channels.max()) if len(channels) else 1
    samples = np.zeros((most, len(start), int(block.max()) if len(block) else 0), np.int64)
    for c in range(most):
        rows = np.flatnonzero(channels > c)
        side = (code[rows] == 8) & (c == 1) | (code[rows] == 9) & (c == 0) | (code[rows] == 10) & (c == 1)
        samples[c, rows], at[rows] = _subframes(bits, at[rows], block[rows], depth[rows] + side)
    if most > 1:
        a, b = samples[0], samples[1]
        for kind in (8, 9, 10):
            rows = np.flatnonzero(code == kind)
            if kind == 8:
                b[rows] = a[rows] - b[rows]
            elif kind == 9:
                a[rows] += b[rows]
            else:
                mid = a[rows] << 1 | b[rows] & 1
                a[rows], b[rows] = (mid + b[rows]) >> 1, (mid - b[rows]) >> 1
    if ((at + 7) // 8 != end - 2).any():
        raise ValueError("a frame doesn't end where it should")
    out, first_row = [], np.searchsorted(of, np.arange(len(parsed) + 1))
    for s, stream in enumerate(parsed):
        rows = slice(first_row[s], first_row[s + 1])
        size = block[rows]
        if len(size) and (size == size[0]).all():
            pcm = samples[: stream.channels, rows, : size[0]].reshape(stream.channels, -1).T
        else:
            pcm = np.concatenate([samples[: stream.channels, f, : block[f]].T for f in range(*rows.indices(len(of)))] or [np.zeros((0, stream.channels), np.int64)])
        if len(pcm) != stream.n or any(stream.md5) and hashlib.md5(_little(pcm, stream.bits)).digest() != stream.md5:
            raise ValueError("the samples aren't what was written")
        out.append(Pcm(pcm, np.cumsum(size) - size, start[rows] - base[s], stream.bits, stream.rate))
    return out


def _little(pcm: np.ndarray, bits: int) -> bytes:
    width = (bits + 7) // 8
    return np.ascontiguousarray(pcm, "<i8").view(np.uint8).reshape(*pcm.shape, 8)[..., :width].tobytes() if width != 1 else pcm.astype(np.int8).tobytes()


def features(pcm: Pcm) -> str:
    """Energy, zero crossings and peak of the samples, as text."""
    x = pcm.samples[:, 0]
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"rms={np.sqrt(np.mean(np.square(x, dtype=np.float64))) if len(x) else 0.0:.4f};crossings={crossings};peak={int(np.abs(x).max()) if len(x) else 0};blocks={len(pcm.first)}"


def to_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` of each row of ``docs(doc_id, text)``: the padded text as 8-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                data, offsets = utf8(part.column("text"))
                raw, cuts = data.tobytes(), offsets.tolist()
                texts = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                media = encode([t.ljust(max(1, -(-len(t) // BLOCK)) * BLOCK, b"\xff") for t in texts])
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """Adds ``payload`` (samples as bytes), ``block_first`` and ``block_offset`` (first sample and byte of each block), ``feature``."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in media.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", SLICE):
                found = decode(part.column("media").to_pylist())
                columns = [
                    pa.array([(p.samples[:, 0] + 128).astype(np.uint8).tobytes() for p in found], pa.binary()),
                    pa.array([p.first for p in found], pa.list_(pa.int64())),
                    pa.array([p.offset for p in found], pa.list_(pa.int64())),
                    pa.array([features(p) for p in found]),
                ]
                yield pa.record_batch([*part.columns, *columns], [*part.schema.names, "payload", "block_first", "block_offset", "feature"])

    return media.mapInArrow(run, f"{kinds}, payload binary, block_first array<long>, block_offset array<long>, feature string")


def op6_flac_media(spark, sf_dir: str) -> DataFrame:
    found = from_media(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "block_first",
        "block_offset",
    )
