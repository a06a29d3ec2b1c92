import hashlib
import zlib

import numpy as np
import pytest

from rosterlake.llm import flac as op


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - j) & 1 for j in range(n)]

    def rice(self, value, k):
        z = value << 1 if value >= 0 else -value * 2 - 1
        self.bits += [0] * (z >> k) + [1]
        self.put(z & (1 << k) - 1, k)

    def bytes(self):
        return np.packbits(np.array(self.bits + [0] * (-len(self.bits) % 8), np.uint8)).tobytes()


def stream(channels, depth, frames, pcm, block):
    """A stream by plain rules: frames are lists of functions that write one subframe each."""
    info = (block << 16 | block).to_bytes(4, "big") + bytes(6) + (8000 << 44 | (channels - 1) << 41 | (depth - 1) << 36 | len(pcm)).to_bytes(8, "big")
    width = (depth + 7) // 8
    info += hashlib.md5(b"".join(int(v).to_bytes(width, "little", signed=True) for row in pcm for v in row)).digest()
    out = b"fLaC\x80\x00\x00\x22" + info
    for k, (n, code, subframes) in enumerate(frames):
        head = bytes((0xFF, 0xF8, 0x70, code << 4)) + op._number(k) + (n - 1).to_bytes(2, "big")
        w = Writer()
        for sub in subframes:
            sub(w)
        body = head + bytes((op.crc8(head),)) + w.bytes()
        out += body + op._crc16(body).to_bytes(2, "big")
    return out


def lpc(x, coefficients, shift, depth, parts=1, k=3, escape=False, wasted=0):
    def write(w):
        y, n = [v >> wasted for v in x], len(coefficients)
        w.put(0, 1), w.put(31 + n, 6), w.put(int(wasted > 0), 1)
        if wasted:
            w.put(1, wasted)
        for v in y[:n]:
            w.put(v, depth - wasted)
        w.put(11, 4), w.put(shift, 5)
        for c in coefficients:
            w.put(c, 12)
        res = [y[t] - (sum(c * y[t - 1 - j] for j, c in enumerate(coefficients)) >> shift) for t in range(n, len(y))]
        w.put(1, 2), w.put(parts, 4)
        size, at = len(y) >> parts, 0
        for p in range(1 << parts):
            part = res[at : at + size - (n if p == 0 else 0)]
            at += len(part)
            if escape and p == 1:
                w.put(31, 5), w.put(20, 5)
                for v in part:
                    w.put(v, 20)
            else:
                w.put(k, 5)
                for v in part:
                    w.rice(v, k)

    return write


def verbatim(x, depth):
    def write(w):
        w.put(2, 8)
        for v in x:
            w.put(v, depth)

    return write


def test_other_writers_streams():
    rng = np.random.default_rng(1)
    t = np.arange(64)
    a = (3000 * np.sin(t / 5) + rng.normal(0, 20, 64)).astype(int).tolist()
    b = (2000 * np.cos(t / 7) + rng.normal(0, 20, 64)).astype(int).tolist()
    mid, side = [(x + y) >> 1 for x, y in zip(a, b)], [x - y for x, y in zip(a, b)]
    frames = [
        (64, 1, [lpc(a, [1800, -900], 10, 16), lpc(b, [1024], 10, 16, escape=True)]),
        (64, 10, [verbatim(mid, 16), lpc(side, [1900, -950, 12], 10, 17, parts=2)]),
        (64, 8, [verbatim(a, 16), verbatim(side, 17)]),
        (64, 9, [verbatim(side, 17), verbatim(b, 16)]),
    ]
    pcm = list(zip(a, b)) * 4
    found = op.decode([stream(2, 16, frames, pcm, 64)])[0]
    assert (found.samples == np.array(pcm)).all() and found.first.tolist() == [0, 64, 128, 192]
    even = [8 * v for v in a]
    one = stream(1, 20, [(64, 0, [lpc(even, [1000, 30], 10, 20, wasted=3)])], [(v,) for v in even], 64)
    assert (op.decode([one])[0].samples[:, 0] == even).all()


def payloads():
    rng = np.random.default_rng(2)
    out = [b"\xff" * 576, b"plain text, and more of it. " * 100, bytes(rng.integers(0, 256, 2000, np.uint8)), "é漢字 ".encode() * 300, bytes(range(256)) * 9, b"\x00\xff" * 400]
    out.append(b"\xff\xf8\x20\x02\x01" * 400 + b"a" * 5000)
    return [p.ljust(-(-len(p) // 576) * 576, b"\xff") for p in out]


def test_round_trip_and_seeking():
    found = payloads()
    media = op.encode(found)
    assert media == op.encode(found[:3]) + op.encode(found[3:])
    for p, m, pcm in zip(found, media, op.decode(media)):
        assert (pcm.samples[:, 0] + 128).astype(np.uint8).tobytes() == p
        s = op.Stream(m)
        assert s.header(int(pcm.offset[-1]))[0] == pcm.first[-1]
        assert all(s.header(s.audio + offset)[0] == first for first, offset in s.seek)


def test_broken_streams():
    media = op.encode(payloads()[1:2])[0]
    for at in (70, 300, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            op.decode([bytes(broken)])
    with pytest.raises(ValueError):
        op.decode([media[:-5]])


def test_query(odd, odd_rows, spark):
    found = {(r.doc_id, r.payload_sha256): r for r in op.from_media(op.to_media(odd)).selectExpr("*", "sha2(payload, 256) AS payload_sha256").collect()}
    for i, text, *_ in odd_rows:
        data = (text or "").encode()
        want = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        row = found[i, hashlib.sha256(want).hexdigest()]
        assert row.n_bytes == len(data) and bytes(row.payload) == want
        assert row.block_first == list(range(0, len(want), 576))
    assert zlib.crc32(b"\xff" * 32) == spark.sql("SELECT crc32(substring(X'{}', -32, 32))".format("ff" * 576)).first()[0]


def test_empty(odd):
    assert op.from_media(op.to_media(odd.limit(0))).count() == 0
