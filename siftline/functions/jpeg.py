"""Baseline JPEG in numpy: reading 8-bit sequential files, writing with tables made for each image.

Transforms, quantisation, colour and sampling are array operations over all blocks; only the
entropy-coded bits are walked in Python, a step a coefficient that isn't zero. Huffman codes are
built from an image's own symbol counts, so there are no stock code tables.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import struct
from collections import Counter

import numpy as np

# The quantisation tables of the standard's annex, in natural order.
LUMINANCE = """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
    18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"""
CHROMINANCE = """17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
    99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99"""

#: Places of an 8 by 8 block along its diagonals, up and down in turn.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


@functools.cache
def _cosines() -> np.ndarray:
    k = np.arange(8)
    c = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 16) / 2
    c[0] /= np.sqrt(2)
    return c


def _tables(quality: int) -> list[np.ndarray]:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t.split(), float) * scale + 50) // 100, 1, 255).astype(int) for t in (LUMINANCE, CHROMINANCE)]


# Reading


@functools.lru_cache(maxsize=64)
def _lookup(body: bytes) -> list[tuple[int, int]]:
    """For each 16 bits the length and the symbol of the code they begin with; length 0 is none."""
    table, code, at = [(0, 0)] * 65536, 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            first = code << 16 - length
            table[first : first + (1 << 16 - length)] = [(length, body[at])] * (1 << 16 - length)
            code, at = code + 1, at + 1
        code <<= 1
    return table


class _Bits:
    """Bits of one restart interval, zeros after its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff") + bytes(8), 0, 0, 0

    def _fill(self) -> None:
        if self.at > len(self.data):
            raise ValueError("a scan ends early")
        self.held = (self.held & (1 << self.n) - 1) << 48 | int.from_bytes(self.data[self.at : self.at + 6].ljust(6, b"\0"))
        self.n, self.at = self.n + 48, self.at + 6

    def symbol(self, table: list[tuple[int, int]]) -> int:
        if self.n < 16:
            self._fill()
        length, value = table[self.held >> self.n - 16 & 0xFFFF]
        if not length:
            raise ValueError("a code that no table has")
        self.n -= length
        return value

    def number(self, size: int) -> int:
        """A signed number of so many bits."""
        if not size:
            return 0
        if self.n < size:
            self._fill()
        self.n -= size
        v = self.held >> self.n & (1 << size) - 1
        return v if v >> size - 1 else v - (1 << size) + 1


def read(data: bytes) -> np.ndarray:
    """h, w, channels of a baseline file; NotImplementedError for other kinds, ValueError for broken ones."""
    quant, huff, interval, at, frame = {}, {}, 0, 2, None
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker in (0xFF, 0x01) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        (n,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(int)
                quant[body[0] & 15] = values
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                huff[body[0]] = _lookup(bytes(body[1:size]))
                body = body[size:]
        elif marker in (0xC0, 0xC1):
            depth, h, w, parts = struct.unpack_from(">BHHB", body)
            if depth != 8 or parts not in (1, 3) or not h or not w:
                raise NotImplementedError("only 8-bit images of one or three channels")
            frame = (h, w, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(parts)])
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise NotImplementedError("not a baseline file")
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("a scan before its frame")
            if body[0] != len(frame[2]):
                raise NotImplementedError("one scan a channel")
            tables = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            return _picture(frame, quant, [(huff[tables[c] >> 4], huff[16 | tables[c] & 15]) for c, *_ in frame[2]], _intervals(data, at), interval)
    raise ValueError("no scan")


def _intervals(data: bytes, at: int) -> list[bytes]:
    """Entropy-coded bytes between restart markers, up to the next other marker."""
    out, first = [], at
    while True:
        k = data.find(b"\xff", at)
        if k < 0 or k + 1 >= len(data):
            return [*out, data[first:]]
        if data[k + 1] == 0:
            at = k + 2
        elif 0xD0 <= data[k + 1] <= 0xD7:
            out.append(data[first:k])
            first = at = k + 2
        elif data[k + 1] == 0xFF:
            at = k + 1
        else:
            return [*out, data[first:k]]


def _picture(frame, quant, tables, parts: list[bytes], interval: int) -> np.ndarray:
    h, w, comps = frame
    if len(comps) == 1:
        comps = [(comps[0][0], 1, 1, comps[0][3])]
    hmax, vmax = max(c[1] for c in comps), max(c[2] for c in comps)
    across, down = -(-w // (8 * hmax)), -(-h // (8 * vmax))
    coefs = [np.zeros((down * v, across * u, 64), np.int32) for _, u, v, _ in comps]
    todo, parts = iter(range(across * down)), iter(parts)
    zig = ZIGZAG.tolist()
    for part in parts:
        bits, dc = _Bits(part), [0] * len(comps)
        for mcu in itertools.islice(todo, interval or None):
            my, mx = divmod(mcu, across)
            for k, (_, u, v, _) in enumerate(comps):
                dc_table, ac_table = tables[k]
                for y in range(v):
                    for x in range(u):
                        block = coefs[k][my * v + y, mx * u + x]
                        dc[k] += bits.number(bits.symbol(dc_table))
                        block[0] = dc[k]
                        at = 1
                        while at < 64:
                            rs = bits.symbol(ac_table)
                            if not rs & 15:
                                if rs != 0xF0:
                                    break
                                at += 16
                                continue
                            at += rs >> 4
                            if at > 63:
                                raise ValueError("a block is too long")
                            block[zig[at]] = bits.number(rs & 15)
                            at += 1
    planes = []
    for (_, u, v, q), coef in zip(comps, coefs, strict=True):
        natural = np.zeros(64, int)
        natural[ZIGZAG] = quant[q]
        c, (rows, cols) = _cosines(), coef.shape[:2]
        plane = (c.T @ (coef * natural).reshape(rows, cols, 8, 8) @ c).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8) + 128
        plane = np.repeat(np.repeat(plane, vmax // v, axis=0), hmax // u, axis=1)
        planes.append(plane[:h, :w])
    if len(planes) == 1:
        return np.clip(np.rint(planes[0]), 0, 255).astype(np.uint8)[..., None]
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


# Writing


def _codes(counts: Counter) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """DHT body and symbol -> (code, length) of lengths up to 16, by Huffman's rule; no code is all ones."""
    counts = dict(counts)
    while True:
        heap = [(n, k, (s,)) for k, (s, n) in enumerate(sorted(counts.items()))] + [(0, len(counts), (-1,))]  # -1 takes the code of all ones
        heapq.heapify(heap)
        lengths = dict.fromkeys([*counts, -1], 0)
        order = len(heap)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                lengths[s] += 1
            heapq.heappush(heap, (a + b, order, x + y))
            order += 1
        if max(lengths.values()) <= 16:
            break
        counts = {s: n // 2 + 1 for s, n in counts.items()}
    longest = max(lengths.values())
    ordered = sorted((n, s) for s, n in lengths.items() if s >= 0)
    assert lengths[-1] == longest
    codes, code, last = {}, 0, 0
    for n, s in ordered:
        code <<= n - last
        codes[s], last = (code, n), n
        code += 1
    return bytes(sum(n == k for n, _ in ordered) for k in range(1, 17)) + bytes(s for _, s in ordered), codes


def write(img: np.ndarray, quality: int = 90) -> bytes:
    """h, w, 1 or 3 channels of bytes -> a baseline file, colour halved both ways."""
    h, w, n = img.shape
    x = img.astype(float)
    if n == 3:
        r, g, b = x[..., 0], x[..., 1], x[..., 2]
        planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
        factors = [2, 1, 1]
    else:
        planes, factors = [x[..., 0]], [1]
    side = 8 * factors[0]
    down, across = -(-h // side), -(-w // side)
    quant = _tables(quality)
    c, runs = _cosines(), []
    for k, (plane, f) in enumerate(zip(planes, factors, strict=True)):
        p = np.pad(plane, ((0, down * side - h), (0, across * side - w)), "edge")
        if f < factors[0]:
            p = p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean(axis=(1, 3))
        blocks = c @ (p - 128).reshape(down * f, 8, across * f, 8).transpose(0, 2, 1, 3) @ c.T
        coef = np.rint(blocks.reshape(down * f, across * f, 64) / quant[min(k, 1)]).astype(int)[..., ZIGZAG]
        # In the order of the units: f by f blocks of each.
        runs.append(coef.reshape(down, f, across, f, 64).transpose(0, 2, 1, 3, 4).reshape(down * across, f * f, 64))
    steps, counts = [], [Counter() for _ in range(4)]  # DC and AC of luminance, then of colour
    last = [0] * len(planes)
    lists = [r.tolist() for r in runs]
    for unit in range(down * across):
        for k, blocks in enumerate(lists):
            t = 2 * min(k, 1)
            for block in blocks[unit]:
                d, last[k] = block[0] - last[k], block[0]
                size = abs(d).bit_length()
                steps.append((t, size, d, size))
                zeros = 0
                for v in block[1:]:
                    if not v:
                        zeros += 1
                        continue
                    while zeros > 15:
                        steps.append((t + 1, 0xF0, 0, 0))
                        zeros -= 16
                    size = abs(v).bit_length()
                    steps.append((t + 1, zeros << 4 | size, v, size))
                    zeros = 0
                if zeros:
                    steps.append((t + 1, 0, 0, 0))
    for t, symbol, _, _ in steps:
        counts[t][symbol] += 1
    tables = [_codes(x) if x else None for x in counts]
    bits = []
    for t, symbol, v, size in steps:
        code, length = tables[t][1][symbol]
        bits.append(f"{code:0{length}b}")
        if size:
            bits.append(f"{v if v > 0 else v + (1 << size) - 1:0{size}b}")
    coded = "".join(bits)
    coded += "1" * (-len(coded) % 8)
    packed = int(coded, 2).to_bytes(len(coded) // 8) if coded else b""
    seg = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    ids = range(1, n + 1)
    return b"".join((
        b"\xff\xd8", seg(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"), *(seg(0xDB, bytes([k]) + bytes(q[ZIGZAG].tolist())) for k, q in enumerate(quant[: min(n, 2)])),
        seg(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([i, f << 4 | f, min(i - 1, 1)]) for i, f in zip(ids, factors, strict=True))),
        *(seg(0xC4, bytes([t % 2 << 4 | t // 2]) + x[0]) for t, x in enumerate(tables) if x),
        seg(0xDA, bytes([n]) + b"".join(bytes([i, min(i - 1, 1) * 17]) for i in ids) + b"\0\x3f\0"), packed.replace(b"\xff", b"\xff\0"), b"\xff\xd9"))
