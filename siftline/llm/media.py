"""Baseline JPEG: lossless storage of bytes, lane-parallel Huffman decoding, DC thumbnails.

Storage. A payload byte b becomes the quantised coefficient 256 + b, 64 to a block in zigzag
order, so the format's own unit carries it and nothing is rounded. All such values have size
category 9, the two Huffman tables need one code each, and a restart marker after every block
makes blocks independent. The payload's length stands in a comment segment.

Reading. Markers are parsed by a general baseline parser (any tables, components, sampling and
restart interval; progressive and arithmetic files are refused). Scans are decoded in numpy:
every restart interval is a lane, and each step decodes one symbol of all lanes through a
16-bit lookup table. A file without restart markers is one lane.

Features: dimensions, checksum and 64-bit average hash of the thumbnail, which has one
luminance pixel a block, taken from the DC coefficient alone.

Nulls and odd rows: a null text is empty and stored as 192 blanks; equal texts give equal
values; texts of any length are stored, wider than high from 8191 rows of blocks on; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.llm.tokens import batches

UNIT = 192
CATEGORY = 9  # of the values 256 to 511
MAX_SIDE = 65_535 // 8
#: Bytes of lanes that are decoded at once.
LANE_BYTES = 1 << 22
FIELDS = [("doc_id", "bigint", pa.int64()), ("n_bytes", "bigint", pa.int64()), ("payload_bytes", "bigint", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "bigint", pa.int64()), ("media_bytes", "bigint", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()), ("width", "int", pa.int32()), ("height", "int", pa.int32())]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def pad(data: bytes) -> bytes:
    """Blanks up to a positive multiple of UNIT."""
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def shape(n_bytes: int) -> tuple[int, int]:
    """Blocks across and down for a payload."""
    units = max(1, n_bytes // UNIT)
    wide = -(-units // MAX_SIDE)
    return 3 * wide, -(-units // wide)


def header(n_bytes: int) -> bytes:
    across, down = shape(n_bytes)
    code = bytes([1] + [0] * 15 + [CATEGORY])  # one code of one bit
    return b"".join((
        b"\xff\xd8", _segment(0xFE, b"payload %d" % n_bytes), _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, 8 * down, 8 * across, 1) + b"\1\x11\0"),
        _segment(0xC4, b"\0" + code), _segment(0xC4, b"\x10" + code), _segment(0xDD, b"\0\1"),
        _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ))


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """JPEG files of padded payloads; the bits of all blocks are packed at once."""
    blocks = [3 * d * (a // 3) for a, d in (shape(len(p)) for p in payloads)]
    data = b"".join(p + b"\0" * (64 * n - len(p)) for p, n in zip(payloads, blocks, strict=True))
    x = np.frombuffer(data, np.uint8).reshape(-1, 16, 4)
    # Ten bits a value: code 0, then 1 and the byte. Four values make five bytes.
    packed = np.empty((len(x), 16, 5), np.uint8)
    packed[..., 0] = 0x40 | x[..., 0] >> 2
    packed[..., 1] = x[..., 0] << 6 | 0x10 | x[..., 1] >> 4
    packed[..., 2] = x[..., 1] << 4 | 0x04 | x[..., 2] >> 6
    packed[..., 3] = x[..., 2] << 2 | 0x01
    packed[..., 4] = x[..., 3]
    packed = packed.reshape(-1, 80)
    full = (packed == 0xFF).any(axis=1)
    out, at = [], 0
    for p, n in zip(payloads, blocks, strict=True):
        own = np.empty((n, 82), np.uint8)
        own[:, :80] = packed[at : at + n]
        own[:, 80] = 0xFF
        own[:, 81] = 0xD0 + np.arange(n) % 8
        if full[at : at + n].any():
            scan = b"".join(r[:80].tobytes().replace(b"\xff", b"\xff\0") + r[80:].tobytes() for r in own)
        else:
            scan = own.tobytes()
        out.append(header(len(p)) + scan[:-2] + b"\xff\xd9")
        at += n
    return out


@dataclass
class Parsed:
    """What the markers of one file say; ``lanes`` are its restart intervals, unstuffed."""

    height: int = 0
    width: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)  # class and number -> lengths and symbols
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # part, DC table, AC table
    restart: int = 0
    comment: bytes = b""
    lanes: list[bytes] = field(default_factory=list)

    def mcus(self) -> tuple[int, int, list[int]]:
        """MCUs across and down, and the scan entry of each block in one."""
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        if len(self.scan) == 1:
            _, ph, pv, _ = self.parts[self.scan[0][0]]
            return -(-(-(-self.width * ph // h)) // 8), -(-(-(-self.height * pv // v)) // 8), [0]
        return -(-self.width // (8 * h)), -(-self.height // (8 * v)), [k for k, (p, _, _) in enumerate(self.scan) for _ in range(self.parts[p][1] * self.parts[p][2])]


def parse(data: bytes) -> Parsed:
    """Markers of a baseline file with one scan."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    out, at = Parsed(), 2
    while True:
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        while data[at] == 0xFF:
            at += 1
        marker, n = data[at], int.from_bytes(data[at + 1 : at + 3], "big")
        body, at = data[at + 3 : at + 1 + n], at + 1 + n
        if marker == 0xC0:
            precision, out.height, out.width, parts = struct.unpack(">BHHB", body[:6])
            if precision != 8:
                raise ValueError("only 8-bit samples are baseline")
            out.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(parts)]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError(f"frame type {marker:#x} isn't baseline")
        elif marker == 0xC4:
            while body:
                m = 17 + sum(body[1:17])
                out.tables[body[0]], body = body[1:m], body[m:]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xDD:
            out.restart = int.from_bytes(body, "big")
        elif marker == 0xFE:
            out.comment = body
        elif marker == 0xDA:
            where = {p[0]: k for k, p in enumerate(out.parts)}
            out.scan = [(where[body[1 + 2 * k]], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            break
    end = data.rfind(b"\xff\xd9")
    out.lanes = _split_lanes(data[at : end if end >= at else len(data)])
    return out


def _split_lanes(scan: bytes) -> list[bytes]:
    """Entropy-coded data between restart markers, without stuffing."""
    x = np.frombuffer(scan, np.uint8)
    ff = np.flatnonzero(x[:-1] == 0xFF) if len(x) else np.zeros(0, np.int64)
    after = x[ff + 1]
    cuts = ff[(after >= 0xD0) & (after <= 0xD7)]
    stuffed = bool((after == 0).any())
    lanes, at = [], 0
    for c in [*cuts.tolist(), len(scan)]:
        lanes.append(scan[at:c].replace(b"\xff\0", b"\xff") if stuffed else scan[at:c])
        at = c + 2
    return lanes


@functools.lru_cache(maxsize=64)
def lookup(table: bytes) -> np.ndarray:
    """16 bits -> code length * 256 + symbol; 0 where no code fits."""
    out, code, at = np.zeros(65_536, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            first = code << 16 - length
            out[first : first + (1 << 16 - length)] = length << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def decode_lanes(lanes: list[bytes], n_blocks: np.ndarray, luts: np.ndarray, order_of: np.ndarray, coef: np.ndarray) -> None:
    """Fills ``coef`` with the blocks of the lanes, one symbol of every lane a step; DC values stay differences."""
    sizes = np.fromiter(map(len, lanes), np.int64, len(lanes)) + 8
    buf = np.frombuffer(b"".join(x + b"\xff" * 8 for x in lanes) + b"\xff" * 8, np.uint8)
    # The 40 bits from each byte on: a code of 16, its value of 11 and an offset of 7 fit.
    words = buf[:-4].astype(np.int64)
    for k in range(1, 5):
        words = words << 8 | buf[k : len(buf) - 4 + k]
    base = np.cumsum(n_blocks) - n_blocks
    flat = coef.reshape(-1)
    lane = np.arange(len(lanes))
    pos = (np.cumsum(sizes) - sizes) * 8
    last = np.cumsum(sizes) * 8
    block, k = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    simple = len(order_of) == 1
    while len(lane):
        ac = k > 0
        table = ac.astype(np.int64) if simple else 2 * order_of[block % len(order_of)] + ac
        w, shift = words[pos >> 3], pos & 7
        e = luts[table, w >> 24 - shift & 0xFFFF]
        if not e.all():
            raise ValueError("a bit pattern has no code")
        length, size = e >> 8, e & 15
        k += np.where(ac, e >> 4 & 15, 0)
        bits = w >> 40 - shift - length - size & (1 << size) - 1
        value = np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)
        if k.max() > 63:
            raise ValueError("a run leaves its block")
        flat[(base[lane] + block) * 64 + k] = value
        ends = ac & (e & 0xFF == 0)
        k += 1
        k[ends] = 64
        pos += length + size
        done = k > 63
        if done.any():
            block += done
            k[done] = 0
            keep = block < n_blocks[lane]
            if (pos > last[lane]).any():
                raise ValueError("a scan ends early")
            if not keep.all():
                lane, pos, block, k = lane[keep], pos[keep], block[keep], k[keep]


def decode_scans(files: list[Parsed]) -> list[np.ndarray]:
    """Coefficients (blocks, 64) in zigzag order and scan order; the files share tables and layout."""
    first = files[0]
    across, down, order = first.mcus()
    luts = np.stack([lookup(first.tables[t]) for _, dc, ac in first.scan for t in (dc, 16 + ac)])
    order_of = np.array(order)
    lanes = [x for f in files for x in f.lanes]
    n_blocks = []
    for f in files:
        across, down, _ = f.mcus()
        total, step = across * down, f.restart or across * down
        n_blocks += [len(order) * min(step, total - k * step) for k in range(len(f.lanes))]
        if sum(n_blocks[-len(f.lanes) :]) != total * len(order):
            raise ValueError("restart markers are missing")
    n_blocks = np.array(n_blocks)
    base = np.cumsum(n_blocks) - n_blocks
    coef = np.zeros((int(n_blocks.sum()), 64), np.int16)
    # So many bytes of lanes at once, since each byte becomes a word of 8 while it is read.
    ends = np.cumsum(np.fromiter(map(len, lanes), np.int64, len(lanes)))
    cuts = [0, *np.flatnonzero(np.diff(ends // LANE_BYTES)).tolist(), len(lanes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            decode_lanes(lanes[a:b], n_blocks[a:b], luts, order_of, coef[base[a] : base[b - 1] + n_blocks[b - 1]])
    # DC values are differences from the block before, of the same part, in the lane.
    if (n_blocks > len(order)).any():
        for s in range(len(first.scan)):
            own = np.flatnonzero(order_of[_within(n_blocks) % len(order)] == s)
            total = np.cumsum(coef[own, 0].astype(np.int64))
            start = np.searchsorted(own, base[np.repeat(np.arange(len(n_blocks)), n_blocks)[own]])
            coef[own, 0] = total - np.where(start > 0, total[start - 1], 0)
    elif len(order) > len(first.scan):
        for s in range(len(first.scan)):
            own = np.flatnonzero(order_of == s)
            view = coef.reshape(-1, len(order), 64)
            view[:, own, 0] = np.cumsum(view[:, own, 0], axis=1)
    edges = np.cumsum([sum(n_blocks[a:b]) for a, b in _spans([len(f.lanes) for f in files])])
    return np.split(coef, edges[:-1])


def _within(n: np.ndarray) -> np.ndarray:
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _spans(counts: list[int]) -> list[tuple[int, int]]:
    ends = np.cumsum(counts)
    return [(int(e - c), int(e)) for e, c in zip(ends, counts, strict=True)]


def thumbnail(p: Parsed, coef: np.ndarray) -> np.ndarray:
    """One luminance pixel a block, from DC coefficients."""
    across, down, order = p.mcus()
    part, _, _ = p.scan[0]
    _, h, v, q = p.parts[part]
    if len(p.scan) == 1:
        h = v = 1
    dc = coef[:, 0].astype(np.int64).reshape(down, across, len(order))[:, :, : h * v]
    dc = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    return np.clip((dc * int(p.quant[q][0]) + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: the 8 by 8 nearest samples above their mean."""
    rows, cols = np.arange(8) * thumb.shape[0] // 8, np.arange(8) * thumb.shape[1] // 8
    small = thumb[rows[:, None], cols].astype(np.int64)
    return np.packbits(64 * small > small.sum()).tobytes().hex()


def feature(p: Parsed, coef: np.ndarray) -> str:
    thumb = thumbnail(p, coef)
    return f"{p.width}x{p.height};crc={zlib.crc32(thumb.tobytes()):08x};ahash={average_hash(thumb)}"


def decode_many(files: list[bytes]) -> list[tuple[Parsed, np.ndarray]]:
    """Each file's markers and coefficients; files with like tables are decoded together."""
    parsed = [parse(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for k, p in enumerate(parsed):
        groups.setdefault((tuple(sorted(p.tables.items())), tuple(p.scan), tuple(p.parts)), []).append(k)
    out: list = [None] * len(files)
    for own in groups.values():
        for k, coef in zip(own, decode_scans([parsed[k] for k in own]), strict=True):
            out[k] = (parsed[k], coef)
    return out


def payload(p: Parsed, coef: np.ndarray) -> bytes:
    """The bytes that ``encode_many`` stored."""
    n = int(p.comment.removeprefix(b"payload "))
    return (coef - 256).astype(np.uint8).tobytes()[:n]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store every text as JPEG, read the bytes back; ``keep_media`` adds the file as column media."""

    def run(stream):
        for batch in stream:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in batches(texts, 1_000_000):
                raw = [t.encode() for t in texts[a:b]]
                media = encode_many([pad(r) for r in raw])
                rows = []
                for key, r, m, (p, coef) in zip(keys[a:b], raw, media, decode_many(media), strict=True):
                    back = payload(p, coef)
                    rows.append((key, len(r), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(p, coef), p.width, p.height))
                cols = [pa.array(c, t) for c, (_, _, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)]
                names = [n for n, _, _ in FIELDS]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(media, pa.binary())] * keep_media, names + ["media"] * keep_media)

    schema = ", ".join(f"{n} {t}" for n, t, _ in FIELDS) + ", media binary" * keep_media
    return docs.select(id_col, text_col).mapInArrow(run, schema)
