"""Sum-of-squares online packing of documents into windows of tokens.

Windows are kept by fill level in an array: ``count[h]`` is the number of open windows that
hold h tokens. A piece of s tokens goes into the level whose use makes the sum of the squared
counts smallest, an empty window being level 0; closed windows do not count. Documents longer
than a window fill whole windows first, so only their last piece is placed. When a
partition ends, the same rule goes on with cuts (documents may be cut freely): the emptiest
open window is dissolved and each of its pieces is placed again, its first tokens closing a
window of the level whose count falls most, until one part-filled window is left.

Each partition packs by itself; its windows get global numbers by the counts of the
partitions before it. No text is shuffled.

Nulls and odd rows: a null or empty text is its end token alone; equal rows are packed one
by one; texts of any length are cut into as many windows as they need; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.tokens import batches, encoder
from siftline.plans.storage import write_back

FIELDS = [("doc_id", "bigint", pa.int64()), ("start", "bigint", pa.int64()), ("length", "bigint", pa.int64()), ("ids_crc32", "bigint", pa.int64()), ("doc_tokens", "bigint", pa.int64()), ("part", "bigint", pa.int64()), ("window", "bigint", pa.int64()), ("offset", "bigint", pa.int64())]


class LevelPacker:
    """Online sum-of-squares packing into windows of ``size``; pieces are any objects."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}  # level -> windows, each a list of pieces

    def level_for(self, s: int, fresh: bool = True) -> int:
        """The level to put ``s`` tokens on, 0 for a new window; the fuller one on ties. Without ``fresh`` a new one is the last resort.

        Moving a window from h to h+s changes the sum of squares by
        2 (count[h+s] - count[h]) + 2, without the terms of level 0 and of full windows.
        """
        top = self.size - s
        here, there = self.count[1 : top + 1], self.count[s + 1 : self.size + 1]
        change = 2 * (there - here) + 2
        if top:
            change[-1] = 1 - 2 * here[-1]  # fills the window
        change = np.where(here > 0, change, np.iinfo(np.int64).max)
        new = 2 * self.count[s] + 1 if s < self.size else 0
        if top and (best := top - int(np.argmin(change[::-1]))) and here[best - 1] and (change[best - 1] <= new or not fresh):
            return best
        return 0

    def place(self, s: int, piece) -> list | None:
        """Put a piece away; returns the window's pieces if that filled it."""
        return self.put(s, piece, self.level_for(s))

    def put(self, s: int, piece, h: int) -> list | None:
        """Put a piece on level ``h``; returns the window's (size, piece) list if that filled it."""
        window = self.open[h].pop() if h else []
        window.append((s, piece))
        if h:
            self.count[h] -= 1
        if h + s == self.size:
            return window
        self.count[h + s] += 1
        self.open.setdefault(h + s, []).append(window)
        return None

    def settle(self, cut) -> Iterator[list]:
        """Closes all open windows but one, which comes last; ``cut(piece, n)`` gives a piece's first n tokens and the rest."""
        while (left := int(self.count.sum())) > 1:
            low = int(np.flatnonzero(self.count)[0])
            self.count[low] -= 1
            for s, piece in self.open[low].pop():
                # Closing a window of a level with c windows lowers the sum of squares by 2 c - 1.
                while (gaps := self.count[max(1, self.size - s) : self.size]).any():
                    h = self.size - 1 - int(np.argmax(gaps[::-1]))
                    gap = self.size - h
                    first, piece = cut(piece, gap) if gap < s else (piece, None)
                    yield self.put(gap, first, h)
                    s -= gap
                    if not s:
                        break
                if s and (full := self.put(s, piece, self.level_for(s, fresh=False))):
                    yield full
            assert self.count.sum() < left
        yield from (w for windows in self.open.values() for w in windows)


def pack_stream(docs: Iterator[tuple[int, np.ndarray]], size: int) -> Iterator[tuple]:
    """(doc_id, ids) -> (doc_id, start, length, crc32, doc_tokens, window, offset), windows from 0."""
    packer, window = LevelPacker(size), 0

    def told(piece, offset):
        doc_id, start, ids, total = piece
        return doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, window, offset

    def told_all(pieces):
        offset = 0
        for s, piece in pieces:
            yield told(piece, offset)
            offset += s

    def cut(piece, n):
        doc_id, start, ids, total = piece
        return (doc_id, start, ids[:n], total), (doc_id, start + n, ids[n:], total)

    for doc_id, ids in docs:
        whole = len(ids) // size * size
        for start in range(0, whole, size):
            yield told((doc_id, start, ids[start : start + size], len(ids)), 0)
            window += 1
        if len(ids) > whole and (full := packer.place(len(ids) - whole, (doc_id, whole, ids[whole:].copy(), len(ids)))):
            yield from told_all(full)
            window += 1
    for pieces in packer.settle(cut):
        yield from told_all(pieces)
        window += 1


def pack(docs: DataFrame, tokenizer: str, blank: str, end_id: int = 0, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", max_chunks: int | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(stream):
        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer, blank, max_chunks)

        def documents():
            for batch in stream:
                keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                for a, b in batches(texts):
                    ids, lens = enc.encode(texts[a:b])
                    at = np.cumsum(lens) - lens
                    for k in range(b - a):
                        yield keys[a + k], np.append(ids[at[k] : at[k] + lens[k]], np.uint32(end_id))

        rows = []
        for r in pack_stream(documents(), size):
            rows.append((*r[:5], part, *r[5:]))
            if len(rows) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)], [n for n, _, _ in FIELDS])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)], [n for n, _, _ in FIELDS])

    pieces = write_back(docs.select(id_col, text_col).mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in FIELDS)), "pack")
    # One row a partition, so the window is as small as the list of tasks.
    sizes = pieces.groupBy("part").agg((F.max("window") + 1).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = write_back(sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "pack-bases")
    return pieces.join(bases, "part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("window")).alias("sequence_id"), "offset")
