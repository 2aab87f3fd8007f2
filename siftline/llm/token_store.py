"""Token files of independent zstandard frames with a trailing seek table.

A file is: frames of whole documents' ids (little-endian, 2 or 4 bytes an id), one frame with
the document table (doc_id, first id, number of ids), and the seek table of the public seekable
format, a skippable frame with the compressed size, size and checksum (low 32 bits of
XXH64) of each frame. Any zstandard reader can read the file; a reader that wants some
documents reads the table, then only the frames that hold them, and checks each.

Files are in ascending order of doc_id, rows of one id by a hash of their text: rows are
range-partitioned by both, so an id that very many rows share is dealt over several files. Each
task sorts its range and writes one file under a name of its own try, and the listing that Spark commits names the
files of the tries that succeeded. A lost executor's files are written again elsewhere.

Nulls and odd rows: a null text is its end token alone; null ids come first; equal ids are
ordered by their text; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.tokens import batches, encoder
from siftline.plans.storage import fresh_path, write_back

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HAS_CHECKSUMS = 0x80
#: Ids after which a frame ends at the next document.
FRAME_IDS = 65_536
NO_ID = -(2**63)


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class Writer:
    """Writes one file to an open stream; ``width`` is the bytes of an id."""

    def __init__(self, out, width: int, level: int = 3, frame_ids: int = FRAME_IDS):
        import zstandard

        self.out, self.kind, self.frame_ids = out, f"<u{width}", frame_ids
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int, int]] = []
        self.waiting: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []
        self.total = self.in_frame = 0

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.zstd.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def flush(self) -> None:
        if self.waiting:
            self._frame(np.concatenate(self.waiting).astype(self.kind).tobytes())
            self.waiting, self.in_frame = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NO_ID if doc_id is None else doc_id, self.total, len(ids)))
        self.waiting.append(ids)
        self.total += len(ids)
        self.in_frame += len(ids)
        if self.in_frame >= self.frame_ids:
            self.flush()

    def close(self) -> None:
        self.flush()
        self._frame(np.array(self.docs, "<i8").reshape(-1, 3).tobytes())
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), HAS_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class Reader:
    """Reads the seek table and the document table; frames only when asked for."""

    def __init__(self, source, width: int):
        self.source, self.kind, self.width = source, f"<u{width}", width
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & HAS_CHECKSUMS else 8
        raw = self._at(size - 9 - n * entry - 8, n * entry + 8)
        if struct.unpack_from("<II", raw) != (SKIPPABLE, n * entry + 9):
            raise ValueError("broken seek table")
        self.table = np.frombuffer(raw, "<u4", offset=8).reshape(n, entry // 4).astype(np.int64)
        self.at = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        self.docs = np.frombuffer(self.frame(n - 1), "<i8").reshape(-1, 3)
        self.first = (np.cumsum(self.table[:-1, 1]) - self.table[:-1, 1]) // width

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        """One frame's bytes, checked."""
        import xxhash
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(self._at(int(self.at[k]), int(self.table[k, 0])), max_output_size=max(1, int(self.table[k, 1])))
        if len(data) != self.table[k, 1] or self.table.shape[1] == 3 and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def rows_of(self, doc_ids: Iterable[int | None]) -> list[int]:
        """Rows of the document table with the given ids, ascending; the table stands in order of ids."""
        wanted = np.unique(np.array([NO_ID if d is None else d for d in doc_ids], np.int64))
        ids = np.ascontiguousarray(self.docs[:, 0])
        return [k for a, b in zip(np.searchsorted(ids, wanted), np.searchsorted(ids, wanted, "right"), strict=True) for k in range(a, b)]

    def read(self, rows: Iterable[int]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, first id, ids) of the given rows of the document table; each frame is read once if rows ascend."""
        held, ids = -1, None
        for r in rows:
            doc_id, start, n = (int(x) for x in self.docs[r])
            k = int(np.searchsorted(self.first, start, "right")) - 1
            if k != held:
                held, ids = k, np.frombuffer(self.frame(k), self.kind)
            yield doc_id, start, ids[start - int(self.first[k]) :][:n]


def write(docs: DataFrame, folder: str, tokenizer: str, blank: str, end_id: int = 1, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files; returns the listing: path, first_doc, first_hash, n_docs, n_ids, one row a file."""

    def run(stream):
        enc, out, w, first, path = encoder(tokenizer, blank), None, None, None, ""
        for batch in stream:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(2).to_pylist()]
            for a, b in batches(texts):
                ids, lens = enc.encode(texts[a:b])
                at = np.cumsum(lens) - lens
                for k in range(b - a):
                    if w is None:
                        path, first = f"{folder}/{uuid.uuid4().hex}.tok.zst", (keys[a + k], batch.column(1)[a + k].as_py())
                        store, inner = open_fs(path)
                        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                        out = store.open_output_stream(inner, compression=None)
                        w = Writer(out, width)
                    w.add(keys[a + k], np.append(ids[at[k] : at[k] + lens[k]], np.uint32(end_id)))
        if w is not None:
            w.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "first_doc": pa.array(first[:1], pa.int64()), "first_hash": pa.array(first[1:], pa.int64()), "n_docs": pa.array([len(w.docs)], pa.int64()), "n_ids": pa.array([w.total], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    rows = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h")
    return write_back(rows.mapInArrow(run, "path string, first_doc long, first_hash long, n_docs long, n_ids long"), "token-files")


def read_back(spark: SparkSession, listing: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    The listing has a row for each file, as many as there were tasks; the driver adds up
    their sizes and deals the files out one to a task.
    """
    files = sorted(listing.collect(), key=lambda r: (r.first_doc is not None, r.first_doc or 0, r.first_hash))
    bases, base = [], 0
    for f in files:
        bases.append((f.path, base))
        base += f.n_ids

    def run(stream):
        for batch in stream:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner = open_fs(path)
                with store.open_input_file(inner) as source:
                    reader = Reader(source, width)
                    found = [(None if d == NO_ID else d, base + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in reader.read(range(len(reader.docs)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not bases:
        return spark.createDataFrame([], schema)
    table = spark.createDataFrame(spark.sparkContext.parallelize(bases, len(bases)), "path string, base long")
    return table.mapInArrow(run, schema)


def store(docs: DataFrame, tokenizer: str, blank: str, end_id: int = 1, width: int = 2) -> DataFrame:
    """Write all documents and read them back."""
    spark = docs.sparkSession
    return read_back(spark, write(docs, fresh_path(spark, "tokens"), tokenizer, blank, end_id, width), width)
