"""WARC archives: writing, the monolithic gzip normaliser, and reading by offset.

``write`` makes archives as some crawlers leave them: one gzip stream over the whole file.
``normalise`` inflates such a stream once, from front to back, rewrites every record as a gzip
member of its own, and writes a sidecar index with each record's offset and length.
``read_back`` takes records by index, each inflated alone.

Of records with equal payloads (at least ``min_payload`` bytes) that with the largest page_id is
the response; the others are revisits that name it and carry the HTTP head only.

Executors write under names of their own try; the listing that Spark commits names the files of
the tries that succeeded, and later steps read those alone.

Nulls and odd rows: a null html is an empty payload, a null url leaves the target out, a null
page_id never is a group's response unless the group has no other, then all its rows are; rows
that share page_id and payload are each a response if that id is the largest; an empty table
gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.token_store import open_fs
from siftline.plans.storage import fresh_path, write_back

#: Copies of a group's row, so that a hot payload's pages meet it in that many tasks.
SALTS = 16
#: Uncompressed bytes after which the next archive is begun.
ARCHIVE_BYTES = 1 << 30
LISTING = "path string, first long, n_records long"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def clean(url: str) -> str:
    """A header value: control characters percent-encoded."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, data: bytes, refers_to: int | None, date: str) -> bytes:
    """One uncompressed record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(data)
    block = http if refers_to is not None else http + data
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest(data)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, raw record) of an uncompressed stream, one record in memory at a time."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        raw = [line]
        while line not in (b"\r\n", b"\n"):
            line = stream.readline()
            if not line:
                raise ValueError("an archive ends in a header")
            raw.append(line)
        head = parse_head(b"".join(raw).rstrip())
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("an archive ends in a record")
        yield head, b"".join(raw) + block + b"\r\n\r\n"


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: the response's page_id for revisits, else null.

    Only groups of two or more are joined, a row for each salt; pages of a hot payload are
    spread over the salts. The groups are written first, so that Spark knows their size: small
    ones are broadcast and no html is moved.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"), F.pmod(F.xxhash64(id_col, url_col), F.lit(SALTS)).alias("salt"))
    groups = pages.select(F.col(id_col).alias("page_id"), html.alias("html")).where(F.octet_length("html") >= min_payload)
    groups = groups.groupBy(F.sha1(F.col("html").cast("binary")).alias("g_sha")).agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = write_back(groups.select(F.unhex("g_sha").alias("g_sha"), "newest"), "warc-groups")
    groups = groups.select(F.lower(F.hex("g_sha")).alias("g_sha"), "newest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("g_salt"))
    joined = rows.join(groups, (F.col("sha") == F.col("g_sha")) & (F.col("salt") == F.col("g_salt")), "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("newest")), F.col("newest")).alias("refers_to"))


def write(rows: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Archives with one gzip stream over each; returns the listing."""

    def run(stream):
        out, n, size, done = None, 0, 0, []
        for batch in stream:
            for page_id, url, html, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    path, n, size, first = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0, page_id
                    store, inner = open_fs(path)
                    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    sink = store.open_output_stream(inner, compression=None)
                    out = gzip.GzipFile(filename="", mode="wb", compresslevel=1, fileobj=sink, mtime=0)
                raw = record(page_id, url, (html or "").encode(), refers_to, date)
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    sink.close()
                    out = None
                    done.append((path, first, n))
        if out is not None:
            out.close()
            sink.close()
            done.append((path, first, n))
        if done:
            yield _listing(done)

    return write_back(rows.mapInArrow(run, LISTING), "warc-raw")


def _listing(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["path", "first", "n_records"])


def _one_a_task(spark: SparkSession, listing: DataFrame) -> DataFrame | None:
    """The listing, a row for each archive, dealt out one to a task."""
    paths = sorted(r.path for r in listing.select("path").collect())
    return spark.createDataFrame(spark.sparkContext.parallelize([(p,) for p in paths], len(paths)), "path string") if paths else None


def normalise_file(source_uri: str, target_uri: str, level: int = 6) -> list[dict]:
    """Inflate an archive once; write a member for each record, and the index beside the target."""
    store, inner = open_fs(source_uri)
    target, target_inner = open_fs(target_uri)
    target.create_dir(target_inner.rsplit("/", 1)[0], recursive=True)
    index, offset = [], 0
    with store.open_input_stream(inner, compression=None) as raw, target.open_output_stream(target_inner, compression=None) as out:
        stream = gzip.GzipFile(fileobj=raw, mode="rb")
        for head, data in records(stream):
            member = gzip.compress(data, compresslevel=level, mtime=0)
            out.write(member)
            index.append({"offset": offset, "length": len(member), "id": head["warc-record-id"], "type": head["warc-type"], "digest": head.get("warc-payload-digest", ""), "uri": head.get("warc-target-uri", "")})
            offset += len(member)
    with target.open_output_stream(f"{target_inner}.idx", compression=None) as out:
        for x in index:
            out.write(json.dumps(x).encode() + b"\n")
    return index


def normalise(spark: SparkSession, listing: DataFrame, folder: str) -> DataFrame:
    """Normalise every archive of a listing; returns the listing of the new ones."""
    dealt = _one_a_task(spark, listing)
    if dealt is None:
        return spark.createDataFrame([], LISTING)

    def run(stream):
        for batch in stream:
            for path in batch.column(0).to_pylist():
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                index = normalise_file(path, target)
                yield _listing([(target, None, len(index))])

    return write_back(dealt.mapInArrow(run, LISTING), "warc-members")


def read_record(source, entry: dict) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: header and block."""
    source.seek(entry["offset"])
    raw = zlib.decompress(source.read(entry["length"]), wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    head = parse_head(head)
    return head, rest[: int(head["content-length"])]


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(name) if name not in ("", "null") else None


def read_back(spark: SparkSession, listing: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    dealt = _one_a_task(spark, listing)
    if dealt is None:
        return spark.createDataFrame([], schema)

    def run(stream):
        for batch in stream:
            for path in batch.column(0).to_pylist():
                store, inner = open_fs(path)
                with store.open_input_stream(f"{inner}.idx", compression=None) as f:
                    index = [json.loads(x) for x in f.read().splitlines()]
                rows = []
                with store.open_input_file(inner) as source:
                    for entry in index:
                        head, block = read_record(source, entry)
                        http, _, data = block.partition(b"\r\n\r\n")
                        n = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                        told = head["warc-payload-digest"].removeprefix("sha1:")
                        if head["warc-type"] == "response" and (len(data) != n or digest(data) != told):
                            raise ValueError(f"a payload of {path} differs from its digest")
                        rows.append((_page(head["warc-record-id"]), n, told, head["warc-type"], _page(head.get("warc-refers-to")), head.get("warc-target-uri")))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return dealt.mapInArrow(run, schema)


def archive(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write pages as monolithic archives, normalise them, read every record back."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    raw = write(classify(pages, min_payload=min_payload), f"{folder}/raw")
    return read_back(spark, normalise(spark, raw, f"{folder}/members"))
