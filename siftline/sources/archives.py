"""Archive ingest: a Python data source over ZIP and TAR, path predicates, the pool pipeline."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftline.functions.image_udfs import normalised
from siftline.functions.tables import table
from siftline.plans.storage import fresh_path, write_back
from siftline.sources.manifest import MANIFEST, conform, new_rows, read_or_empty

#: Members of a ZIP that one task reads.
MEMBERS_A_TASK = 2000


@dataclass(frozen=True)
class Layout:
    """Where a data set's images stand in its archive. ``parts`` are the segments' conditions after the prefix: None is any."""

    dataset: str
    prefix: str
    splits: tuple[str, ...]
    suffix: str
    kind: str


# The layouts of the four public road-scene archives.
LAYOUTS = {
    "bdd100k": Layout("bdd100k", "bdd100k/bdd100k/images/100k/", ("train", "val", "test"), ".jpg", "deep"),
    "a2d2": Layout("a2d2", "camera_lidar_semantic/", ("unlabeled",), ".png", "camera"),
    "cityscapes": Layout("cityscapes", "leftImg8bit/", ("train", "val", "test", "train_extra"), ".png", "three"),
    "mapillary": Layout("mapillary", "", ("training", "validation", "testing"), ".jpg", "images"),
}


def is_canonical(name: Column, layout: Layout) -> Column:
    """Whether an archive member is one of the data set's images."""
    rest = F.substring(name, len(layout.prefix) + 1, 1 << 20)
    parts = F.split(rest, "/")
    here = name.startswith(layout.prefix) & F.lower(name).endswith(layout.suffix)
    if layout.kind == "deep":
        return here & (F.size(parts) >= 2) & parts[0].isin(*layout.splits)
    if layout.kind == "three":
        return here & (F.size(parts) == 3) & parts[0].isin(*layout.splits)
    if layout.kind == "camera":
        return here & (F.size(parts) == 4) & (F.get(parts, F.lit(1)) == "camera") & (F.get(parts, F.lit(2)) == "cam_front_center")
    return here & (F.size(parts) == 3) & parts[0].isin(*layout.splits) & (F.get(parts, F.lit(1)) == "images")


def member_columns(name: Column, layout: Layout) -> dict[str, Column]:
    """split, stem and image_id of a canonical member."""
    rest = F.substring(name, len(layout.prefix) + 1, 1 << 20)
    stem = F.regexp_replace(rest, r"\.[^./]*$", "")
    if layout.kind == "camera":
        stem = F.concat_ws("/", F.split(stem, "/")[0], F.element_at(F.split(stem, "/"), -1))
        return {"original_split": F.lit(layout.splits[0]), "image_id": F.concat(F.lit(f"{layout.dataset}/"), stem)}
    if layout.kind == "images":
        stem = F.regexp_replace(stem, "^([^/]*)/images/", "$1/")
    return {"original_split": F.split(stem, "/")[0], "image_id": F.concat(F.lit(f"{layout.dataset}/"), stem)}


class Span(InputPartition):
    def __init__(self, path: str, first: int, end: int | None):
        self.path, self.first, self.end = path, first, end


class ArchiveReader(DataSourceReader):
    """Members as (archive, name, size, data). A ZIP is split by its directory; a TAR is one forward scan.

    Options: ``path``; ``content`` false leaves data out; ``pattern`` is a regular expression that
    a name must match before its bytes are read; ``wanted`` is a Parquet folder of (archive, name),
    and other members' bytes are not read. A task looks up its own archive's names only.
    """

    def __init__(self, options: dict):
        import re

        self.paths = [p for p in options["path"].split(",") if p]
        self.content = options.get("content", "true").lower() != "false"
        self.pattern = re.compile(options.get("pattern", ""))
        self.wanted = options.get("wanted", "")

    def _names(self, path: str) -> set[str] | None:
        if not self.wanted:
            return None
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        store, inner = fs.FileSystem.from_uri(self.wanted if "://" in self.wanted else "file://" + self.wanted.removeprefix("file:"))
        rows = ds.dataset(inner, filesystem=store, format="parquet").to_table(columns=["name"], filter=pc.field("archive") == path)
        return set(rows.column(0).to_pylist())

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            if path.lower().endswith(".zip"):
                with self._open(path) as f:
                    n = len(zipfile.ZipFile(f).infolist())
                out += [Span(path, a, min(n, a + MEMBERS_A_TASK)) for a in range(0, n, MEMBERS_A_TASK)]
            else:
                out.append(Span(path, 0, None))
        return out

    @staticmethod
    def _open(path: str):
        store, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        return store.open_input_file(inner)

    def read(self, span: Span) -> Iterator[tuple]:
        names = self._names(span.path)
        taken = lambda name: self.pattern.search(name) and (names is None or name in names)
        with self._open(span.path) as f:
            if span.end is not None:
                z = zipfile.ZipFile(f)
                for info in z.infolist()[span.first : span.end]:
                    if not info.is_dir() and taken(info.filename):
                        yield span.path, info.filename, info.file_size, z.read(info) if self.content else None
                return
            with tarfile.open(fileobj=io.BufferedReader(f, 1 << 20), mode="r|*") as t:
                for info in t:
                    if info.isfile() and taken(info.name):
                        yield span.path, info.name, info.size, t.extractfile(info).read() if self.content else None


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "archive string, name string, size bigint, data binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, paths: list[str], content: bool = True, pattern: str = "", wanted: str = "") -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("content", str(content).lower()).option("pattern", pattern).option("wanted", wanted).load(",".join(paths))


def count_canonical(spark: SparkSession, paths: list[str], layout: Layout) -> int:
    """Images in archives, without reading their bytes."""
    return read_archives(spark, paths, content=False).where(is_canonical(F.col("name"), layout)).count()


def ingest(spark: SparkSession, paths: list[str], layout: Layout, pool: str, long_side: int = 640, limit: int | None = None) -> dict[str, int]:
    """Archive -> images not yet in the pool -> resized -> ``pool``/images and ``pool``/manifest, with counts.

    Names are filtered, matched against the manifest and written first; then only the bytes of
    what is new are read, once. Running it again adds nothing.
    """
    import re

    manifest = f"{pool}/manifest"
    names = read_archives(spark, paths, content=False, pattern=f"^{re.escape(layout.prefix)}").where(is_canonical(F.col("name"), layout))
    names = names.select("archive", "name", *(c.alias(n) for n, c in member_columns(F.col("name"), layout).items()))
    names = write_back(names, "archive-names")
    have = read_or_empty(spark, manifest, MANIFEST)
    todo, wanted = new_rows(names, have), fresh_path(spark, "archive-wanted")
    if limit is not None:
        todo = todo.limit(limit)
    todo.write.parquet(wanted)
    todo = spark.read.parquet(wanted)
    data = read_archives(spark, paths, pattern=f"^{re.escape(layout.prefix)}", wanted=wanted).select("archive", "name", normalised(long_side)("data").alias("x")).where("x.sha is not null")
    path = F.concat(F.lit("images/"), "image_id", F.lit(".jpg"))
    rows = data.join(todo, ["archive", "name"]).select("image_id", F.lit(layout.dataset).alias("dataset"), "original_split", path.alias("materialized_path"), F.col("x.h").alias("original_h"), F.col("x.w").alias("original_w"), F.col("x.mh").alias("materialized_h"), F.col("x.mw").alias("materialized_w"), F.col("x.sha").alias("image_hash"), F.element_at(F.split("name", "/"), -1).alias("original_filename"), F.col("x.data").alias("data"))
    before, pending = have.count(), todo.count()
    rows.write.mode("append").parquet(f"{pool}/images")
    fresh = spark.read.parquet(f"{pool}/images").drop("data")
    conform(new_rows(fresh, have)).write.mode("append").parquet(manifest)
    made = read_or_empty(spark, manifest, MANIFEST).count() - before
    scanned = names.select("image_id").distinct().count()
    return {"scanned": scanned, "skipped_existing": min(scanned, before), "materialized": made, "errors": pending - made}


def q_canonical_path_filter(spark, sf_dir):
    """Member names made from documents against all four layouts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(
        F.concat(F.lit("bdd100k/bdd100k/images/100k/"), F.when(F.col("doc_id") % 3 == 0, "train").otherwise(F.col("lang")), F.lit("/testA/"), "source", F.lit(".JPG")),
        F.concat(F.lit("camera_lidar_semantic/"), "source", F.lit("/camera/"), F.when(F.col("doc_id") % 2 == 0, "cam_front_center").otherwise("cam_left"), F.lit("/"), "doc_id", F.lit(".png")),
        F.concat(F.lit("leftImg8bit/"), F.when(F.col("doc_id") % 5 == 0, "train_extra").otherwise("x"), F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit("_a.b.png")),
        F.concat(F.lit("training/"), F.when(F.col("doc_id") % 4 == 0, "images").otherwise("labels"), F.lit("/"), "doc_id", F.lit(".jpg")))).alias("name"))
    out = None
    for layout in LAYOUTS.values():
        part = d.where(is_canonical(F.col("name"), layout)).select("doc_id", F.lit(layout.dataset).alias("dataset"), *(c.alias(n) for n, c in member_columns(F.col("name"), layout).items()))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {"canonical_path_filter": q_canonical_path_filter}
ORACLES = {"canonical_path_filter": """
    SELECT doc_id, 'bdd100k' AS dataset, 'train' AS original_split, 'bdd100k/train/testA/' || source AS image_id FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, 'a2d2', 'unlabeled', 'a2d2/' || source || '/' || doc_id FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 'cityscapes', 'train_extra', 'cityscapes/train_extra/' || lang || '/' || doc_id || '_a.b' FROM documents WHERE doc_id % 5 = 0
    UNION ALL SELECT doc_id, 'mapillary', 'training', 'mapillary/training/' || doc_id FROM documents WHERE doc_id % 4 = 0"""}
