"""Image pools as files: writing, scanning, reading as arrays, hashing, filling from archives."""

from __future__ import annotations

import io
import uuid
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import image_udfs as U
from siftline.functions import jpeg
from siftline.functions.scalars import image_id
from siftline.functions.tables import table
from siftline.plans.storage import fresh_path, write_back
from siftline.sources import archives
from siftline.sources.discovery import list_images
from siftline.sources.manifest import MANIFEST, SIDECAR, incremental, read_hashes, read_or_empty


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def put_files(rows: DataFrame) -> DataFrame:
    """Write (path, data) as files, each by its own task and in whole; returns the paths. Call an action on the result.

    A file gets its name when it is complete, so a task that is tried again does no harm.
    """

    def run(stream):
        for batch in stream:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner = open_store(path)
                store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                made = f"{inner}.{uuid.uuid4().hex}"
                with store.open_output_stream(made, compression=None) as out:
                    out.write(data)
                store.move(made, inner)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["path"])

    return rows.select("path", "data").mapInArrow(run, "path string")


def resized_files(images: DataFrame, long_side: int = 640) -> DataFrame:
    """(path, data, sides, hash) of decoded, shrunk and JPEG-encoded images; unreadable ones are left out."""
    made = images.withColumn("__x", U.normalised(long_side)("data")).where("__x.sha is not null")
    return made.select("path", "__x.data", F.col("__x.h").alias("h"), F.col("__x.w").alias("w"), "__x.mh", "__x.mw", "__x.sha")


def hash_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, phash) of a folder's images; ids are paths below it without suffix, unreadable files are left out."""
    files = list_images(spark, folder, content=True)
    base = files.select(F.lit("file:" + folder.removeprefix("file://").rstrip("/")).alias("b")).first() if folder.startswith("file:") else None
    root = base.b if base else folder
    return files.select(image_id(F.col("path"), root).alias("image_id"), U.phash_of_bytes()("content").alias("phash")).where("phash is not null")


def as_arrays(size: int):
    """UDF: encoded bytes -> channel-major numbers in 0..1 of a size by size RGB image; null for what doesn't decode."""

    def one(data):
        img = U.to_rgb(U.decode(data)).astype(float).transpose(2, 0, 1)
        return (U.resize(img, size, size) / 255).ravel()

    return F.pandas_udf(lambda s: pd.Series([None if x is None else U._or_none(one)(x) for x in s], dtype=object), "array<double>")


def image_arrays(files: DataFrame, size: int = 640, tries: int = 3) -> DataFrame:
    """(path, x) for (path, content) in the order of paths; an unreadable image takes the next readable one.

    Up to ``tries`` files are looked at, the first ones following the last; else zeros. Only the
    unreadable rows look for others: by the numbers of the files that follow them.
    """
    # Files are numbered by path; a pool's listing is names only, so the numbering moves no pixels.
    order = files.select("path").withColumn("n", F.row_number().over(Window.orderBy("path")) - 1)
    total = order.agg(F.count(F.lit(1)).alias("total"))
    d = files.select("path", as_arrays(size)("content").alias("x")).join(order, "path")
    bad = d.where("x is null").join(F.broadcast(total)).select("path", F.posexplode(F.array(*((F.col("n") + k) % F.col("total") for k in range(1, tries)))).alias("k", "n"))
    near = bad.join(d.where("x is not null").select("n", "x"), "n").groupBy("path").agg(F.min(F.struct("k", "x")).alias("b")).select("path", F.col("b.x").alias("other"))
    zeros = F.array_repeat(F.lit(0.0), 3 * size * size)
    return d.join(near, "path", "left").select("path", F.coalesce("x", "other", zeros).alias("x"))


# Queries: vectors are 8 by 8 grey images.


def _gray(spark, sf_dir) -> DataFrame:
    """vec_id, g (64 bytes as numbers)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.round((v.cast("double") + 1) / 2 * 255).cast("int")).alias("g"))


def _png(col: str) -> Column:
    return F.pandas_udf(lambda g: g.map(lambda v: U.write_png(np.asarray(v, np.uint8).reshape(8, 8, 1))), "binary")(col)


def _jpg(col: str) -> Column:
    """Each number is 4 by 5 pixels."""
    return F.pandas_udf(lambda g: g.map(lambda v: jpeg.write(np.repeat(np.repeat(np.asarray(v, np.uint8).reshape(8, 8, 1), 4, axis=0), 5, axis=1), 95)), "binary")(col)


def _files(spark, sf_dir, folder) -> None:
    """Every tenth file is broken, and a text file stands beside the images."""
    d = _gray(spark, sf_dir)
    path = F.concat(F.lit(f"{folder}/s"), (F.col("vec_id") % 3).cast("string"), F.lit("/"), F.format_string("%05d", "vec_id"), F.when(F.col("vec_id") % 2 == 0, ".png").otherwise(".PNG"))
    rows = d.select(path.alias("path"), F.when(F.col("vec_id") % 10 == 4, F.lit(b"broken")).otherwise(_png("g")).alias("data"))
    put_files(rows.unionByName(spark.createDataFrame([(f"{folder}/readme.txt", b"x")], "path string, data binary"))).count()


def _number(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d+)\.[a-zA-Z]+$", 1).cast("long")


def q_pool_scan(spark, sf_dir):
    """What a scan of files finds: images by folder, and which of them can be read."""
    folder = fresh_path(spark, "files")
    _files(spark, sf_dir, folder)
    files = list_images(spark, folder, content=True)
    return files.groupBy(F.regexp_extract("path", r"/(s\d)/", 1).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(U.is_readable()("content").cast("long")).alias("n_readable"), F.sum(_number(F.col("path"))).alias("ids"))


def q_pool_hashes(spark, sf_dir):
    """Hashes of a folder, taken into a sidecar in two steps, the first with a limit; later rows of an id win."""
    folder, side = fresh_path(spark, "files"), fresh_path(spark, "hashes")
    _files(spark, sf_dir, folder)
    rows = list_images(spark, folder, content=True).select(_number(F.col("path")).cast("string").alias("image_id"), "content")
    compute = lambda d: d.select("image_id", U.phash_of_bytes()("content").alias("phash"))
    first = incremental(spark, rows, side, compute, SIDECAR, limit=100)
    second = incremental(spark, rows, side, compute, SIDECAR)
    n = hash_folder(spark, folder).count()
    d = read_hashes(spark, side).select(F.col("image_id").cast("long").alias("vec_id"), "phash")
    return d.withColumn("n_first", F.lit(min(100, first["computed"] + first["errors"])).cast("long")).withColumn("n_errors", F.lit(second["errors"]).cast("long")).withColumn("n_folder", F.lit(n).cast("long"))


def q_image_dataset(spark, sf_dir):
    """Files as arrays: broken ones take the next file's."""
    folder = fresh_path(spark, "files")
    _files(spark, sf_dir, folder)
    d = image_arrays(list_images(spark, folder, content=True), 8)
    return d.select(_number(F.col("path")).alias("vec_id"), F.round(F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v) + 1e-9, 5).alias("view"))


def q_resized_files(spark, sf_dir):
    """Images shrunk, encoded and written as files, then found and read again; broken ones are left out."""
    folder = fresh_path(spark, "resized")
    d = _gray(spark, sf_dir).select(F.concat(F.lit(f"{folder}/"), F.format_string("%05d", "vec_id"), F.lit(".jpg")).alias("path"), F.when(F.col("vec_id") % 10 == 4, F.lit(b"broken")).otherwise(_jpg("g")).alias("data"))
    made = write_back(resized_files(d, 24), "resized")
    put_files(made).count()
    files = list_images(spark, folder, content=True).select(_number(F.col("path")).alias("vec_id"), F.sha2("content", 256).alias("sha"), F.size(as_arrays(8)("content")).alias("n"))
    return files.join(made.select(_number(F.col("path")).alias("vec_id"), "h", "w", "mh", "mw", F.col("sha").alias("told")), "vec_id").select("vec_id", "n", "h", "w", "mh", "mw", (F.col("sha") == F.col("told")).alias("same"))


def _zip(folder: str):
    """Groups of (name, data) -> a ZIP a group, from inside a task."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for name, data in zip(pdf["name"], pdf["data"], strict=True):
                z.writestr(name, data)
        path = f"{folder}/{key[0]}.zip"
        store, inner = open_store(path)
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(inner, compression=None) as out:
            out.write(buffer.getvalue())
        return pd.DataFrame({"path": [path]})

    return run


def q_archive_ingest(spark, sf_dir):
    """JPEG members of a ZIP for each of two layouts -> pool, once with a limit and then the rest; every tenth is broken."""
    folder, out = fresh_path(spark, "archives"), None
    d = _gray(spark, sf_dir)
    names = {"bdd100k": F.concat(F.lit("bdd100k/bdd100k/images/100k/"), F.element_at(F.array(F.lit("train"), F.lit("val")), (F.col("vec_id") % 2 + 1).cast("int")), F.lit("/x/"), "vec_id", F.lit(".jpg")),
             "mapillary": F.concat(F.lit("training/images/"), "vec_id", F.lit(".jpg"))}
    for dataset, name in names.items():
        rows = d.where(F.col("vec_id") % 4 < 2 if dataset == "bdd100k" else F.col("vec_id") % 4 > 1).select(name.alias("name"), F.when(F.col("vec_id") % 10 == 4, F.lit(b"broken")).otherwise(_jpg("g")).alias("data"))
        rows = rows.unionByName(spark.createDataFrame([("other/readme.txt", b"x")], "name string, data binary")).withColumn("a", F.lit(dataset))
        paths = [r.path for r in rows.groupBy("a").applyInPandas(_zip(folder), "path string").collect()]
        layout, pool = archives.LAYOUTS[dataset], f"{folder}/pool-{dataset}"
        n = archives.count_canonical(spark, paths, layout)
        first = archives.ingest(spark, paths, layout, pool, 20, limit=30)
        rest = archives.ingest(spark, paths, layout, pool, 20)
        m = read_or_empty(spark, f"{pool}/manifest", MANIFEST).groupBy("dataset", "original_split", "original_h", "original_w", "materialized_h", "materialized_w").agg(F.count(F.lit(1)).alias("n"))
        part = m.select("*", F.lit(n).cast("long").alias("n_members"), F.lit(first["materialized"] + rest["materialized"]).cast("long").alias("n_made"), F.lit(rest["errors"]).cast("long").alias("n_errors"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {f.__name__[2:]: f for f in (q_pool_scan, q_pool_hashes, q_image_dataset, q_resized_files, q_archive_ingest)}
_G = "v AS (SELECT vec_id, list_transform(embedding, lambda x: round((x::DOUBLE + 1) / 2 * 255)) AS img FROM embeddings)"
_HASH = """r AS (SELECT unnest(range(32))::INT AS i), t AS (SELECT unnest(range(8))::INT AS k),
    m AS (SELECT u.k AS u, t.k AS k, sum(cos(pi() * (2 * i + 1) * u.k / 64) * greatest(0, 1 - abs(least(7, greatest(0, (i + 0.5) / 4 - 0.5)) - t.k))) AS m FROM r, t, t u GROUP BY 1, 2),
    c AS (SELECT vec_id, a.u AS u, b.u AS v, sum(a.m * b.m * img[a.k * 8 + b.k + 1]) AS x FROM v, m a, m b GROUP BY 1, 2, 3), h AS (SELECT *, x > median(x) OVER (PARTITION BY vec_id) AS bit FROM c),
    y AS (SELECT vec_id, u, sum(CASE WHEN bit THEN 1 << (7 - v) ELSE 0 END)::INT AS byte FROM h GROUP BY 1, 2), p AS (SELECT vec_id, string_agg(format('{:02x}', byte), '' ORDER BY u) AS phash FROM y GROUP BY 1)"""
ORACLES = {
    "pool_scan": "SELECT 's' || vec_id % 3 AS part, count(*) AS n, sum((vec_id % 10 <> 4)::INT)::BIGINT AS n_readable, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY 1",
    "pool_hashes": f"WITH {_G}, {_HASH} SELECT vec_id, phash, least(100, (SELECT count(*) FROM v))::BIGINT AS n_first, (SELECT count(*) FROM v WHERE vec_id % 10 = 4) AS n_errors, (SELECT count(*) FROM v WHERE vec_id % 10 <> 4) AS n_folder FROM p WHERE vec_id % 10 <> 4",
    "image_dataset": f"""WITH {_G}, o AS (SELECT *, row_number() OVER (ORDER BY 's' || vec_id % 3 || '/' || lpad(CAST(vec_id AS VARCHAR), 5, '0')) - 1 AS n, count(*) OVER () AS total FROM v),
        k AS (SELECT unnest(range(3)) AS k), s AS (SELECT a.vec_id, b.img FROM o a, k, o b WHERE b.n = (a.n + k) % a.total AND b.vec_id % 10 <> 4 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY k) = 1)
        SELECT vec_id, round(sum(img[i % 64 + 1] / 255 * (i + 1)) + 1e-9, 5) AS view FROM s, (SELECT unnest(range(192))::INT AS i) GROUP BY 1""",
    "resized_files": "SELECT vec_id, 192 AS n, 32 AS h, 40 AS w, 19 AS mh, 24 AS mw, true AS same FROM embeddings WHERE vec_id % 10 <> 4",
    "archive_ingest": """WITH d AS (SELECT vec_id, CASE WHEN vec_id % 4 < 2 THEN 'bdd100k' ELSE 'mapillary' END AS dataset, CASE WHEN vec_id % 4 > 1 THEN 'training' WHEN vec_id % 2 = 0 THEN 'train' ELSE 'val' END AS original_split, vec_id % 10 = 4 AS bad FROM embeddings),
        n AS (SELECT dataset, count(*) AS n_members, sum((NOT bad)::INT)::BIGINT AS n_made, sum(bad::INT)::BIGINT AS n_errors FROM d GROUP BY 1)
        SELECT dataset, original_split, 32 AS original_h, 40 AS original_w, 16 AS materialized_h, 20 AS materialized_w, count(*) AS n, n_members, n_made, n_errors FROM d JOIN n USING (dataset) WHERE NOT bad GROUP BY ALL""",
}
