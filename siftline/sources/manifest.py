"""The pool manifest and its sidecar of hashes: scans, idempotent appends, resume sets."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from siftline.functions.tables import table
from siftline.plans.storage import fresh_path

MANIFEST = StructType([StructField(n, IntegerType() if n.endswith(("_h", "_w")) else StringType()) for n in "image_id dataset original_split materialized_path original_h original_w materialized_h materialized_w image_hash original_filename".split()])
SIDECAR = StructType([StructField("image_id", StringType()), StructField("phash", StringType())])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the path's own Hadoop file system, so any store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table; a missing one is empty with its full schema."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, MANIFEST)


def read_hashes(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, SIDECAR)


def latest_hashes(spark: SparkSession, path: str) -> DataFrame:
    """image_id -> phash of a sidecar; of rows of one id the last written one counts."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], SIDECAR)
    rows = spark.read.schema(SIDECAR).parquet(path).select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index").alias("__at"))
    return rows.groupBy("image_id").agg(F.max_by("phash", "__at").alias("phash"))


def conform(df: DataFrame, schema: StructType = MANIFEST) -> DataFrame:
    """The schema's columns in its order and types; a missing one is an error, extra ones are dropped."""
    if missing := [n for n in schema.names if n not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return df.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))


def write_manifest(df: DataFrame, path: str, schema: StructType = MANIFEST) -> None:
    conform(df, schema).write.mode("overwrite").parquet(path)


def new_rows(incoming: DataFrame, existing: DataFrame, key: str = "image_id") -> DataFrame:
    """Rows whose key is not there yet, one for each key.

    The existing side is read by its key column alone. Of rows that arrive with one key the first
    by all columns stays, so an append can be repeated.
    """
    fresh = incoming.join(existing.select(key), key, "left_anti")
    first = Window.partitionBy(key).orderBy(*[c for c in incoming.columns if c != key])
    return fresh.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*incoming.columns)


def append_rows(spark: SparkSession, path: str, incoming: DataFrame, schema: StructType = MANIFEST, key: str = "image_id") -> int:
    """Append what is new; returns how many rows that was. Only new files are written."""
    fresh = new_rows(conform(incoming, schema), read_or_empty(spark, path, schema), key)
    before = read_or_empty(spark, path, schema).count()
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).count() - before


def incremental(spark: SparkSession, rows: DataFrame, path: str, compute, schema: StructType = SIDECAR, key: str = "image_id", limit: int | None = None) -> dict[str, int]:
    """Compute a column for the keys that a sidecar lacks, append it, and count.

    ``compute`` maps the pending rows to the schema's columns, with nulls where it fails;
    failures are counted and not written, so that a later run tries them again.
    """
    pending = rows.join(read_or_empty(spark, path, schema).select(key), key, "left_anti")
    if limit is not None:
        pending = pending.limit(limit)
    scanned, todo = rows.count(), pending.count()
    value = next(n for n in schema.names if n != key)
    before = read_or_empty(spark, path, schema).count()
    conform(compute(pending), schema).where(F.col(value).isNotNull()).write.mode("append").parquet(path)
    done = read_or_empty(spark, path, schema).count() - before
    return {"scanned": scanned, "skipped": scanned - todo if limit is None else 0, "computed": done, "errors": todo - done}


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """Selection manifest (JSON) as rows: source, available, keep, drop, images_dir, labels_dir, file."""
    entry = "available int, keep int, drop int, images_dir string, labels_dir string, selected_images array<string>"
    doc = spark.read.option("multiLine", True).schema(f"sources map<string, struct<{entry.replace(' int', ': int').replace(' string', ': string').replace(' array', ': array')}>>").json(path)
    return doc.select(F.explode("sources").alias("source", "s")).select("source", "s.available", "s.keep", "s.drop", "s.images_dir", "s.labels_dir", F.explode("s.selected_images").alias("file"))


def write_selection(df: DataFrame, path: str) -> None:
    """(source, available, keep, images_dir, labels_dir, file) -> one JSON document with a mapping by source, files sorted.

    A selection is a document of as many names as its target, so it is one row.
    """
    rows = df.groupBy("source").agg(F.max("available").cast("int").alias("available"), F.max("keep").cast("int").alias("keep"), F.max("images_dir").alias("images_dir"), F.max("labels_dir").alias("labels_dir"), F.array_sort(F.collect_list("file")).alias("selected_images"))
    entry = F.struct("available", "keep", (F.col("available") - F.col("keep")).alias("drop"), "images_dir", "labels_dir", "selected_images")
    doc = rows.select("source", entry.alias("e")).agg(F.count(F.lit(1)).alias("n_sources"), F.sum("e.keep").alias("total_selected"), F.map_from_entries(F.collect_list(F.struct("source", "e"))).alias("sources"))
    doc.write.mode("overwrite").json(path)


def metadata_sidecar(spark: SparkSession, path: str, extra: dict) -> None:
    """A one-line JSON beside a table."""
    spark.createDataFrame([(json.dumps(extra, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


# Queries: documents are the pool; even ids are there already.


def _manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return conform(d.select(
        F.concat_ws("/", "source", "lang", F.format_string("img_%06d", F.col("doc_id"))).alias("image_id"), F.col("source").alias("dataset"), F.col("lang").alias("original_split"),
        F.concat(F.lit("/pool/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("materialized_path"), F.lit(1080).alias("original_h"), F.lit(1920).alias("original_w"),
        F.lit(360).alias("materialized_h"), F.lit(640).alias("materialized_w"), F.sha2("text", 256).alias("image_hash"), F.col("doc_id").cast("string").alias("original_filename"), F.lit("x").alias("extra"),
    ))


def q_manifest_projection(spark, sf_dir):
    return _manifest(spark, sf_dir)


def q_manifest_append_idempotent(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    old = m.where(F.col("original_filename").cast("long") % 2 == 0)
    fresh = new_rows(m.unionByName(m), old)
    return old.unionByName(fresh).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image_id").alias("n_ids"))


def q_resume_pending(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    return m.join(m.where(F.col("original_filename").cast("long") % 3 > 0).select("image_id"), "image_id", "left_anti").select("image_id", "image_hash")


def q_manifest_read_back(spark, sf_dir):
    """Written, appended to twice and read: a missing table is empty, a second append adds nothing."""
    m, path = _manifest(spark, sf_dir), fresh_path(spark, "manifest")
    empty = read_manifest(spark, path).count()
    write_manifest(m.where("original_filename LIKE '%1'"), path)
    added = [append_rows(spark, path, m) for _ in range(2)]
    return read_manifest(spark, path).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.min("image_hash").alias("least"), F.sum("original_w").alias("width")).select("*", *(F.lit(v).cast("long").alias(c) for c, v in (("n_empty", empty), ("added", added[0]), ("again", added[1]))))


def q_hashes_last_wins(spark, sf_dir):
    d, path = table(spark, sf_dir, "documents").select(F.col("source").alias("image_id"), F.md5("text").alias("phash"), "doc_id"), fresh_path(spark, "hashes")
    for k in range(3):
        d.where(F.col("doc_id") % 3 == k).orderBy("doc_id").select("image_id", "phash").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)  # files are told apart by their times
    return latest_hashes(spark, path)


QUERIES = {f.__name__[2:]: f for f in (q_manifest_read_back, q_hashes_last_wins, q_manifest_projection, q_manifest_append_idempotent, q_resume_pending)}
_ID = "source || '/' || lang || '/img_' || lpad(CAST(doc_id AS VARCHAR), 6, '0')"
ORACLES = {
    "manifest_read_back": "SELECT source AS dataset, count(*) AS n, min(sha256(text)) AS least, count(*) * 1920 AS width, 0::BIGINT AS n_empty, (SELECT count(*) FROM documents WHERE doc_id % 10 <> 1) AS added, 0::BIGINT AS again FROM documents GROUP BY 1",
    "hashes_last_wins": "SELECT source AS image_id, md5(arg_max(text, doc_id % 3 * 1000000000 + doc_id)) AS phash FROM documents GROUP BY 1",
    "manifest_projection": f"""SELECT {_ID} AS image_id, source AS dataset, lang AS original_split, '/pool/' || doc_id || '.jpg' AS materialized_path, 1080 AS original_h, 1920 AS original_w,
        360 AS materialized_h, 640 AS materialized_w, sha256(text) AS image_hash, CAST(doc_id AS VARCHAR) AS original_filename FROM documents""",
    "manifest_append_idempotent": "SELECT source AS dataset, count(*) AS n, count(*) AS n_ids FROM documents GROUP BY 1",
    "resume_pending": f"SELECT {_ID} AS image_id, sha256(text) AS image_hash FROM documents WHERE doc_id % 3 = 0",
}
