"""Feature store of a teacher: per-image, per-level vectors, kept in half precision, read by key.

A row is (image_id, level, shape, data): the values as little-endian half floats, two bytes each,
which is what they are worth. Reads of some images push their ids down to Parquet; a batch takes
stored features and computes only the missing ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from siftline.functions.tables import table
from siftline.plans.storage import fresh_path
from siftline.sources.discovery import DataError
from siftline.sources.manifest import metadata_sidecar, read_or_empty

STORED = StructType([StructField("image_id", StringType()), StructField("level", StringType()), StructField("data", BinaryType())])
#: Largest number of half precision; larger ones become it.
LARGEST = 65504.0


def to_half(col: str) -> Column:
    """Numbers as little-endian half floats."""
    return F.pandas_udf(lambda vec: vec.map(lambda v: None if v is None else np.clip(np.asarray(v, float), -LARGEST, LARGEST).astype("<f2").tobytes()), "binary")(col)


def from_half(col: str) -> Column:
    return F.pandas_udf(lambda data: data.map(lambda b: None if b is None else np.frombuffer(b, "<f2").astype("f4")), "array<float>")(col)


def check_levels(features: DataFrame, levels: list[str]) -> None:
    """Raises if an image lacks one of the levels."""
    have = features.where(F.col("level").isin(*levels)).groupBy("image_id").agg(F.count_distinct("level").alias("n"))
    every = features.select("image_id").distinct().join(have, "image_id", "left").where(F.coalesce("n", F.lit(0)) < len(levels))
    if (lacking := every.limit(3).collect()):
        raise DataError(f"levels are missing for {[r.image_id for r in lacking]}")


def save(features: DataFrame, path: str, levels: list[str]) -> None:
    """Append (image_id, level, vec) of new images; each must have all levels, others are left out."""
    check_levels(features, levels)
    features.where(F.col("level").isin(*levels)).select("image_id", "level", to_half("vec").alias("data")).write.mode("append").partitionBy("level").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, STORED)


def load(spark: SparkSession, path: str, ids: list[str], levels: list[str]) -> DataFrame:
    """(image_id, level, vec) of some images, in single precision; an absent one is an error."""
    rows = stored(spark, path).where(F.col("image_id").isin(*ids) & F.col("level").isin(*levels))
    found = {r.image_id for r in rows.select("image_id").distinct().collect()}
    if missing := sorted(set(ids) - found):
        raise FileNotFoundError(f"no features of {missing[:3]}")
    return rows.select("image_id", "level", from_half("data").alias("vec"))


def build(images: DataFrame, path: str, levels: list[str], teacher: Callable[[DataFrame], DataFrame], tag: str = "teacher", skip_existing: bool = True) -> dict[str, int]:
    """Features of the images that the store lacks, by ``teacher`` ((image_id, ...) -> image_id, level, vec), with counts.

    Images whose vectors are null are errors and are tried again by a later run.
    """
    spark = images.sparkSession
    have = stored(spark, path).select("image_id").distinct()
    todo = images.join(have, "image_id", "left_anti") if skip_existing else images
    scanned, pending, before = images.count(), todo.count(), have.count()
    made = teacher(todo)
    failed = made.where(F.col("vec").isNull()).select("image_id").distinct()
    save(made.join(failed, "image_id", "left_anti"), path, levels)
    after = stored(spark, path).select("image_id").distinct().count()
    metadata_sidecar(spark, f"{path}.meta", {"teacher_tag": tag, "levels": levels, "n_cached": after})
    return {"scanned": scanned, "skipped": scanned - pending, "computed": after - before, "errors": pending - (after - before)}


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}.meta").first().value)


def cached_or_live(batch: DataFrame, path: str, levels: list[str], teacher: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(image_id, level, vec, cached) of a batch: stored features where there are some, else the teacher's."""
    kept = stored(batch.sparkSession, path).where(F.col("level").isin(*levels)).join(batch.select("image_id"), "image_id", "left_semi")
    live = teacher(batch.join(kept.select("image_id").distinct(), "image_id", "left_anti"))
    return kept.select("image_id", "level", from_half("data").alias("vec"), F.lit(True).alias("cached")).unionByName(live.select("image_id", "level", F.col("vec").cast("array<float>").alias("vec"), F.lit(False).alias("cached")))


# Queries: vectors are images, their halves two levels.


def _images(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("pool/"), F.format_string("%05d", "vec_id")).alias("image_id"), "vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 64) / 64).alias("v"))


def _teacher(rows: DataFrame) -> DataFrame:
    """Sixty-fourths are exact in half precision. Every 50th image fails."""
    half = lambda a: F.when(F.col("vec_id") % 50 < 49, F.slice("v", a, 32))
    both = F.array(F.struct(F.lit("p3").alias("level"), half(1).alias("vec")), F.struct(F.lit("p5").alias("level"), half(33).alias("vec")))
    return rows.select("image_id", F.inline(both))


def q_feature_store(spark, sf_dir):
    """Built in two steps, then counted and read."""
    rows, path = _images(spark, sf_dir), fresh_path(spark, "features")
    first = build(rows.where("vec_id % 3 = 0"), path, ["p3", "p5"], _teacher)
    second = build(rows, path, ["p3", "p5"], _teacher)
    told = read_metadata(spark, path)
    out = stored(spark, path).select("level", from_half("data").alias("vec"))
    out = out.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))) + 1e-9, 5).alias("total"))
    n = {"first_computed": first["computed"], "second_skipped": second["skipped"], "second_errors": second["errors"], "n_cached": told["n_cached"]}
    return out.select("*", *(F.lit(v).cast("long").alias(k) for k, v in n.items()))


def q_cached_or_live(spark, sf_dir):
    rows, path = _images(spark, sf_dir), fresh_path(spark, "features")
    build(rows.where("vec_id % 4 = 1"), path, ["p3", "p5"], _teacher)
    out = cached_or_live(rows.where("vec_id % 50 < 49"), path, ["p5"], _teacher).where("level = 'p5'")
    return out.groupBy("cached").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("vec")[7].cast("double")) + 1e-9, 5).alias("x7"))


def q_feature_point_read(spark, sf_dir):
    """Features of three named images, and what an absent image and a missing level raise."""
    rows, path = _images(spark, sf_dir), fresh_path(spark, "features")
    build(rows.where("vec_id < 40"), path, ["p3", "p5"], _teacher)
    raised = []
    for f in (lambda: load(spark, path, ["pool/00001", "none"], ["p3"]), lambda: save(_teacher(rows.where("vec_id = 45")).where("level = 'p3'"), path, ["p3", "p5"])):
        try:
            f()
        except (FileNotFoundError, DataError) as x:
            raised.append(type(x).__name__)
    out = load(spark, path, ["pool/00003", "pool/00007", "pool/00039"], ["p3", "p5"])
    return out.select("image_id", "level", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double")) + 1e-9, 5).alias("total"), F.lit(",".join(raised)).alias("raised"))


QUERIES = {f.__name__[2:]: f for f in (q_feature_store, q_cached_or_live, q_feature_point_read)}
_V = "v AS (SELECT vec_id, 'pool/' || lpad(CAST(vec_id AS VARCHAR), 5, '0') AS image_id, list_transform(embedding, lambda x: round(x::DOUBLE * 64) / 64) AS v FROM embeddings), l AS (SELECT vec_id, image_id, 'p3' AS level, v[1:32] AS vec FROM v UNION ALL SELECT vec_id, image_id, 'p5', v[33:64] FROM v)"
ORACLES = {
    "feature_store": f"""WITH {_V} SELECT level, count(*) AS n, round(sum(list_sum(vec)) + 1e-9, 5) AS total, (SELECT count(*) FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 50 < 49) AS first_computed, (SELECT count(*) FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 50 < 49) AS second_skipped,
        (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 49) AS second_errors, (SELECT count(*) FROM embeddings WHERE vec_id % 50 < 49) AS n_cached FROM l WHERE vec_id % 50 < 49 GROUP BY 1""",
    "cached_or_live": f"WITH {_V} SELECT vec_id % 4 = 1 AS cached, count(*) AS n, round(sum(vec[8]) + 1e-9, 5) AS x7 FROM l WHERE level = 'p5' AND vec_id % 50 < 49 GROUP BY 1",
    "feature_point_read": f"WITH {_V} SELECT image_id, level, round(list_sum(vec) + 1e-9, 5) AS total, 'FileNotFoundError,DataError' AS raised FROM l WHERE vec_id IN (3, 7, 39)",
}
