"""Queries of the scalar expressions over columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import scalars as S
from siftline.functions.tables import table


def q_derived_seed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source").distinct()
    return d.select("source", S.derive_seed(F.lit(42), F.col("source")).alias("seed"))


def q_auto_names(spark, sf_dir):
    d = table(spark, sf_dir, "nation")
    return d.select("n_nationkey", S.auto_name("ds_", F.col("n_nationkey") + 1, F.lit(25)).alias("name"))


def q_url_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(S.is_url(F.col("url"))).groupBy(F.lower(F.split("url", ":")[0]).alias("scheme")).agg(F.count(F.lit(1)).alias("n"))


def _paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("../../sets/images/"), "source", F.lit("/images/../images/"), "lang", F.lit("_"), "doc_id", F.lit(".tar.jpg")).alias("p"))


def q_path_resolution(spark, sf_dir):
    d = _paths(spark, sf_dir)
    return d.select("doc_id", S.strip_leading_dotdot(F.col("p")).alias("stripped"), S.resolve_path(F.col("p"), "/data/a/b").alias("resolved"), S.image_id(S.strip_leading_dotdot(F.col("p")), "sets").alias("image_id"))


def q_label_path_swap(spark, sf_dir):
    d = _paths(spark, sf_dir)
    return d.select("doc_id", S.label_path(F.col("p")).alias("beside"), S.label_path(F.col("p"), "/lab/").alias("in_folder"))


def q_parsed_settings(spark, sf_dir):
    """Lists, flags and numbers parsed from text columns, with defaults for what doesn't parse."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", F.round("value", 2).cast("string"), F.lit(" 1.5 "), F.when(F.col("event_id") % 3 == 0, F.lit("x"))).alias("list"), "event_type", F.when(F.col("event_id") % 5 > 0, F.when(F.col("event_id") % 2 == 0, " Yes ").otherwise("off")).alias("flag"))
    return e.select("event_id", F.size(S.csv_floats(F.col("list"), [0.1, 0.2, 0.3, 0.4])).alias("n"), F.round(S.csv_floats(F.col("list"), [0.1, 0.2, 0.3, 0.4])[0], 6).alias("first"), S.truthy(F.col("flag"), True).alias("flag"), S.bounded_number(F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise((F.col("event_id") % 9 - 4).cast("string")), 7, 1).alias("number"), S.safe_scalar(F.when(F.col("event_id") % 3 == 0, F.lit("x")).otherwise(F.col("event_id").cast("string"))).alias("scalar"))


def q_class_names(spark, sf_dir):
    """Names from maps with integer-like keys, in the order of the keys."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), F.concat(F.lit(" "), "n_name")))).alias("m"))
    return n.select("n_regionkey", F.array_join(S.ordered_names(F.col("m")), ",").alias("names"))


def q_json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("props", "$.k")).alias("n_k"), F.min(S.iso_seconds(F.col("ts"))).alias("first_at"))


def q_learning_rate_schedule(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    n = e.agg(F.count(F.lit(1)).alias("total"))
    return e.join(F.broadcast(n)).select("event_id", F.round(S.warmup_cosine(F.col("event_id"), F.lit(100), F.col("total")), 9).alias("factor"))


def q_l2_normalised(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)).alias("v"))
    u = v.select("vec_id", S.l2_normalise(F.col("v")).alias("u"))
    return u.select("vec_id", F.round(F.col("u")[0], 7).alias("first"), F.round(F.col("u")[63], 7).alias("last"))


QUERIES = {f.__name__[2:]: f for f in (q_derived_seed, q_auto_names, q_url_filter, q_path_resolution, q_label_path_swap, q_parsed_settings, q_class_names, q_json_props, q_learning_rate_schedule, q_l2_normalised)}
_P = "WITH d AS (SELECT doc_id, '../../sets/images/' || source || '/images/../images/' || lang || '_' || doc_id || '.tar.jpg' AS p, source, lang FROM documents)"
ORACLES = {
    "derived_seed": "SELECT DISTINCT source, ('0x' || substr(sha256('42:' || source), 1, 8))::BIGINT AS seed FROM documents",
    "auto_names": "SELECT n_nationkey, 'ds_' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS name FROM nation",
    "url_filter": "SELECT lower(split_part(url, ':', 1)) AS scheme, count(*) AS n FROM pages WHERE regexp_matches(lower(url), '^https?://') GROUP BY 1",
    "path_resolution": _P + "SELECT doc_id, substr(p, 7) AS stripped, '/data/sets/images/' || source || '/images/' || lang || '_' || doc_id || '.tar.jpg' AS resolved, 'images/' || source || '/images/../images/' || lang || '_' || doc_id || '.tar' AS image_id FROM d",
    "label_path_swap": _P + "SELECT doc_id, '../../sets/images/' || source || '/images/../labels/' || lang || '_' || doc_id || '.tar.txt' AS beside, '/lab/' || lang || '_' || doc_id || '.tar.txt' AS in_folder FROM d",
    "parsed_settings": """
        SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 4 ELSE 2 END AS n, CASE WHEN event_id % 3 = 0 THEN 0.1 ELSE round(value, 2) END AS first,
               CASE WHEN event_id % 5 = 0 THEN true ELSE event_id % 2 = 0 END AS flag, CASE WHEN event_id % 4 = 0 THEN 7 ELSE greatest(1, event_id % 9 - 4) END::DOUBLE AS number, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id END::DOUBLE AS scalar FROM events""",
    "class_names": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1",
    "json_props": "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS n_k, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_at FROM events GROUP BY 1",
    "learning_rate_schedule": "SELECT event_id, round(CASE WHEN event_id < 100 THEN event_id / 100.0::DOUBLE ELSE (1 + cos(pi() * (event_id - 100) / greatest(1, (SELECT count(*) FROM events) - 100))) / 2 END, 9) AS factor FROM events",
    "l2_normalised": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x, i: x::DOUBLE * i) AS v FROM embeddings),
        n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
        SELECT vec_id, round(v[1] / n, 7) AS first, round(v[64] / n, 7) AS last FROM n""",
}
