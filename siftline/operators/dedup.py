"""Exact and near duplicates, cross-set leakage and its report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.tables import table
from siftline.plans.storage import fresh_path

#: Bits of a band at least; hashes of random content then share one with 1 in 256 others.
LEAST_BAND = 8
#: Rate of leaking rows above which a report alerts.
ALERT_RATE = 0.01


def exact_groups(df: DataFrame, id_col: str, key: str) -> DataFrame:
    """Groups of two or more rows with the same key: key, n, first_id.

    The partial aggregate keeps one row per key and task, so a hot key costs nothing.
    Null keys form no group.
    """
    return (
        df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"))
        .where("n >= 2")
    )


def duplicate_summary(df: DataFrame, key: str, dataset: str) -> DataFrame:
    """How many duplicate groups span each set of datasets: datasets (sorted, joined by |), n_groups.

    Two levels of aggregation; the set of a group is bounded by the number of datasets.
    """
    groups = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(dataset)), "|").alias("datasets"))
    return groups.where("n >= 2").groupBy("datasets").agg(F.count(F.lit(1)).alias("n_groups"))


def cross_set_pairs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner equi-join of two (id, key) tables: id_a, id_b, key. Catalyst picks the strategy by size; AQE splits hot keys."""
    return a.select(F.col("id").alias("id_a"), key).join(b.select(F.col("id").alias("id_b"), key), key).select("id_a", "id_b", key)


def hex_bits(h: Column) -> Column:
    """A 16-digit hex hash as a signed 64-bit number; two halves, so that no half overflows."""
    return F.shiftleft(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(h, 9, 8), 16, 10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit numbers."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_pairs(a: DataFrame, b: DataFrame, threshold: int) -> DataFrame:
    """Pairs (id_a, id_b, distance) of two (id, bits) tables within ``threshold`` differing bits.

    Hashes within t bits agree on one of t + 1 disjoint bands, so an equi-join on (band, value)
    finds all of them; each pair is kept at the first band on which it agrees, which needs no
    distinct. A threshold of 0 is a plain equi-join. Bands narrower than LEAST_BAND bits would
    put nearly all rows together, so a larger threshold is refused.
    """
    if threshold > 64 // LEAST_BAND - 1:
        raise ValueError(f"bands of a distance of {threshold} are narrower than {LEAST_BAND} bits")
    if threshold <= 0:
        return cross_set_pairs(a, b, "bits").select("id_a", "id_b", F.lit(0).alias("distance"))
    n = threshold + 1
    edges = [64 * k // n for k in range(n + 1)]
    masks = [((1 << edges[k + 1]) - 1) & ~((1 << edges[k]) - 1) for k in range(n)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]

    def banded(df, name):
        bands = F.array(*(F.struct(F.lit(k).alias("band"), F.col("bits").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(masks)))
        return df.select(F.col("id").alias(f"id_{name}"), F.col("bits").alias(f"bits_{name}"), F.inline(bands))

    x = F.col("bits_a").bitwiseXOR(F.col("bits_b"))
    first = reduce(lambda rest, k: F.when(x.bitwiseAND(F.lit(masks[k])) == 0, F.lit(k)).otherwise(rest), reversed(range(n)), F.lit(n))
    joined = banded(a, "a").join(banded(b, "b"), ["band", "value"])
    return joined.where((F.bit_count(x) <= threshold) & (F.col("band") == first)).select("id_a", "id_b", F.bit_count(x).alias("distance"))


def leakage_report(pool: DataFrame, downstream: DataFrame, key: str) -> DataFrame:
    """One row per downstream set and one overall: name, n_rows, n_pairs, n_leaking, rate, alert.

    Pairs are counted as products of per-key counts, so no pair is made.
    """
    p = pool.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_pool"))
    d = downstream.where(F.col(key).isNotNull()).groupBy("name", key).agg(F.count(F.lit(1)).alias("n_down"))
    hits = d.join(p, key, "left")
    size = pool.agg(F.count(F.lit(1)).alias("pool_size"))
    by_set = hits.groupBy("name").agg(F.sum("n_down").alias("n_rows"), F.coalesce(F.sum(F.col("n_down") * F.col("n_pool")), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("n_pool"), F.lit(0)).alias("n_leaking"))
    every = (
        hits.groupBy(key).agg(F.sum("n_down").alias("n_down"), F.max("n_pool").alias("n_pool")).agg(
            F.coalesce(F.sum("n_down"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n_down") * F.col("n_pool")), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("n_pool"), F.lit(0)).alias("n_leaking"))
        .select(F.lit("*").alias("name"), "n_rows", "n_pairs", "n_leaking")
    )
    rate = F.col("n_leaking") / F.greatest(F.lit(1), F.col("pool_size"))
    return by_set.unionByName(every).join(F.broadcast(size)).select("name", "n_rows", "n_pairs", "n_leaking", rate.alias("rate"), (rate > ALERT_RATE).alias("alert"))


def leaking_ids(pool: DataFrame, downstream: DataFrame, key: str) -> DataFrame:
    """Distinct pool ids whose key occurs downstream."""
    return pool.join(downstream.select(key).distinct(), key, "left_semi").select("id").distinct()


# Queries: documents are the pool.


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def q_exact_duplicate_groups(spark, sf_dir):
    return exact_groups(_docs(spark, sf_dir).select("doc_id", F.md5("text").alias("h")), "doc_id", "h").withColumnRenamed("key", "h")


def q_duplicate_summary(spark, sf_dir):
    return duplicate_summary(_docs(spark, sf_dir).select(F.md5("text").alias("h"), "source"), "h", "source")


def q_cross_set_leakage_exact(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.md5("text").alias("h"), "lang")
    return cross_set_pairs(d.where("id % 2 = 0").select("id", "h"), d.where("id % 2 = 1").select("id", "h"), "h")


def q_leakage_report(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.md5("text").alias("h"), "lang", "source")
    return leakage_report(d.where("source <> 'src0'").select("id", "h"), d.where("source = 'src0'").select(F.col("lang").alias("name"), "h"), "h")


def q_leaking_ids(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.md5("text").alias("h"), "source")
    return leaking_ids(d.where("source <> 'src0'"), d.where("source = 'src0'"), "h")


def _hashes(spark, sf_dir):
    """64-bit hashes of documents with up to seven bits turned by the row, so that near ones exist."""
    d = _docs(spark, sf_dir).select("doc_id", F.substring(F.md5(F.col("source")), 1, 16).alias("h"), F.substring(F.md5("text"), 1, 16).alias("t"))
    turned = [F.call_function("shiftleft", F.lit(1).cast("long"), F.conv(F.substring("t", 2 * k + 1, 2), 16, 10).cast("int") % 64) for k in range(4)]
    bits = hex_bits(F.col("h"))
    for k, t in enumerate(turned):
        bits = bits.bitwiseXOR(F.when(F.col("doc_id") % 4 >= k, t).otherwise(F.lit(0).cast("long")))
    far = hex_bits(F.col("t"))
    return d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, bits).otherwise(far).alias("bits"))


def q_near_duplicate_pairs_hamming(spark, sf_dir):
    """Pairs of even and odd rows' hashes within five bits, most of them far from each other."""
    v = _hashes(spark, sf_dir)
    return hamming_pairs(v.where("id % 20 < 10"), v.where("id % 20 >= 10"), 5)


def q_leaking_list(spark, sf_dir):
    """The leaking ids as a text list, written in order and read again."""
    path = fresh_path(spark, "leaking")
    ids = q_leaking_ids(spark, sf_dir).orderBy("id").select(F.col("id").cast("string").alias("value"))
    ids.coalesce(1).write.text(path)
    return spark.read.text(path).select(F.col("value").cast("long").alias("id"))


def q_hamming_literals(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.substring(F.md5("text"), 1, 16).alias("a"), F.substring(F.md5("text"), 17, 16).alias("b"))
    return d.select("doc_id", hamming(hex_bits(F.col("a")), hex_bits(F.col("b"))).alias("distance"))


QUERIES = {f.__name__[2:]: f for f in (q_exact_duplicate_groups, q_duplicate_summary, q_cross_set_leakage_exact, q_leakage_report, q_leaking_ids, q_near_duplicate_pairs_hamming, q_hamming_literals, q_leaking_list)}


def _turned(k: int) -> str:
    """One bit of 64 by the k-th byte of a hash; the highest one apart, since a shift into it overflows."""
    n = f"(('0x' || substr(t, {2 * k + 1}, 2))::INT % 64)"
    return f"(CASE WHEN {n} = 63 THEN 9223372036854775808::UBIGINT ELSE (1::BIGINT << least({n}, 62))::UBIGINT END)"


ORACLES = {
    "exact_duplicate_groups": "SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
    "duplicate_summary": "SELECT datasets, count(*) AS n_groups FROM (SELECT md5(text) AS h, string_agg(DISTINCT source, '|' ORDER BY source) AS datasets FROM documents GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1",
    "cross_set_leakage_exact": "SELECT a.doc_id AS id_a, b.doc_id AS id_b, md5(a.text) AS h FROM documents a JOIN documents b ON a.text = b.text WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1",
    "leakage_report": """
        WITH p AS (SELECT doc_id, md5(text) AS h FROM documents WHERE source <> 'src0'),
        d AS (SELECT lang AS name, doc_id, md5(text) AS h FROM documents WHERE source = 'src0'),
        pairs AS (SELECT d.name, d.doc_id AS did, p.doc_id AS pid FROM d JOIN p USING (h)),
        rows_ AS (SELECT name, count(*) AS n_rows FROM d GROUP BY 1 UNION ALL SELECT '*', count(*) FROM d),
        hits AS (SELECT name, count(*) AS n_pairs, count(DISTINCT pid) AS n_leaking FROM pairs GROUP BY 1 UNION ALL SELECT '*', count(*), count(DISTINCT pid) FROM pairs),
        r AS (SELECT name, CAST(n_rows AS BIGINT) AS n_rows, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_leaking, 0) AS n_leaking,
                     coalesce(n_leaking, 0) / greatest(1, (SELECT count(*) FROM p))::DOUBLE AS rate FROM rows_ LEFT JOIN hits USING (name))
        SELECT *, rate > 0.01 AS alert FROM r""",
    "leaking_ids": "SELECT DISTINCT doc_id AS id FROM documents WHERE source <> 'src0' AND md5(text) IN (SELECT md5(text) FROM documents WHERE source = 'src0')",
    "near_duplicate_pairs_hamming": """
        WITH d AS (SELECT doc_id, ('0x' || substr(md5(source), 1, 16))::UBIGINT AS h, substr(md5(text), 1, 16) AS t, ('0x' || substr(md5(text), 1, 16))::UBIGINT AS f FROM documents),
        v AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN xor(xor(xor(xor(h, """ + "), ".join(f"CASE WHEN doc_id % 4 >= {k} THEN {_turned(k)} ELSE 0::UBIGINT END" for k in range(4)) + """) ELSE f END AS b FROM d),
        p AS (SELECT x.doc_id AS id_a, y.doc_id AS id_b, bit_count(xor(x.b, y.b))::INT AS distance FROM v x, v y WHERE x.doc_id % 20 < 10 AND y.doc_id % 20 >= 10)
        SELECT * FROM p WHERE distance <= 5""",
    "leaking_list": "SELECT DISTINCT doc_id AS id FROM documents WHERE source <> 'src0' AND md5(text) IN (SELECT md5(text) FROM documents WHERE source = 'src0')",
    "hamming_literals": "SELECT doc_id, CAST(bit_count(xor(('0x' || substr(md5(text), 1, 8))::UBIGINT::HUGEINT, ('0x' || substr(md5(text), 17, 8))::UBIGINT::HUGEINT)) + bit_count(xor(('0x' || substr(md5(text), 9, 8))::UBIGINT::HUGEINT, ('0x' || substr(md5(text), 25, 8))::UBIGINT::HUGEINT)) AS INT) AS distance FROM documents",
}
