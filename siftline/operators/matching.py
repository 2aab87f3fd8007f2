"""Matching of vectors and positions: mutual nearest neighbours, radius joins, dense losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.scalars import dot, l2_normalise, seeded_order
from siftline.functions.tables import table

TINY = 1e-20


def mutual_nearest(df: DataFrame, image: str, row: str, scale: str, vec: str, threshold: float = 0.7, stratified: bool = False) -> DataFrame:
    """(image, i, j, sim, log_r): pairs of one image at different scales that are each other's nearest.

    Ties go to the lowest row. Pairs are listed once, i < j; stratified matching does the same for
    every pair of scales, from the smaller scale to the larger. An image's rows are one group of
    a few patches; pairs are made inside it only.
    """
    a = df.select(image, F.col(row).alias("i"), F.col(scale).alias("si"), l2_normalise(F.col(vec)).alias("ui"))
    b = a.select(image, F.col("i").alias("j"), F.col("si").alias("sj"), F.col("ui").alias("uj"))
    pairs = a.join(b, image).where("si <> sj").select(image, "i", "j", "si", "sj", dot(F.col("ui"), F.col("uj")).alias("sim"))
    key = [image, "i", "sj"] if stratified else [image, "i"]
    best = pairs.where(F.col("sim").isNotNull()).groupBy(*key).agg(F.max_by(F.struct("j", "si", "sj", "sim"), F.struct("sim", -F.col("j"))).alias("b"))
    best = best.select(image, "i", "b.j", "b.si", F.col("b.sj").alias("to"), "b.sim")
    back = best.select(image, F.col("i").alias("j"), F.col("j").alias("i"))
    if stratified:
        back = best.select(image, F.col("i").alias("j"), F.col("j").alias("i"), F.col("to").alias("si"))
        found = best.join(back, [image, "i", "j", "si"]).where("si < to")
    else:
        found = best.join(back, [image, "i", "j"]).where("i < j")
    return found.where(F.col("sim") >= threshold).select(image, "i", "j", "sim", (F.col("to") - F.col("si")).alias("log_r"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def radius_join(q: DataFrame, k: DataFrame, group: str, radius: float, nearest: bool = False) -> DataFrame:
    """(group, q, k, dist) within a radius, from tables (group, id, cx, cy).

    Keys are put under their grid cell, queries under the nine cells around theirs, so the join is an
    equi-join and only neighbours meet.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    keys = k.select(group, F.col("id").alias("k"), F.col("cx").alias("kx"), F.col("cy").alias("ky"), cell("cx").alias("gx"), cell("cy").alias("gy"))
    steps = F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    near = q.select(group, F.col("id").alias("q"), "cx", "cy", F.inline(steps)).select(group, "q", "cx", "cy", (cell("cx") + F.col("dx")).alias("gx"), (cell("cy") + F.col("dy")).alias("gy"))
    hits = near.join(keys, [group, "gx", "gy"]).withColumn("dist", distance(F.col("cx"), F.col("cy"), F.col("kx"), F.col("ky"))).where(F.col("dist") <= radius)
    if nearest:
        hits = hits.groupBy(group, "q").agg(F.min(F.struct("dist", "k")).alias("b")).select(group, "q", "b.k", "b.dist")
    return hits.select(group, "q", "k", "dist")


def subsample(df: DataFrame, image: str, pos: str, n: int, seed: int) -> DataFrame:
    """n positions of each image by seeded hash; all if it has no more."""
    order = Window.partitionBy(image).orderBy(seeded_order(seed, F.col(image), F.col(pos)))
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def dense_loss(q: DataFrame, k: DataFrame, queue: DataFrame | None = None, others: DataFrame | None = None, temperature: float = 0.2, radius: float = 0.07, mode: str = "threshold", strict: bool = False, level: float = 0.0, t_scale: float | None = None) -> DataFrame:
    """One row: loss, matched_frac, mean_pos_sim, mean_neg_sim, acc_top1, n_used.

    q and k are (img, id, cx, cy, vec). A query's positives are the keys of its image within the
    radius (or the nearest of them); everything else is in the denominator: the other keys of the
    image, the queue (vec[, tag]; with ``t_scale`` weighted by exp(-|level - tag| / t_scale)), and
    ``others``, keys of the image's other levels, without the near ones if ``strict``.
    Queries without a positive don't count. The queue is a bounded buffer and is broadcast as such.
    """
    a = q.select("img", F.col("id").alias("q"), "cx", "cy", l2_normalise(F.col("vec")).alias("u"))

    def against(keys):
        b = keys.select("img", F.col("id").alias("k"), F.col("cx").alias("kx"), F.col("cy").alias("ky"), l2_normalise(F.col("vec")).alias("w"))
        return a.join(b, "img").select("img", "q", "k", distance(F.col("cx"), F.col("cy"), F.col("kx"), F.col("ky")).alias("dist"), dot(F.col("u"), F.col("w")).alias("sim"))

    pairs = against(k)
    near = F.col("dist") <= radius
    if mode == "nearest":
        near = near & (F.struct("dist", "k") == F.min(F.struct("dist", "k")).over(Window.partitionBy("img", "q")))
    pairs = pairs.withColumn("pos", near).select("img", "q", F.col("k").cast("long"), "pos", "sim", F.lit(1.0).alias("wt"), F.lit("in").alias("part"))
    if others is not None:
        other = against(others)
        pairs = pairs.unionByName((other.where(F.col("dist") > radius) if strict else other).select("img", "q", F.lit(None).cast("long").alias("k"), F.lit(False).alias("pos"), "sim", F.lit(1.0).alias("wt"), F.lit("other").alias("part")))
    if queue is not None:
        weight = F.exp(-F.abs(F.lit(level) - F.col("tag")) / t_scale) if t_scale else F.lit(1.0)
        bank = queue.select(l2_normalise(F.col("vec")).alias("w"), weight.alias("wt"), F.lit(1).alias("one"))
        pairs = pairs.unionByName(a.withColumn("one", F.lit(1)).join(F.broadcast(bank), "one").select("img", "q", F.lit(None).cast("long").alias("k"), F.lit(False).alias("pos"), dot(F.col("u"), F.col("w")).alias("sim"), "wt", F.lit("queue").alias("part")))
    pairs = pairs.withColumn("l", F.col("sim") / temperature)
    peak = pairs.groupBy("img", "q").agg(F.max("l").alias("m"), F.max(F.col("pos").cast("int")).alias("used"))
    e = F.exp(F.col("l") - F.col("m"))
    neg = ~F.col("pos") & ((F.col("part") != "queue") | (F.col("used") == 1))
    by = pairs.join(peak, ["img", "q"]).groupBy("img", "q").agg(
        F.max("used").alias("used"), F.sum(F.when(F.col("pos"), e).otherwise(0.0)).alias("p"), F.sum(e * F.col("wt")).alias("t"),
        F.sum(F.when(F.col("pos"), F.col("sim"))).alias("ps"), F.sum(F.col("pos").cast("long")).alias("pn"),
        F.sum(F.when(neg, F.col("sim") * F.col("wt"))).alias("ns"), F.sum(F.when(neg, F.col("wt"))).alias("nw"),
        F.max_by("pos", F.struct("sim", F.coalesce(-F.col("k"), F.lit(-(2**62))))).cast("int").alias("hit"))
    used = F.col("used") == 1
    return by.agg(
        F.coalesce(F.avg(F.when(used, -F.log(F.col("p") + TINY) + F.log(F.col("t") + TINY))), F.lit(0.0)).alias("loss"),
        F.coalesce(F.avg(F.col("used").cast("double")), F.lit(0.0)).alias("matched_frac"),
        F.coalesce(F.sum("ps") / F.sum("pn"), F.lit(0.0)).alias("mean_pos_sim"), F.coalesce(F.sum("ns") / F.sum("nw"), F.lit(0.0)).alias("mean_neg_sim"),
        F.coalesce(F.avg(F.when(used, F.col("hit").cast("double"))), F.lit(0.0)).alias("acc_top1"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_used"))


def symmetric_pair_error(pairs: DataFrame, vectors: DataFrame, other: DataFrame, row: str, vec: str) -> DataFrame:
    """Half the sum of squared errors both ways over matched pairs; none gives 0."""
    from siftline.operators.vectors import squared_error

    a = vectors.select(F.col(row).alias("i"), F.col(vec).alias("vi"))
    b = other.select(F.col(row).alias("j"), F.col(vec).alias("vj"))
    c = vectors.select(F.col(row).alias("j"), F.col(vec).alias("oj"))
    d = other.select(F.col(row).alias("i"), F.col(vec).alias("ei"))
    p = pairs.join(a, "i").join(b, "j").join(c, "j").join(d, "i")
    return p.agg(F.coalesce(F.avg((squared_error(F.col("vi"), F.col("vj")) + squared_error(F.col("oj"), F.col("ei"))) / 2), F.lit(0.0)).alias("loss"), F.count(F.lit(1)).alias("n_pairs"))


# Queries: eight neighbouring vectors are an image, labels its scales; places follow from ids.


def _grid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 32).alias("img"), F.col("vec_id").alias("id"), ((F.col("vec_id") * 37) % 101 / F.lit(101.0)).alias("cx"), ((F.col("vec_id") * 53) % 97 / F.lit(97.0)).alias("cy"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def _round(df, n=6):
    return df.select(*(F.round(F.col(c) + 1e-10, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _bank(g, k):
    """What buffers of k vectors a level hold after all of the table."""
    from siftline.streaming.state import last_k

    return last_k(g, "label", ["id"], k)


def q_subsampled_positions(spark, sf_dir):
    return subsample(_grid(spark, sf_dir).select("img", "id", "cx"), "img", "id", 5, 17)


def q_mutual_nn_pairs(spark, sf_dir):
    e = _grid(spark, sf_dir).withColumn("g", F.floor(F.col("id") / 8))
    return _round(mutual_nearest(e, "g", "id", "label", "vec", 0.2))


def q_mutual_nn_stratified(spark, sf_dir):
    e = _grid(spark, sf_dir).withColumn("g", F.floor(F.col("id") / 16)).withColumn("s", F.col("label") % 3)
    return _round(mutual_nearest(e, "g", "id", "s", "vec", 0.25, stratified=True))


def q_radius_match(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return _round(radius_join(g.where("id % 2 = 0"), g.where("id % 2 = 1"), "img", 0.15))


def q_nearest_match(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return _round(radius_join(g.where("id % 2 = 0"), g.where("id % 2 = 1"), "img", 0.15, nearest=True))


def q_dense_ntxent(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return _round(dense_loss(g.where("id % 2 = 0"), g.where("id % 2 = 1"), _bank(g, 2).select("vec"), radius=0.15))


def q_dense_within_levels(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return _round(dense_loss(g.where("id % 4 = 0"), g.where("id % 4 = 1"), None, g.where("id % 4 > 1"), radius=0.15, strict=True))


def q_dense_across_levels(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return _round(dense_loss(g.where("id % 2 = 0"), g.where("id % 2 = 1"), _bank(g, 4).select("vec", F.col("label").alias("tag")), radius=0.15, level=4.0, t_scale=2.0))


def q_natural_pair_error(spark, sf_dir):
    e = _grid(spark, sf_dir).withColumn("g", F.floor(F.col("id") / 8))
    pairs = mutual_nearest(e, "g", "id", "label", "vec", 0.2)
    return _round(symmetric_pair_error(pairs, e, e.withColumn("vec", F.transform("vec", lambda x: x * 0.5)), "id", "vec"))


QUERIES = {f.__name__[2:]: f for f in (q_subsampled_positions, q_mutual_nn_pairs, q_mutual_nn_stratified, q_radius_match, q_nearest_match, q_dense_ntxent, q_dense_within_levels, q_dense_across_levels, q_natural_pair_error)}
_G = "g AS (SELECT vec_id // 32 AS img, vec_id AS id, vec_id * 37 % 101 / 101.0::DOUBLE AS cx, vec_id * 53 % 97 / 97.0::DOUBLE AS cy, label, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings)"
_M = _G + ", p AS (SELECT a.id // {n} AS g, a.id AS i, b.id AS j, {s}a.label{e} AS si, {s}b.label{e} AS sj, list_cosine_similarity(a.vec, b.vec) AS sim FROM g a JOIN g b ON a.id // {n} = b.id // {n} AND {s}a.label{e} <> {s}b.label{e})"
_MU = _M.format(n=8, s="", e="") + ", b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY g, i ORDER BY sim DESC, j) = 1), m AS (SELECT x.g, x.i, x.j, x.sim, x.sj - x.si AS log_r FROM b x JOIN b y ON x.i = y.j AND x.j = y.i WHERE x.i < x.j AND x.sim >= 0.2)"
_RJ = "r AS (SELECT a.img, a.id AS q, b.id AS k, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) AS dist FROM g a JOIN g b ON a.img = b.img AND a.id % 2 = 0 AND b.id % 2 = 1)"


def _dense_sql(parts: str) -> str:
    """parts: CTE ``s`` of pairs (q, k, pos, sim, wt, part)."""
    return f"""WITH {_G}, {parts}, m AS (SELECT *, max(pos::INT) OVER (PARTITION BY q) AS used, sim / 0.2::DOUBLE AS l FROM s),
        q AS (SELECT q, max(used) AS used, -ln(sum(CASE WHEN pos THEN exp(l) ELSE 0 END) + 1e-20) + ln(sum(exp(l) * wt)) AS loss, sum(CASE WHEN pos THEN sim END) AS ps, sum(pos::INT) AS pn,
              sum(CASE WHEN NOT pos AND (part <> 'queue' OR used = 1) THEN sim * wt END) AS ns, sum(CASE WHEN NOT pos AND (part <> 'queue' OR used = 1) THEN wt END) AS nw, first(pos::INT ORDER BY sim DESC, coalesce(k, 4611686018427387904)) AS hit FROM m GROUP BY 1)
        SELECT round(avg(CASE WHEN used = 1 THEN loss END) + 1e-10, 6) AS loss, round(avg(used) + 1e-10, 6) AS matched_frac, round(sum(ps) / sum(pn) + 1e-10, 6) AS mean_pos_sim, round(sum(ns) / sum(nw) + 1e-10, 6) AS mean_neg_sim,
               round(avg(CASE WHEN used = 1 THEN hit END) + 1e-10, 6) AS acc_top1, sum(used)::BIGINT AS n_used FROM q"""


def _pair_sql(q: str, k: str, more: str = "") -> str:
    return f"SELECT a.id AS q, b.id AS k, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) AS dist, list_cosine_similarity(a.vec, b.vec) AS sim FROM g a JOIN g b ON a.img = b.img AND {q} AND {k} {more}"


ORACLES = {
    "subsampled_positions": f"WITH {_G} SELECT img, id, cx FROM g QUALIFY row_number() OVER (PARTITION BY img ORDER BY sha256('17:' || img || ':' || id)) <= 5",
    "mutual_nn_pairs": f"WITH {_MU} SELECT g, i, j, round(sim + 1e-10, 6) AS sim, log_r FROM m",
    "mutual_nn_stratified": "WITH " + _M.format(n=16, s="(", e=" % 3)") + ", b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY g, i, sj ORDER BY sim DESC, j) = 1) SELECT x.g, x.i, x.j, round(x.sim + 1e-10, 6) AS sim, x.sj - x.si AS log_r FROM b x JOIN b y ON x.i = y.j AND x.j = y.i WHERE x.si < x.sj AND x.sim >= 0.25",
    "radius_match": f"WITH {_G}, {_RJ} SELECT img, q, k, round(dist + 1e-10, 6) AS dist FROM r WHERE dist <= 0.15",
    "nearest_match": f"WITH {_G}, {_RJ} SELECT img, q, k, round(dist + 1e-10, 6) AS dist FROM r WHERE dist <= 0.15 QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, k) = 1",
    "dense_ntxent": _dense_sql(f"i AS ({_pair_sql('a.id % 2 = 0', 'b.id % 2 = 1')}), s AS (SELECT q, k, dist <= 0.15 AS pos, sim, 1.0::DOUBLE AS wt, 'in' AS part FROM i UNION ALL SELECT a.id, NULL, false, list_cosine_similarity(a.vec, b.vec), 1.0, 'queue' FROM g a JOIN (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY id DESC) <= 2) b ON a.id % 2 = 0)"),
    "dense_within_levels": _dense_sql(f"i AS ({_pair_sql('a.id % 4 = 0', 'b.id % 4 = 1')}), o AS ({_pair_sql('a.id % 4 = 0', 'b.id % 4 > 1')}), s AS (SELECT q, k, dist <= 0.15 AS pos, sim, 1.0::DOUBLE AS wt, 'in' AS part FROM i UNION ALL SELECT q, NULL, false, sim, 1.0, 'other' FROM o WHERE dist > 0.15)"),
    "dense_across_levels": _dense_sql(f"i AS ({_pair_sql('a.id % 2 = 0', 'b.id % 2 = 1')}), s AS (SELECT q, k, dist <= 0.15 AS pos, sim, 1.0::DOUBLE AS wt, 'in' AS part FROM i UNION ALL SELECT a.id, NULL, false, list_cosine_similarity(a.vec, b.vec), exp(-abs(4 - b.label) / 2.0::DOUBLE), 'queue' FROM g a JOIN (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY id DESC) <= 4) b ON a.id % 2 = 0)"),
    "natural_pair_error": f"WITH {_MU}, e AS (SELECT (list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2] * 0.5::DOUBLE) ** 2)) + list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[2] - z[1] * 0.5::DOUBLE) ** 2))) / 128 AS e FROM m JOIN g a ON a.id = m.i JOIN g b ON b.id = m.j) SELECT round(coalesce(avg(e), 0) + 1e-10, 6) AS loss, count(*) AS n_pairs FROM e",
}
