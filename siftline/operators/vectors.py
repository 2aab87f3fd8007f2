"""Similarity losses, feature statistics, disagreement and consensus over vector tables.

Vectors stay arrays of one row each. Sums run in double precision and in array order, so a
result does not depend on partitions. Pairwise losses join small batches by their batch key;
a batch is the unit of the loss, so the pairs are its definition, and they are folded at once.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.scalars import dot, l2_normalise, let, norm
from siftline.functions.tables import table
from siftline.operators.results import log_sum_exp


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, k: Column) -> Column:
    return F.transform(a, lambda x: x * k)


def squared_error(a: Column, b: Column) -> Column:
    """Mean squared difference of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def variance_of(a: Column, ddof: int = 1) -> Column:
    return let(mean_of(a), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))) / (F.size(a) - ddof)


def _fold(pairs: DataFrame, by: list[str], positive: Column, similarity: Column, temperature: float) -> DataFrame:
    """by, loss = lse(all logits) - positive logit, from one row a pair, in one aggregation.

    Similarities of unit vectors are at most 1, so 1 / temperature bounds the logits and serves
    as the shift; no pass looks for the largest one.
    """
    top = 1.0 / temperature
    d = pairs.withColumn("__l", similarity / temperature)
    return d.groupBy(*by).agg((F.log(F.sum(F.exp(F.col("__l") - top))) + top - F.max(F.when(positive, F.col("__l")))).alias("loss"))


def ntxent(views: DataFrame, batch: str, pos: str, view: str | None, vec: str, temperature: float = 0.2, labels: str | None = None) -> DataFrame:
    """NT-Xent by batch: rows (batch, pos, view 0/1, vec); a row's positive is the other view at its position.

    Without ``view`` each row stands for both views. Batches with fewer than two positions have
    loss 0. ``labels`` are not used, and a warning says so.
    """
    if labels is not None:
        warnings.warn("labels are not used by this loss", stacklevel=2)
    if view is None:
        view = "__view"
        views = views.withColumn(view, F.explode(F.array(F.lit(0), F.lit(1))))
    u = views.select(batch, F.struct(pos, view).alias("__k"), F.col(pos).alias("__p"), l2_normalise(F.col(vec), 1e-8).alias("__u"))
    o = u.select(batch, F.col("__k").alias("__k2"), F.col("__p").alias("__p2"), F.col("__u").alias("__u2"))
    pairs = u.join(o, batch).where("__k <> __k2")
    loss = _fold(pairs, [batch, "__k"], F.col("__p") == F.col("__p2"), dot(F.col("__u"), F.col("__u2")), temperature)
    sizes = views.groupBy(batch).agg(F.count_distinct(pos).alias("n"))
    mean = loss.groupBy(batch).agg(F.avg("loss").alias("loss"))
    return sizes.join(mean, batch, "left").select(batch, "n", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.col("loss")).alias("loss"))


def infonce(queries: DataFrame, keys: DataFrame, batch: str, pos: str, vec: str, temperature: float = 0.2) -> DataFrame:
    """Query-to-key InfoNCE by batch, times twice the temperature, and top-1 accuracy (lowest position on ties)."""
    q = queries.select(batch, F.col(pos).alias("__i"), l2_normalise(F.col(vec)).alias("__q"))
    k = keys.select(batch, F.col(pos).alias("__j"), l2_normalise(F.col(vec)).alias("__k"))
    pairs = q.join(k, batch).select(batch, "__i", "__j", dot(F.col("__q"), F.col("__k")).alias("__s"))
    top = 1.0 / temperature
    own = F.max(F.when(F.col("__i") == F.col("__j"), F.col("__s")))
    each = pairs.groupBy(batch, "__i").agg((F.log(F.sum(F.exp(F.col("__s") / temperature - top))) + top - own / temperature).alias("loss"), F.max_by("__j", F.struct("__s", -F.col("__j"))).alias("__top"))
    return each.groupBy(batch).agg((F.avg("loss") * (2 * temperature)).alias("loss"), F.avg((F.col("__top") == F.col("__i")).cast("double")).alias("top1"))


def regularisation(df: DataFrame, vec: str, dims: int, target: float = 1.0, eps: float = 1e-4) -> DataFrame:
    """Variance hinge, covariance and isotropy of a feature table, from one pass of sums.

    Each task adds up the outer products of its rows in numpy and sends one row a pair of
    dimensions, whatever its rows. Fewer than two rows give zeros.
    """

    def products(stream):
        total = np.zeros((dims + 1, dims + 1))
        for batch in stream:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, dims)
            x = np.hstack([np.ones((len(x), 1)), x])
            total += x.T @ x
        i, j = np.triu_indices(dims + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    sums = df.where(F.col(vec).isNotNull()).select(vec).mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    n, x = F.max(F.when(F.expr("i = 0 AND j = 0"), F.col("s"))), F.map_from_entries(F.collect_list(F.when(F.expr("i = 0 AND j > 0"), F.struct("j", "s"))))
    pairs = F.collect_list(F.when(F.col("i") > 0, F.struct("i", "j", "s")))
    d = sums.agg(n.alias("n"), x.alias("x"), pairs.alias("p"))  # (dims + 1) squared over two numbers
    d = d.select(F.col("n").cast("long").alias("n"), F.transform("p", lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j"), ((p["s"] - F.col("x")[p["i"]] * F.col("x")[p["j"]] / F.col("n")) / (F.col("n") - 1)).alias("c"))).alias("p"))
    d = d.select("n", F.transform(F.array_sort(F.filter("p", lambda p: p["i"] == p["j"])), lambda p: p["c"]).alias("var"), F.transform(F.array_sort(F.filter("p", lambda p: p["i"] < p["j"])), lambda p: p["c"]).alias("cov"))
    spread = mean_of(F.transform("var", lambda v: F.greatest(F.lit(0.0), F.lit(float(target)) - F.sqrt(v + eps))))
    off = F.aggregate("cov", F.lit(0.0), lambda s, c: s + 2 * c * c) / dims
    iso = variance_of(F.col("var")) / (F.pow(mean_of(F.col("var")), 2) + eps)
    few = F.coalesce(F.col("n") < 2, F.lit(True))
    return d.select(F.coalesce("n", F.lit(0).cast("long")).alias("n"), *(F.when(few, F.lit(0.0)).otherwise(c).alias(a) for a, c in (("variance", spread), ("covariance", off), ("isotropy", iso))))


def disagreement(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """One minus the cosine, lengths held at eps."""
    return 1 - dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def disagreement_weight(d: Column, alpha: float | Column = 1.0) -> Column:
    """exp(alpha d), alpha within 3 of 0, at most 10."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.least(F.exp(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), a)) * d), F.lit(10.0))


def softmax_kl(student: Column, teacher: Column, temperature: float = 4.0) -> Column:
    """KL(teacher || student) of two arrays softened by a temperature, times its square."""
    t, s = (F.transform(c, lambda v: v.cast("double") / temperature) for c in (teacher, student))

    def divergence(v):
        parts = F.zip_with(t, s, lambda x, y: F.exp(x - v["t"]) * ((x - v["t"]) - (y - v["s"])))
        return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x) * (temperature * temperature)

    return let(F.struct(log_sum_exp(t).alias("t"), log_sum_exp(s).alias("s")), divergence)


def consensus_target(a: Column, b: Column, w: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x * w + y * (1 - w))


def consensus_loss(df: DataFrame, student: str, first: str, second: str, level: str, w: float = 0.5, alpha: float = 1.0, beta: float = 1.0, weight: Column | None = None) -> DataFrame:
    """By level and overall: squared error to the mixed target and KL to both teachers, each times the weight."""
    dw = F.lit(1.0) if weight is None else weight
    form_b = squared_error(F.col(student), consensus_target(F.col(first), F.col(second), w)) * dw
    kl = softmax_kl(F.col(student), F.col(first)) + softmax_kl(F.col(student), F.col(second))
    by = df.select(level, form_b.alias("__b"), kl.alias("__c"), dw.alias("__w")).groupBy(level).agg(F.avg("__b").alias("form_b"), (F.avg("__c") * F.avg("__w")).alias("form_c"))
    return by.withColumn("loss", F.col("form_b") * alpha + F.col("form_c") * beta)


def consensus_gate(student: Column, teachers: list[Column]) -> Column:
    """Softmax over teachers of affinity to the student times mean agreement with the other teachers."""
    def cosine(a, b):
        return dot(a, b) / (F.greatest(norm(a), F.lit(1e-8)) * F.greatest(norm(b), F.lit(1e-8)))

    n = len(teachers)
    scores = [cosine(student, t) * sum((cosine(t, o) for j, o in enumerate(teachers) if j != i), F.lit(0.0)) / (n - 1) for i, t in enumerate(teachers)]
    total = sum((F.exp(s) for s in scores), F.lit(0.0))
    return F.array(*(F.exp(s) / total for s in scores))


def fuse(gates: Column, teachers: list[Column]) -> Column:
    out = scale(teachers[0], gates[0])
    for k, t in enumerate(teachers[1:], 1):
        out = add(out, scale(t, gates[k]))
    return out


def film(vec: Column, gamma: Column, beta: Column) -> Column:
    """(1 + gamma) * vec + beta, by dimension."""
    return F.zip_with(F.zip_with(vec, gamma, lambda x, g: x * (1 + g)), beta, lambda x, b: x + b)


def identity_distance(gamma: Column, beta: Column) -> Column:
    """Mean square of gamma plus mean square of beta."""
    return dot(gamma, gamma) / F.size(gamma) + dot(beta, beta) / F.size(beta)


def candidate_infonce(df: DataFrame, by: str, prediction: Column, target: Column, real: Column, temperature: float, similarity: str = "cosine") -> DataFrame:
    """Rows (sample, candidate): -log softmax of the real candidate's similarity; one candidate falls back to squared error."""
    s = dot(l2_normalise(prediction), l2_normalise(target)) if similarity == "cosine" else -squared_error(prediction, target)
    d = df.select(by, real.alias("__real"), (s / temperature).alias("__l"), squared_error(prediction, target).alias("__e"))
    top = 1.0 / temperature if similarity == "cosine" else 0.0  # no logit lies above
    loss = F.log(F.sum(F.exp(F.col("__l") - top))) + top - F.max(F.when(F.col("__real"), F.col("__l")))
    return d.groupBy(by).agg(F.when(F.count(F.lit(1)) > 1, loss).otherwise(F.max(F.when(F.col("__real"), F.col("__e")))).alias("loss"))


def level_mean(losses: DataFrame, level: str, loss: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean over levels; weights are made to sum to one, a level without one counts 0."""
    if weights is None:
        return losses.agg(F.avg(loss).alias("loss"))
    if sum(weights.values()) <= 0:
        raise ValueError("weights must sum to more than 0")
    w = F.coalesce(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))[F.col(level)], F.lit(0.0))
    return losses.where(w > 0).agg((F.sum(w * F.col(loss)) / F.lit(float(sum(weights.values())))).alias("loss"))


def pooled(df: DataFrame, by: str, vec: str, dims: int) -> DataFrame:
    """Global average pooling: the mean vector of each group, as plain averages that combine before the shuffle."""
    means = df.groupBy(by).agg(*(F.avg(F.get(F.col(vec), F.lit(i)).cast("double")).alias(f"m{i}") for i in range(dims)))
    return means.select(by, F.array(*(f"m{i}" for i in range(dims))).alias("vec"))


def channels(df: DataFrame, level: str, vec: str) -> DataFrame:
    return df.groupBy(level).agg(F.max(F.size(vec)).alias("channels"))


def linear_probe(df: DataFrame, vec: str, label: str, epochs: int = 20, reg: float = 0.0):
    """Multinomial logistic regression on pooled vectors (MLlib)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = df.select(array_to_vector(F.col(vec)).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=epochs, regParam=reg).fit(data)


def _vecs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _pairs(spark, sf_dir):
    """Neighbouring vectors as two views: pair, a, b, label of the first."""
    return _vecs(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 2).alias("pair")).agg(F.max(F.when(F.col("vec_id") % 2 == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("vec_id") % 2 == 1, F.col("v"))).alias("b"), F.min("label").alias("label")).where("a is not null and b is not null")


def _views(spark, sf_dir):
    return _vecs(spark, sf_dir).select(F.floor(F.col("vec_id") / 32).alias("batch"), (F.floor(F.col("vec_id") / 2) % 16).alias("pos"), (F.col("vec_id") % 2).alias("view"), "v")


def q_ntxent_loss(spark, sf_dir):
    return ntxent(_views(spark, sf_dir), "batch", "pos", "view", "v").select("batch", "n", F.round("loss", 6).alias("loss"))


def q_ntxent_one_view(spark, sf_dir):
    """Each vector is both of its views."""
    v = _vecs(spark, sf_dir).select(F.floor(F.col("vec_id") / 12).alias("batch"), (F.col("vec_id") % 12).alias("pos"), "v")
    return ntxent(v, "batch", "pos", None, "v", 0.5).select("batch", "n", F.round("loss", 6).alias("loss"))


def q_infonce_moco(spark, sf_dir):
    v = _views(spark, sf_dir)
    return infonce(v.where("view = 0"), v.where("view = 1"), "batch", "pos", "v").select("batch", F.round("loss", 6).alias("loss"), F.round("top1", 6).alias("top1"))


def q_vicreg_statistics(spark, sf_dir):
    r = regularisation(_vecs(spark, sf_dir), "v", 64)
    return r.select("n", *(F.round(c, 9).alias(c) for c in ("variance", "covariance", "isotropy")))


def q_cosine_disagreement(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    d = disagreement(F.col("a"), F.col("b"))
    return p.select("pair", F.round(d, 6).alias("d"), F.round(disagreement_weight(d, 2.5), 6).alias("w"))


def q_cwd_kl(spark, sf_dir):
    return _pairs(spark, sf_dir).select("pair", F.round(softmax_kl(F.col("a"), F.col("b")) * 1000, 6).alias("kl"))


def q_consensus_loss(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("s", F.transform("a", lambda x: x * 0.5))
    return consensus_loss(p, "s", "a", "b", "label", 0.3).select("label", F.round("form_b", 8).alias("form_b"), F.round("form_c", 6).alias("form_c"), F.round("loss", 6).alias("loss"))


def q_consensus_gate(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("s", F.transform("a", lambda x: x * 2 + 0.1))
    g = p.withColumn("g", consensus_gate(F.col("s"), [F.col("a"), F.col("b")]))
    return g.select("pair", F.round(F.col("g")[0], 6).alias("g0"), F.round(fuse(F.col("g"), [F.col("a"), F.col("b")])[3], 6).alias("fused"))


def q_film_transform(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    f = film(F.col("a"), F.transform("b", lambda x: x * 0.5), F.transform("b", lambda x: -x))
    return p.select("pair", F.round(squared_error(f, F.col("b")), 8).alias("error"), F.round(identity_distance(F.transform("b", lambda x: x * 0.5), F.col("b")), 8).alias("distance"))


def q_candidate_infonce(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("c", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))))
    moved = F.zip_with("a", "b", lambda x, y: x * F.col("c") + y * 0.25)
    d = candidate_infonce(p.withColumn("m", moved), "pair", F.col("m"), F.col("b"), F.col("c") == 1.0, 0.07)
    return d.select("pair", F.round("loss", 5).alias("loss"))


def q_level_weighted_loss(spark, sf_dir):
    l = _pairs(spark, sf_dir).groupBy((F.col("label") % 3).cast("string").alias("level")).agg(F.avg(disagreement(F.col("a"), F.col("b"))).alias("loss"))
    return level_mean(l, "level", "loss", {"0": 1.0, "1": 3.0, "2": 0.0}).select(F.round("loss", 6).alias("loss"))


def q_pooled_features(spark, sf_dir):
    p = pooled(_vecs(spark, sf_dir), "label", "v", 64)
    return p.select("label", F.round(norm(F.col("vec")), 6).alias("length"), F.round(F.col("vec")[5], 6).alias("x5"))


def q_channels(spark, sf_dir):
    d = _vecs(spark, sf_dir).select((F.col("label") % 3).cast("string").alias("level"), F.slice("v", F.lit(1), (F.col("label") % 3 + 1) * 16).alias("v"))
    return channels(d, "level", "v")


def q_linear_probe(spark, sf_dir):
    """A probe on pooled pairs whose classes a plane divides: every row is told right."""
    d = _vecs(spark, sf_dir).select("vec_id", F.when(F.col("v")[0] > 0, 1).otherwise(0).alias("cls"), F.transform("v", lambda x, i: F.when(i == 0, F.when(x > 0, x + 1).otherwise(x - 1)).otherwise(x)).alias("v"))
    from pyspark.ml.functions import array_to_vector

    model = linear_probe(d, "v", "cls", 30)
    told = model.transform(d.select("vec_id", "cls", array_to_vector("v").alias("features")))
    return told.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("prediction") == F.col("cls")).cast("long")).alias("n_right"))


def q_matching_weights(spark, sf_dir):
    """Weights of a checkpoint that a model has: labels are layers, shapes differ on purpose in some; first layers alone, and frozen ones."""
    from siftline.sources.discovery import frozen_flags, matching_weights

    keyed = _vecs(spark, sf_dir).select(F.concat(F.lit("model."), "label", F.lit(".w"), "vec_id").alias("key"), F.array(F.lit(8), F.when(F.col("vec_id") % 5 == 0, 4).otherwise(8)).alias("shape"), "v", "label")
    model = keyed.select("key", F.array(F.lit(8), F.lit(8)).alias("shape")).unionByName(spark.createDataFrame([("head.w", [8, 8])], "key string, shape array<int>"))
    hit, first = matching_weights(keyed.select("key", "shape", "v"), model), matching_weights(keyed.select("key", "shape", "v"), model, 4)
    frozen = frozen_flags(model, 4)
    out = None
    for name, d in (("all", hit), ("first", first), ("frozen", frozen.where("frozen")), ("free", frozen.where("NOT frozen"))):
        part = d.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {f.__name__[2:]: f for f in (q_channels, q_linear_probe, q_matching_weights, q_ntxent_loss, q_ntxent_one_view, q_infonce_moco, q_vicreg_statistics, q_cosine_disagreement, q_cwd_kl, q_consensus_loss, q_consensus_gate, q_film_transform, q_candidate_infonce, q_level_weighted_loss, q_pooled_features)}
_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)"
_B = _V + ", u AS (SELECT vec_id // 32 AS batch, vec_id // 2 % 16 AS pos, vec_id % 2 AS view, vec_id, list_transform(v, lambda x: x / n) AS u FROM v)"
_P = _V + ", p AS (SELECT a.vec_id // 2 AS pair, a.v AS a, b.v AS b, a.n AS na, b.n AS nb, least(a.label, b.label) AS label, list_dot_product(a.v, b.v) AS ab FROM v a JOIN v b ON a.vec_id + 1 = b.vec_id AND a.vec_id % 2 = 0)"
_KL = "16 * list_sum(list_transform(list_zip({t}, {s}), lambda z: exp(z[1] / 4) / {zt} * ((z[1] / 4 - ln({zt})) - (z[2] / 4 - ln({zs})))))"
_Z = "list_sum(list_transform({x}, lambda e: exp(e / 4)))"
ORACLES = {
    "channels": "SELECT CAST(label % 3 AS VARCHAR) AS level, max((label % 3 + 1) * 16)::INT AS channels FROM embeddings GROUP BY 1",
    "linear_probe": "SELECT CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS cls, count(*) AS n, count(*) AS n_right FROM embeddings GROUP BY 1",
    "matching_weights": """WITH k AS (SELECT 'model.' || label || '.w' || vec_id AS key, label, vec_id FROM embeddings),
        p AS (SELECT 'all' AS part, key FROM k WHERE vec_id % 5 > 0 UNION ALL SELECT 'first', key FROM k WHERE vec_id % 5 > 0 AND label < 4 UNION ALL SELECT 'frozen', key FROM k WHERE label < 4 UNION ALL SELECT 'free', key FROM k WHERE label >= 4 UNION ALL SELECT 'free', 'head.w')
        SELECT part, count(*) AS n, min(key) AS least FROM p GROUP BY 1""",
    "ntxent_loss": f"""WITH {_B}, s AS (SELECT x.batch, x.vec_id, x.pos = y.pos AS same, list_dot_product(x.u, y.u) / 0.2 AS l FROM u x JOIN u y ON x.batch = y.batch AND x.vec_id <> y.vec_id),
        r AS (SELECT batch, vec_id, ln(sum(exp(l))) - max(CASE WHEN same THEN l END) AS loss FROM s GROUP BY 1, 2), k AS (SELECT batch, count(DISTINCT pos) AS n FROM u GROUP BY 1)
        SELECT batch, n, round(CASE WHEN n < 2 THEN 0 ELSE avg(loss) END, 6) AS loss FROM k LEFT JOIN r USING (batch) GROUP BY 1, 2""",
    "ntxent_one_view": """WITH u AS (SELECT vec_id // 12 AS batch, vec_id, w, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings, (SELECT unnest([0, 1]) AS w)),
        s AS (SELECT x.batch, x.vec_id, x.w, x.vec_id = y.vec_id AS same, list_cosine_similarity(x.v, y.v) / 0.5::DOUBLE AS l FROM u x JOIN u y ON x.batch = y.batch AND (x.vec_id <> y.vec_id OR x.w <> y.w)),
        r AS (SELECT batch, vec_id, w, ln(sum(exp(l))) - max(CASE WHEN same THEN l END) AS loss FROM s GROUP BY 1, 2, 3), n AS (SELECT batch, count(DISTINCT vec_id) AS n FROM u GROUP BY 1)
        SELECT batch, n, round(CASE WHEN n < 2 THEN 0 ELSE avg(loss) END, 6) AS loss FROM n LEFT JOIN r USING (batch) GROUP BY 1, 2""",
    "infonce_moco": f"""WITH {_B}, s AS (SELECT x.batch, x.pos AS i, y.pos AS j, list_dot_product(x.u, y.u) / 0.2 AS l FROM u x JOIN u y ON x.batch = y.batch AND x.view = 0 AND y.view = 1),
        r AS (SELECT batch, i, ln(sum(exp(l))) - max(CASE WHEN i = j THEN l END) AS loss, arg_max(j, l) = i AS hit FROM s GROUP BY 1, 2) SELECT batch, round(avg(loss) * 0.4, 6) AS loss, round(avg(hit::INT), 6) AS top1 FROM r GROUP BY 1""",
    "vicreg_statistics": f"""WITH {_V}, e AS (SELECT vec_id, unnest(range(64)) AS d, unnest(v) AS x FROM v), s AS (SELECT d, var_samp(x) AS var, count(*) AS n FROM e GROUP BY 1),
        c AS (SELECT a.d, b.d AS d2, covar_samp(a.x, b.x) AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.d <> b.d GROUP BY 1, 2)
        SELECT max(n) AS n, round(avg(greatest(0, 1 - sqrt(var + 1e-4))), 9) AS variance, round((SELECT sum(cov * cov) / 64 FROM c), 9) AS covariance, round(var_samp(var) / (avg(var) ** 2 + 1e-4), 9) AS isotropy FROM s""",
    "cosine_disagreement": f"WITH {_P} SELECT pair, round(1 - ab / (na * nb), 6) AS d, round(least(exp(2.5 * (1 - ab / (na * nb))), 10), 6) AS w FROM p",
    "cwd_kl": f"WITH {_P} SELECT pair, round(1000 * {_KL.format(t='b', s='a', zt=_Z.format(x='b'), zs=_Z.format(x='a'))}, 6) AS kl FROM p",
    "consensus_loss": f"""WITH {_P}, q AS (SELECT label, a, b, list_transform(a, lambda x: x * 0.5::DOUBLE) AS s FROM p), z AS (SELECT *, {_Z.format(x='a')} AS za, {_Z.format(x='b')} AS zb, {_Z.format(x='s')} AS zs FROM q),
        r AS (SELECT label, list_sum(list_transform(list_zip(s, a, b), lambda z: (z[1] - (z[2] * 0.3::DOUBLE + z[3] * 0.7::DOUBLE)) ** 2)) / 64 AS fb, {_KL.format(t='a', s='s', zt='za', zs='zs')} + {_KL.format(t='b', s='s', zt='zb', zs='zs')} AS fc FROM z)
        SELECT label, round(avg(fb), 8) AS form_b, round(avg(fc), 6) AS form_c, round(avg(fb) + avg(fc), 6) AS loss FROM r GROUP BY 1""",
    "consensus_gate": f"""WITH {_P}, q AS (SELECT *, list_transform(a, lambda x: x * 2 + 0.1::DOUBLE) AS s FROM p), c AS (SELECT *, ab / (na * nb) AS g, list_cosine_similarity(s, a) AS ca, list_cosine_similarity(s, b) AS cb FROM q),
        w AS (SELECT *, exp(ca * g) / (exp(ca * g) + exp(cb * g)) AS g0 FROM c) SELECT pair, round(g0, 6) AS g0, round(g0 * a[4] + (1 - g0) * b[4], 6) AS fused FROM w""",
    "film_transform": f"WITH {_P} SELECT pair, round(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] * (1 + z[2] * 0.5::DOUBLE) - z[2] - z[2]) ** 2)) / 64, 8) AS error, round(1.25::DOUBLE * nb * nb / 64, 8) AS distance FROM p",
    "candidate_infonce": f"""WITH {_P}, c AS (SELECT pair, b, c, list_transform(list_zip(a, b), lambda z: z[1] * c + z[2] * 0.25::DOUBLE) AS m FROM p, (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS c)), l AS (SELECT pair, c, list_cosine_similarity(m, b) / 0.07::DOUBLE AS l FROM c)
        SELECT pair, round(ln(sum(exp(l))) - max(CASE WHEN c = 1 THEN l END), 5) AS loss FROM l GROUP BY 1""",
    "level_weighted_loss": f"WITH {_P}, l AS (SELECT label % 3 AS level, avg(1 - ab / (na * nb)) AS loss FROM p GROUP BY 1) SELECT round(sum(loss * CASE level WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 0 END) / 4, 6) AS loss FROM l",
    "pooled_features": f"WITH {_V}, e AS (SELECT label, unnest(range(64)) AS d, unnest(v) AS x FROM v), m AS (SELECT label, d, avg(x) AS m FROM e GROUP BY 1, 2) SELECT label, round(sqrt(sum(m * m)), 6) AS length, round(max(CASE WHEN d = 5 THEN m END), 6) AS x5 FROM m GROUP BY 1",
}
