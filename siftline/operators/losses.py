"""Masks, reconstruction errors and losses over candidate scale ratios.

Draws are uniforms hashed from a seed and a row's keys, so they do not depend on partitions and
any engine can repeat them. A loss is one aggregation over rows that Catalyst makes by equi-joins on
an image, a patch or a pair; candidate ratios are a short list of a configuration and are exploded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.scalars import dot, l2_normalise, let, uniform
from siftline.functions.tables import table
from siftline.operators.matching import mutual_nearest
from siftline.operators.vectors import _pairs, film, infonce, ntxent, squared_error

SAME_RATIO = 1e-6

#: Names under which the contrastive losses are known.
CONTRASTIVE = {"ntxent": ntxent, "simclr": ntxent, "infonce": ntxent}


def contrastive(name: str) -> Callable[..., DataFrame]:
    """The contrastive loss of a name, in any case of letters."""
    if name.lower() not in CONTRASTIVE:
        raise ValueError(f"no contrastive loss {name}; there are {sorted(CONTRASTIVE)}")
    return CONTRASTIVE[name.lower()]


def bernoulli_mask(df: DataFrame, hidden_share: float, seed: int, *keys: str) -> DataFrame:
    """Adds ``kept``: each row by itself, hidden with the given probability."""
    return df.withColumn("kept", uniform(seed, *map(F.col, keys)) > hidden_share)


def hardest_mask(df: DataFrame, image: str, pos: str, error: str, hidden_share: float, temperature: float, seed: int) -> DataFrame:
    """Adds ``kept``: floor(share * n) positions of an image are hidden, drawn without replacement by softmax(error / temperature).

    Exponential races: the smallest -ln(u) / weight win, which is drawing one after the other. The
    softmax's sum is common to an image and drops out of the order.
    """
    race = -F.log(uniform(seed, F.col(image), F.col(pos))) / F.exp(F.col(error) / temperature)
    own = Window.partitionBy(image)
    ranked = df.withColumn("__r", F.row_number().over(own.orderBy(race, pos))).withColumn("__n", F.count(F.lit(1)).over(own))
    return ranked.withColumn("kept", F.col("__r") > F.floor(F.col("__n") * F.lit(float(hidden_share)))).drop("__r", "__n")


def patch_mask(images: DataFrame, image: str, height: int, width: int, side: int, share: float, seed: int) -> DataFrame:
    """(image, py, px): the floor(share * n) square patches of each image that are blanked, by smallest hash."""
    down, across = height // side, width // side
    patches = images.select(image, F.explode(F.sequence(F.lit(0), F.lit(down * across - 1))).alias("__p"))
    order = Window.partitionBy(image).orderBy(uniform(seed, F.col(image), F.col("__p")), "__p")
    hidden = patches.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= int(share * down * across))
    return hidden.select(image, F.expr(f"__p div {across}").cast("int").alias("py"), (F.col("__p") % across).alias("px"))


def reconstruction_error(df: DataFrame, image: str, made: Column, target: Column, eps: float = 1e-6) -> DataFrame:
    """Adds ``error``: root mean square over channels at a position, stretched to 0..1 in each image."""
    own = Window.partitionBy(image)
    d = df.withColumn("__d", F.sqrt(squared_error(made, target)))
    low, high = F.min("__d").over(own), F.max("__d").over(own)
    return d.withColumn("error", (F.col("__d") - low) / (high - low + eps)).drop("__d")


def candidate_ratios(real: Column, others: list[float]) -> Column:
    """The real ratio first, then the others that differ from it by more than SAME_RATIO."""
    return F.concat(F.array(real), F.filter(F.array(*(F.lit(float(x)) for x in others)), lambda x: F.abs(x - real) > SAME_RATIO))


def scale_mlp(ratio: Column, first: Column, bias: Column, second: Column, last: Column) -> Column:
    """Ratio -> hidden units with ReLU -> the numbers of ``second``'s rows: the small net that makes gamma and beta.

    ``first`` and ``bias`` have a number a unit, ``second`` a row of units an output, ``last`` a bias an output.
    """
    hidden = F.zip_with(first, bias, lambda w, b: F.greatest(F.lit(0.0), w * ratio + b))
    return let(hidden, lambda h: F.zip_with(second, last, lambda row, b: dot(row, h) + b))


def scale_transform(vec: Column, ratio: Column, weights: tuple[Column, Column, Column, Column], dims: int) -> Column:
    """(1 + gamma(ratio)) * vec + beta(ratio)."""
    return let(scale_mlp(ratio, *weights), lambda gb: film(vec, F.slice(gb, 1, dims), F.slice(gb, dims + 1, dims)))


def controlled_loss(views: DataFrame, first: Column, second: Column, ratio: Column, transform: Callable[[Column, Column], Column]) -> DataFrame:
    """Mean squared error between the first view's features carried over the ratio and the second's."""
    return views.agg(F.avg(squared_error(transform(first, ratio), second)).alias("loss"), F.count(F.lit(1)).alias("n"))


def _logit(made: Column, target: Column, temperature: float, similarity: str) -> Column:
    if similarity == "cosine":
        return dot(l2_normalise(made, 1e-8), l2_normalise(target, 1e-8)) / temperature
    return -squared_error(made, target) / temperature


def natural_loss(pairs: DataFrame, a: str, b: str, ratio: str, ratios: list[float], transform: Callable[[Column, Column], Column], temperature: float = 0.2, similarity: str = "cosine") -> DataFrame:
    """loss, n_pairs, mse of matched pairs: cross-entropy over candidate ratios both ways, half each.

    The right candidate is the one nearest to the pair's own ratio, the first on ties. Fewer than two
    pairs are held by squared error instead; none give zeros. ``pairs`` needs a row a pair.
    """
    if not ratios or temperature <= 0 or similarity not in ("cosine", "mse"):
        raise ValueError("ratios, a positive temperature and cosine or mse are needed")
    options = F.transform(F.array(*(F.lit(float(x)) for x in ratios)), lambda x, k: F.struct(F.abs(x - F.col(ratio)).alias("gap"), k.alias("k")))
    d = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(ratio).alias("r"), F.array_min(options)["k"].alias("right"))
    d = d.withColumn("id", F.monotonically_increasing_id()).select("*", F.posexplode(F.array(*(F.lit(float(x)) for x in ratios))).alias("k", "c"))
    ahead, back = transform(F.col("a"), F.col("c")), transform(F.col("b"), -F.col("c"))
    d = d.select("id", "right", "k", _logit(ahead, F.col("b"), temperature, similarity).alias("f"), _logit(back, F.col("a"), temperature, similarity).alias("g"), squared_error(ahead, F.col("b")).alias("e"),
                 ((squared_error(transform(F.col("a"), F.col("r")), F.col("b")) + squared_error(transform(F.col("b"), -F.col("r")), F.col("a"))) / 2).alias("plain"))
    top, hit = 1.0 / temperature if similarity == "cosine" else 0.0, F.col("k") == F.col("right")

    def entropy(c):
        return F.log(F.sum(F.exp(F.col(c) - top))) + top - F.max(F.when(hit, F.col(c)))

    each = d.groupBy("id").agg(((entropy("f") + entropy("g")) / 2).alias("l"), F.max(F.when(hit, F.col("e"))).alias("e"), F.max("plain").alias("plain"))
    total = each.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("l").alias("l"), F.avg("e").alias("e"), F.avg("plain").alias("p"))
    few = F.col("n_pairs") < 2
    return total.select(F.coalesce(F.when(few, F.col("p")).otherwise(F.col("l")), F.lit(0.0)).alias("loss"), "n_pairs", F.coalesce(F.when(few, F.col("p")).otherwise(F.col("e")), F.lit(0.0)).alias("mse"))


# Queries: neighbouring vectors are two views; 64 numbers are 16 positions of 4 channels.


def _r(c, n=6):
    return F.round(c + F.lit(1e-10), n)


def _positions(spark, sf_dir):
    """pair, pos, a, b: four channels of each of 16 positions."""
    at = lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get(F.col(c), k * 16 + F.col("pos")))
    p = _pairs(spark, sf_dir).select("pair", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pos"))
    return p.select("pair", "pos", at("a").alias("a"), at("b").alias("b"))


def _weights(dims: int, hidden: int = 32):
    """Weights by a rule, so that SQL can make them too."""
    unit = F.sequence(F.lit(0), F.lit(hidden - 1))
    first, bias = F.transform(unit, lambda i: (i % 7 - 3) / F.lit(10.0)), F.transform(unit, lambda i: (i % 5 - 2) / F.lit(20.0))
    out = F.sequence(F.lit(0), F.lit(2 * dims - 1))
    second = F.transform(out, lambda d: F.transform(unit, lambda i: ((d * 31 + i * 17) % 11 - 5) / F.lit(100.0)))
    return first, bias, second, F.transform(out, lambda d: F.lit(0.0))


def q_uniform_mask(spark, sf_dir):
    m = bernoulli_mask(_positions(spark, sf_dir), 0.65, 5, "pair", "pos")
    return m.groupBy("pair").agg(F.sum(F.col("kept").cast("long")).alias("n_kept"), F.sum(F.when(F.col("kept"), F.col("pos")).otherwise(0)).alias("places"))


def q_reconstruction_error(spark, sf_dir):
    e = reconstruction_error(_positions(spark, sf_dir), "pair", F.col("a"), F.col("b"))
    return e.select("pair", "pos", _r(F.col("error")).alias("error"))


def q_hardest_mask(spark, sf_dir):
    e = reconstruction_error(_positions(spark, sf_dir), "pair", F.col("a"), F.col("b"))
    return hardest_mask(e, "pair", "pos", "error", 0.4, 0.5, 9).select("pair", "pos", "kept")


def q_patch_mask(spark, sf_dir):
    return patch_mask(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img")), "img", 64, 96, 16, 0.3, 3)


def q_scale_transform(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("r", F.log((F.col("label") + 1) / F.lit(4.0)))
    t = scale_transform(F.col("a"), F.col("r"), _weights(64), 64)
    return p.select("pair", _r(squared_error(t, F.col("b"))).alias("error"), _r(t[9]).alias("x9"))


def q_controlled_loss(spark, sf_dir):
    w = _weights(64)
    p = _pairs(spark, sf_dir)
    return controlled_loss(p, F.col("a"), F.col("b"), F.lit(0.5), lambda v, r: scale_transform(v, r, w, 64)).select(_r(F.col("loss")).alias("loss"), "n")


def q_candidate_list(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("real", (F.col("label") - 4) / F.lit(2.0))
    c = candidate_ratios(F.col("real"), [-1.0, -0.5, 0.0, 0.5, 1.0])
    return p.select("pair", F.size(c).alias("n"), c[0].alias("first"), _r(F.aggregate(c, F.lit(0.0), lambda s, x: s + x)).alias("total"))


def _matched(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("g"), F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    pairs = mutual_nearest(e, "g", "id", "label", "vec", 0.2)
    left, right = (e.select(F.col("id").alias(k), F.col("vec").alias(v)) for k, v in (("i", "a"), ("j", "b")))
    return pairs.join(left, "i").join(right, "j").withColumn("r", F.col("log_r") / F.lit(4.0))


RATIOS = [-1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5]


def q_natural_candidate_loss(spark, sf_dir):
    move = lambda v, r: F.transform(v, lambda x: x * (1 + r))
    out = natural_loss(_matched(spark, sf_dir), "a", "b", "r", RATIOS, lambda v, r: F.zip_with(move(v, r), v, lambda x, y: x + r * r * F.abs(y)))
    return out.select(_r(F.col("loss"), 5).alias("loss"), "n_pairs", _r(F.col("mse")).alias("mse"))


def q_natural_squared_loss(spark, sf_dir):
    out = natural_loss(_matched(spark, sf_dir), "a", "b", "r", RATIOS, lambda v, r: F.transform(v, lambda x: x * (1 + r)), 0.5, "mse")
    return out.select(_r(F.col("loss"), 5).alias("loss"), "n_pairs", _r(F.col("mse")).alias("mse"))


def q_contrastive_by_name(spark, sf_dir):
    views = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("batch"), (F.floor(F.col("vec_id") / 2) % 8).alias("pos"), (F.col("vec_id") % 2).alias("view"), "embedding")
    return contrastive("SimCLR")(views, "batch", "pos", "view", "embedding", 0.5).select("batch", _r(F.col("loss")).alias("loss"))


QUERIES = {f.__name__[2:]: f for f in (q_uniform_mask, q_reconstruction_error, q_hardest_mask, q_patch_mask, q_scale_transform, q_controlled_loss, q_candidate_list, q_natural_candidate_loss, q_natural_squared_loss, q_contrastive_by_name)}


def u_sql(seed: int, *parts: str) -> str:
    """The uniform of ``scalars.uniform`` in SQL."""
    text = " || ':' || ".join((f"'{seed}'", *(f"CAST({p} AS VARCHAR)" for p in parts)))
    return f"((('0x' || substr(sha256({text}), 1, 13))::UBIGINT::DOUBLE + 1) / 4503599627370496.0::DOUBLE)"


_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.vec_id // 2 AS pair, a.v AS a, b.v AS b, least(a.label, b.label) AS label FROM v a JOIN v b ON a.vec_id + 1 = b.vec_id AND a.vec_id % 2 = 0)"
_POS = _V + ", q AS (SELECT pair, pos::INT AS pos, sqrt(list_sum(list_transform(range(4), lambda k: (a[k * 16 + pos + 1] - b[k * 16 + pos + 1]) ** 2)) / 4) AS d FROM p, (SELECT unnest(range(16)) AS pos))"
_ERR = _POS + ", e AS (SELECT pair, pos, (d - min(d) OVER (PARTITION BY pair)) / (max(d) OVER (PARTITION BY pair) - min(d) OVER (PARTITION BY pair) + 1e-6) AS error FROM q)"
_HIDDEN = "list_transform(range(32), lambda i: greatest(0, (i % 7 - 3) / 10.0::DOUBLE * {r} + (i % 5 - 2) / 20.0::DOUBLE))"
_OUT = "list_transform(range({a}, {b}), lambda d: list_sum(list_transform(range(32), lambda i: h[i + 1] * (((d * 31 + i * 17) % 11 - 5) / 100.0::DOUBLE))))"
_T = "t AS (SELECT *, list_transform(range(64), lambda d: a[d + 1] * (1 + gamma[d + 1]) + beta[d + 1]) AS t FROM (SELECT *, " + _OUT.format(a=0, b=64) + " AS gamma, " + _OUT.format(a=64, b=128) + " AS beta FROM h))"
_SQ = "list_sum(list_transform(list_zip({x}, {y}), lambda z: (z[1] - z[2]) ** 2)) / 64"
_MATCHED = """g AS (SELECT vec_id // 8 AS g, vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
    s AS (SELECT a.g, a.id AS i, b.id AS j, a.label AS si, b.label AS sj, list_cosine_similarity(a.vec, b.vec) AS sim, a.vec AS a, b.vec AS b FROM g a JOIN g b ON a.g = b.g AND a.label <> b.label),
    best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY g, i ORDER BY sim DESC, j) = 1),
    m AS (SELECT x.i, x.j, x.a, x.b, (x.sj - x.si) / 4.0::DOUBLE AS r FROM best x JOIN best y ON x.i = y.j AND x.j = y.i WHERE x.i < x.j AND x.sim >= 0.2),
    c AS (SELECT unnest([-1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5])::DOUBLE AS c, unnest(range(7)) AS k)"""


def _natural_sql(move: str, logit: str) -> str:
    """``move``: x carried over the ratio c; ``logit``: of the lists x and y."""
    def moved(v, c):
        return f"list_transform({v}, lambda x: {move.format(c=c)})"

    return f"""WITH {_MATCHED}, k AS (SELECT m.*, c.c, c.k, {moved('a', 'c')} AS ta, {moved('b', '(-c)')} AS tb FROM m, c),
        l AS (SELECT i, abs(c - r) AS gap, k, {logit.format(x='ta', y='b')} AS f, {logit.format(x='tb', y='a')} AS g, {_SQ.format(x='ta', y='b')} AS e FROM k),
        n AS (SELECT i, arg_min(struct_pack(f := f, g := g, e := e), gap * 1000 + k * 1e-9) AS hit, ln(sum(exp(f))) AS lf, ln(sum(exp(g))) AS lg FROM l GROUP BY 1)
        SELECT round(coalesce(avg((lf - hit.f + lg - hit.g) / 2), 0) + 1e-10, 5) AS loss, count(*) AS n_pairs, round(coalesce(avg(hit.e), 0) + 1e-10, 6) AS mse FROM n"""


ORACLES = {
    "uniform_mask": f"WITH {_POS} SELECT pair, sum(({u_sql(5, 'pair', 'pos')} > 0.65)::INT)::BIGINT AS n_kept, sum(CASE WHEN {u_sql(5, 'pair', 'pos')} > 0.65 THEN pos ELSE 0 END)::BIGINT AS places FROM q GROUP BY 1",
    "reconstruction_error": f"WITH {_ERR} SELECT pair, pos, round(error + 1e-10, 6) AS error FROM e",
    "hardest_mask": f"WITH {_ERR} SELECT pair, pos, row_number() OVER (PARTITION BY pair ORDER BY -ln({u_sql(9, 'pair', 'pos')}) / exp(error / 0.5), pos) > 6 AS kept FROM e",
    "patch_mask": f"SELECT vec_id AS img, (p // 6)::INT AS py, (p % 6)::INT AS px FROM embeddings, (SELECT unnest(range(24)) AS p) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {u_sql(3, 'vec_id', 'p')}, p) <= 7",
    "scale_transform": f"WITH {_V}, h AS (SELECT *, {_HIDDEN.format(r='ln((label + 1) / 4.0::DOUBLE)')} AS h FROM p), {_T} SELECT pair, round({_SQ.format(x='t', y='b')} + 1e-10, 6) AS error, round(t[10] + 1e-10, 6) AS x9 FROM t",
    "controlled_loss": f"WITH {_V}, h AS (SELECT *, {_HIDDEN.format(r='0.5')} AS h FROM p), {_T} SELECT round(avg({_SQ.format(x='t', y='b')}) + 1e-10, 6) AS loss, count(*) AS n FROM t",
    "candidate_list": f"WITH {_V}, c AS (SELECT pair, (label - 4) / 2.0::DOUBLE AS real, list_filter([-1.0, -0.5, 0.0, 0.5, 1.0]::DOUBLE[], lambda x: abs(x - (label - 4) / 2.0::DOUBLE) > 1e-6) AS o FROM p) SELECT pair, (1 + len(o))::INT AS n, real AS first, round(real + coalesce(list_sum(o), 0) + 1e-10, 6) AS total FROM c",
    "natural_candidate_loss": _natural_sql("x * (1 + {c}) + {c} * {c} * abs(x)", "list_cosine_similarity({x}, {y}) / 0.2::DOUBLE"),
    "natural_squared_loss": _natural_sql("x * (1 + {c})", "(-" + _SQ + ") / 0.5::DOUBLE"),
    "contrastive_by_name": """WITH u AS (SELECT vec_id // 16 AS batch, vec_id // 2 % 8 AS pos, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
        s AS (SELECT x.batch, x.vec_id, x.pos = y.pos AS same, list_cosine_similarity(x.v, y.v) / 0.5::DOUBLE AS l FROM u x JOIN u y ON x.batch = y.batch AND x.vec_id <> y.vec_id),
        r AS (SELECT batch, vec_id, ln(sum(exp(l))) - max(CASE WHEN same THEN l END) AS loss FROM s GROUP BY 1, 2) SELECT u.batch, round(CASE WHEN count(DISTINCT u.pos) < 2 THEN 0 ELSE (SELECT avg(loss) FROM r WHERE r.batch = u.batch) END + 1e-10, 6) AS loss FROM u GROUP BY 1""",
}
