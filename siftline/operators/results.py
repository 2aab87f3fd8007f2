"""Results: cross-validation aggregates, leaderboards, early stopping, rank metrics, classifier losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.scalars import let
from siftline.functions.tables import table
from siftline.operators.grid import _results


def cv_rows(results: DataFrame, metric: str = "value", fallback: str | None = None, order: str = "event_id") -> DataFrame:
    """Rows with status ok, one for each (method, fraction, dataset), the last by ``order``.

    A blank metric takes the fallback column's value, a blank fraction is 1; fractions are kept to 4 places.
    """
    value = F.col(metric).try_cast("double")
    if fallback:
        value = F.coalesce(value, F.col(fallback).try_cast("double"))
    ok = results.where("status = 'ok'").select("method", "dataset", F.bround(F.coalesce(F.col("fraction").cast("double"), F.lit(1.0)), 4).alias("fraction"), value.alias("v"), F.col(order).alias("o")).where("v is not null")
    return ok.groupBy("method", "fraction", "dataset").agg(F.max_by("v", "o").alias("v"))


def cv_aggregate(results: DataFrame, **how) -> DataFrame:
    """By method and fraction: n_folds, mean, std (0 for one fold), least, most, n_failed."""
    rows = cv_rows(results, **how)
    out = rows.groupBy("method", "fraction").agg(
        F.count(F.lit(1)).alias("n_folds"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 4).alias("std"),
        F.round(F.min("v"), 4).alias("least"), F.round(F.max("v"), 4).alias("most"))
    failed = results.where("status = 'failed'").groupBy("method", F.bround(F.coalesce(F.col("fraction").cast("double"), F.lit(1.0)), 4).alias("fraction")).agg(F.count(F.lit(1)).alias("n_failed"))
    return out.join(failed, ["method", "fraction"], "left").withColumn("n_failed", F.coalesce("n_failed", F.lit(0)))


def missing_folds(results: DataFrame, **how) -> DataFrame:
    """By method and fraction the datasets that others have and it lacks: a set difference of small name lists."""
    rows = cv_rows(results, **how)
    every = rows.select("dataset").distinct().agg(F.array_sort(F.collect_set("dataset")).alias("all_"))
    have = rows.groupBy("method", "fraction").agg(F.collect_set("dataset").alias("have"))
    return have.join(F.broadcast(every)).select("method", "fraction", F.array_join(F.array_except("all_", "have"), ",").alias("missing"))


def leaderboard(results: DataFrame, **how) -> DataFrame:
    """place, method and mean at the largest fraction; no mean counts as -1."""
    a = cv_aggregate(results, **how)
    top = a.agg(F.max("fraction").alias("top"))
    by = a.join(F.broadcast(top)).groupBy("method").agg(F.coalesce(F.max(F.when(F.col("fraction") == F.col("top"), F.col("mean"))), F.lit(-1.0)).alias("mean"))
    return by.select(F.row_number().over(Window.orderBy(F.col("mean").desc(), "method")).alias("place"), "method", "mean")


def epoch_means(steps: DataFrame, run: str, epoch: str, step: str, value: str) -> DataFrame:
    """Mean over levels in each step, then over the steps of an epoch; null levels don't count."""
    by_step = steps.groupBy(run, epoch, step).agg(F.avg(value).alias("__v"))
    return by_step.groupBy(run, epoch).agg(F.avg("__v").alias("mean"))


def best_epoch(epochs: DataFrame, run: str, epoch: str, loss: str) -> DataFrame:
    """The epoch of least loss, the earliest on ties; epochs without a loss do not count."""
    return epochs.where(F.col(loss).isNotNull()).groupBy(run).agg(F.min(F.struct(F.col(loss).alias("loss"), F.col(epoch).alias("epoch"))).alias("b")).select(run, "b.epoch", "b.loss")


def early_stopping(epochs: DataFrame, run: str, epoch: str, metric: str, patience: int) -> DataFrame:
    """run, stop (the epoch after which training ends, or its last), best_epoch, best.

    An epoch improves if it lies strictly above all earlier ones; training stops when ``patience``
    epochs have passed since.
    """
    w = Window.partitionBy(run).orderBy(epoch)
    before = F.coalesce(F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1.0))
    d = epochs.withColumn("__up", F.col(metric) > before)
    d = d.withColumn("__last", F.coalesce(F.max(F.when(F.col("__up"), F.col(epoch))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.min(epoch).over(w) - 1))
    stop = F.coalesce(F.min(F.when(F.col(epoch) - F.col("__last") >= patience, F.col(epoch))), F.max(epoch)).alias("stop")
    stops = d.groupBy(run).agg(stop)
    lived = d.join(stops, run).where((F.col(epoch) <= F.col("stop")) & F.col("__up"))
    best = lived.groupBy(run).agg(F.max(epoch).alias("best_epoch"), F.max(metric).alias("best"))
    return stops.join(best, run, "left")


def average_precision(scores: DataFrame, cls: str, item: str, score: str, target: str) -> DataFrame:
    """Rank-based AP by class: mean of precision at each positive; classes without one are null."""
    w = Window.partitionBy(cls).orderBy(F.col(score).desc(), item)
    hits = F.sum(target).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = scores.select(cls, target, (hits / F.row_number().over(w)).alias("__p"))
    return d.groupBy(cls).agg(F.sum(target).alias("n_pos"), F.try_divide(F.sum(F.col("__p") * F.col(target)), F.sum(target)).alias("ap"))


def mean_average_precision(scores: DataFrame, *cols: str) -> DataFrame:
    """Mean AP over classes with a positive, 0 if there is none."""
    return average_precision(scores, *cols).agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map"), F.count("ap").alias("n_classes"))


def log_sum_exp(x: Column) -> Column:
    """Of an array, shifted by its largest value."""
    return let(F.array_max(x), lambda m: m + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - m))))


def smoothed_cross_entropy(logits: Column, label: Column, smoothing: float = 0.15) -> Column:
    """Cross-entropy against a label that keeps 1 - smoothing and spreads the rest evenly over all classes."""
    lse = log_sum_exp(logits)
    mean = F.aggregate(logits, F.lit(0.0), lambda s, v: s + v) / F.size(logits)
    return -(1 - smoothing) * (F.element_at(logits, label + 1) - lse) - smoothing * (mean - lse)


def task_metrics(df: DataFrame, logits: str, label: str, by: str, smoothing: float = 0.15) -> DataFrame:
    """Mean loss and accuracy by task."""
    x = F.transform(logits, lambda v: v.cast("double"))
    right = F.array_position(x, F.array_max(x)) - 1 == F.col(label)
    return df.groupBy(by).agg(F.avg(smoothed_cross_entropy(x, F.col(label).cast("int"), smoothing)).alias("loss"), F.avg(right.cast("double")).alias("accuracy"))


def composite(tasks: DataFrame, weights: dict[str, float], by: str) -> DataFrame:
    """Weighted sum of task losses and mean accuracy."""
    w = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))
    return tasks.agg(F.sum(F.coalesce(w[F.col(by)], F.lit(1.0)) * F.col("loss")).alias("loss"), F.avg("accuracy").alias("accuracy"))


def merge_alphas(df: DataFrame, value: str, strategy: str) -> DataFrame:
    """Adds alpha: equal parts, parts by weight, or parts by one over the loss."""
    every = Window.partitionBy(F.lit(0))
    x = {"equal": F.lit(1.0), "weighted": F.col(value).cast("double"), "task_loss": 1 / F.greatest(F.col(value).cast("double"), F.lit(1e-6))}[strategy]
    return df.withColumn("alpha", x / F.sum(x).over(every))


def _epochs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 9).alias("run"), (F.col("event_id") % 40).alias("epoch"), F.floor(F.col("event_id") / 200).alias("step"), F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("value"))


def _scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.col("n_chars").cast("double").alias("score"), F.explode(F.array(F.struct(F.lit("quality").alias("cls"), F.col("quality").alias("y")), F.struct(F.lit("toxic").alias("cls"), F.col("toxic").alias("y")), F.struct(F.lit("none").alias("cls"), F.lit(0).alias("y")))).alias("x")).select("doc_id", "score", "x.cls", "x.y")


def q_cv_aggregate(spark, sf_dir):
    return cv_aggregate(_results(spark, sf_dir))


def q_cv_missing_folds(spark, sf_dir):
    return missing_folds(_results(spark, sf_dir).where("NOT (method = 'a' AND dataset = 'click')"))


def q_cv_leaderboard(spark, sf_dir):
    return leaderboard(_results(spark, sf_dir))


def q_epoch_means(spark, sf_dir):
    return epoch_means(_epochs(spark, sf_dir), "run", "epoch", "step", "value").select("run", "epoch", F.round(F.col("mean") + 1e-9, 6).alias("mean"))


def q_best_epoch(spark, sf_dir):
    m = epoch_means(_epochs(spark, sf_dir), "run", "epoch", "step", "value").select("run", "epoch", F.round("mean", 1).alias("mean"))
    return best_epoch(m, "run", "epoch", "mean")


def q_early_stopping(spark, sf_dir):
    m = epoch_means(_epochs(spark, sf_dir), "run", "epoch", "step", "value").select("run", "epoch", F.round(F.col("mean") + 1e-9, 6).alias("mean"))
    return early_stopping(m, "run", "epoch", "mean", 5)


def q_average_precision_per_class(spark, sf_dir):
    return average_precision(_scores(spark, sf_dir), "cls", "doc_id", "score", "y").select("cls", "n_pos", F.round("ap", 6).alias("ap"))


def q_mean_ap(spark, sf_dir):
    return mean_average_precision(_scores(spark, sf_dir), "cls", "doc_id", "score", "y").select(F.round("map", 6).alias("map"), "n_classes")


def q_pretext_metrics(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.slice("embedding", 1, 10).alias("x"), "label", (F.col("vec_id") % 3).cast("string").alias("task"))
    t = task_metrics(v, "x", "label", "task")
    return t.select("task", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


def q_composite_loss(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.slice("embedding", 1, 10).alias("x"), "label", (F.col("vec_id") % 3).cast("string").alias("task"))
    return composite(task_metrics(v, "x", "label", "task"), {"0": 0.5, "1": 2.0}, "task").select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


def q_merge_alphas(spark, sf_dir):
    r = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sum("n_nationkey").alias("loss"))
    parts = [merge_alphas(r, "loss", s).select("n_regionkey", F.lit(s).alias("strategy"), F.round("alpha", 9).alias("alpha")) for s in ("equal", "weighted", "task_loss")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {f.__name__[2:]: f for f in (q_cv_aggregate, q_cv_missing_folds, q_cv_leaderboard, q_epoch_means, q_best_epoch, q_early_stopping, q_average_precision_per_class, q_mean_ap, q_pretext_metrics, q_composite_loss, q_merge_alphas)}
_R = "r AS (SELECT ['a', 'b', 'c'][user_id % 3 + 1] AS method, event_type AS dataset, [0.1, 1.0][event_id % 2 + 1]::DOUBLE AS fraction, value, event_id, event_id % 11 <> 0 AS ok FROM events), k AS (SELECT method, fraction, dataset, arg_max(value, event_id) AS v FROM r WHERE ok GROUP BY ALL)"
_E = "s AS (SELECT user_id % 9 AS run, event_id % 40 AS epoch, event_id // 200 AS step, avg(CASE WHEN event_id % 7 > 0 THEN value END) AS v FROM events GROUP BY ALL), m AS (SELECT run, epoch, avg(v) AS mean FROM s GROUP BY ALL)"
_S = "s AS (SELECT doc_id, n_chars, unnest(['quality', 'toxic', 'none']) AS cls, unnest([quality, toxic, 0]) AS y FROM documents JOIN labels USING (doc_id)), p AS (SELECT cls, y, sum(y) OVER w / row_number() OVER w AS p FROM s WINDOW w AS (PARTITION BY cls ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)), a AS (SELECT cls, sum(y)::BIGINT AS n_pos, CASE WHEN sum(y) > 0 THEN sum(p * y) / sum(y) END AS ap FROM p GROUP BY 1)"
_X = "v AS (SELECT list_transform(embedding[1:10], lambda x: x::DOUBLE) AS x, label, CAST(vec_id % 3 AS VARCHAR) AS task FROM embeddings), l AS (SELECT *, list_max(x) + ln(list_sum(list_transform(x, lambda e: exp(e - list_max(x))))) AS lse FROM v), t AS (SELECT task, avg(-0.85::DOUBLE * (x[label + 1] - lse) - 0.15::DOUBLE * (list_avg(x) - lse)) AS loss, avg((list_position(x, list_max(x)) - 1 = label)::INT) AS accuracy FROM l GROUP BY 1)"
ORACLES = {
    "cv_aggregate": f"WITH {_R}, a AS (SELECT method, fraction, count(*) AS n_folds, round(avg(v), 4) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS std, round(min(v), 4) AS least, round(max(v), 4) AS most FROM k GROUP BY ALL), f AS (SELECT method, fraction, count(*) AS n_failed FROM r WHERE NOT ok GROUP BY ALL) SELECT a.*, coalesce(n_failed, 0) AS n_failed FROM a LEFT JOIN f USING (method, fraction)",
    "cv_missing_folds": f"WITH {_R.replace('FROM events)', 'FROM events WHERE NOT (user_id % 3 = 0 AND event_type = ' + chr(39) + 'click' + chr(39) + '))')} SELECT c.method, c.fraction, coalesce(string_agg(d.dataset, ',' ORDER BY d.dataset) FILTER (k.v IS NULL), '') AS missing FROM (SELECT DISTINCT method, fraction FROM k) c CROSS JOIN (SELECT DISTINCT dataset FROM k) d LEFT JOIN k ON k.method = c.method AND k.fraction = c.fraction AND k.dataset = d.dataset GROUP BY 1, 2",
    "cv_leaderboard": f"WITH {_R}, a AS (SELECT method, round(avg(v), 4) AS mean FROM k WHERE fraction = 1 GROUP BY 1) SELECT row_number() OVER (ORDER BY mean DESC, method)::INT AS place, method, mean FROM a",
    "epoch_means": f"WITH {_E} SELECT run, epoch, round(mean + 1e-9, 6) AS mean FROM m",
    "best_epoch": f"WITH {_E} SELECT run, epoch, round(mean, 1) AS loss FROM m QUALIFY row_number() OVER (PARTITION BY run ORDER BY round(mean, 1), epoch) = 1",
    "early_stopping": f"""WITH {_E}, r AS (SELECT run, epoch, round(mean + 1e-9, 6) AS mean FROM m),
        b AS (SELECT *, mean > coalesce(max(mean) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS up FROM r),
        l AS (SELECT *, max(CASE WHEN up THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last FROM b),
        z AS (SELECT run, coalesce(min(CASE WHEN epoch - last >= 5 THEN epoch END), max(epoch)) AS stop FROM l GROUP BY 1)
        SELECT z.run, stop, max(epoch) AS best_epoch, max(mean) AS best FROM z JOIN l USING (run) WHERE up AND epoch <= stop GROUP BY 1, 2""",
    "average_precision_per_class": f"WITH {_S} SELECT cls, n_pos, round(ap, 6) AS ap FROM a",
    "mean_ap": f"WITH {_S} SELECT round(coalesce(avg(ap), 0), 6) AS map, count(ap) AS n_classes FROM a",
    "pretext_metrics": f"WITH {_X} SELECT task, round(loss, 6) AS loss, round(accuracy, 6) AS accuracy FROM t",
    "composite_loss": f"WITH {_X} SELECT round(sum(CASE task WHEN '0' THEN 0.5 WHEN '1' THEN 2.0 ELSE 1.0 END::DOUBLE * loss), 6) AS loss, round(avg(accuracy), 6) AS accuracy FROM t",
    "merge_alphas": """WITH r AS (SELECT n_regionkey, sum(n_nationkey) AS loss FROM nation GROUP BY 1), x AS (SELECT n_regionkey, unnest(['equal', 'weighted', 'task_loss']) AS strategy, unnest([1.0::DOUBLE, loss::DOUBLE, 1 / greatest(loss::DOUBLE, 1e-6)]) AS x FROM r)
        SELECT n_regionkey, strategy, round(x / sum(x) OVER (PARTITION BY strategy), 9) AS alpha FROM x""",
}
