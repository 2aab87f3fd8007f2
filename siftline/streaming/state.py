"""Stateful operators: last-K buffers, exponential averages, step counters; batch forms and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftline.functions.scalars import seeded_order
from siftline.functions.tables import table
from siftline.plans.storage import fresh_path


def last_k(df: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The last k rows of each key: what a ring buffer holds after them. The limit goes below the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order)))).where(F.col("__r") <= k).drop("__r")


def combine_queues(queues: dict[str, DataFrame], ids: dict[str, int] | None = None) -> DataFrame:
    """Union of per-level buffers with a tag column; levels must agree in their columns, empty ones add nothing."""
    ids = ids or {name: i for i, name in enumerate(queues)}
    out = None
    for name, q in queues.items():
        if out is not None and q.columns != out.columns[:-1]:
            raise ValueError(f"queue {name} has other columns")
        tagged = q.withColumn("tag", F.lit(ids[name]))
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("no queues")
    return out


def ema(df: DataFrame, key: str, order: list[str], value: str, momentum: float) -> DataFrame:
    """key, n, ema: x_1, then m ema + (1 - m) x, as one weighted sum over the rows' places from the end."""
    back = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    fore = Window.partitionBy(key).orderBy(*order)
    d = df.where(F.col(value).isNotNull()).withColumn("__e", F.row_number().over(back) - 1).withColumn("__f", F.row_number().over(fore))
    weight = F.pow(F.lit(float(momentum)), F.col("__e")) * F.when(F.col("__f") == 1, F.lit(1.0)).otherwise(F.lit(1 - momentum))
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(weight * F.col(value)).alias("ema"))


def ema_update(theta: Column, x: Column, momentum: float = 0.999) -> Column:
    """One step over arrays: m theta + (1 - m) x."""
    return F.zip_with(theta, x, lambda a, b: a * momentum + b * (1 - momentum))


def queue_rows(df: DataFrame, batch: str, pos: str, vec: str, dims: int, strategy: str, n: int = 16, seed: int = 0) -> DataFrame:
    """What a batch puts into a buffer: one mean vector, every position, or n positions that all images of the batch share."""
    if strategy == "per_position":
        return df.select(batch, vec)
    if strategy == "pooled":
        means = df.groupBy(batch).agg(*(F.avg(F.get(F.col(vec), F.lit(i)).cast("double")).alias(f"m{i}") for i in range(dims)))
        return means.select(batch, F.array(*(f"m{i}" for i in range(dims))).alias(vec))
    if strategy == "subsample":
        chosen = df.select(batch, pos).distinct()
        chosen = chosen.withColumn("__r", F.row_number().over(Window.partitionBy(batch).orderBy(seeded_order(seed, F.col(batch), F.col(pos))))).where(F.col("__r") <= n)
        return df.join(chosen.drop("__r"), [batch, pos]).select(batch, vec)
    raise ValueError(f"no strategy {strategy}")


def auto_step(df: DataFrame, run: str, order: str, step: str) -> DataFrame:
    """Steps that were not given count on from 0 in each run."""
    return df.withColumn(step, F.coalesce(F.col(step), F.row_number().over(Window.partitionBy(run).orderBy(order)) - 1))


def last_k_stream(df: DataFrame, key: str, order: str, value: str, k: int) -> DataFrame:
    """Stream form of last_k: each trigger sends a key's buffer as (key, n_seen, places, values)."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, places, values = state.get if state.exists else (0, [], [])
        rows = list(zip(places, values, strict=True))
        for pdf in batches:
            seen += len(pdf)
            rows += list(zip(pdf[order].astype("int64"), pdf[value].astype("float64"), strict=True))
            rows = sorted(rows)[-k:]
        places, values = [int(r[0]) for r in rows], [float(r[1]) for r in rows]
        state.update((seen, places, values))
        yield pd.DataFrame({key: [group[0]], "n_seen": [seen], "places": [places], "values": [values]})

    kind = dict(df.dtypes)[key]
    return df.select(key, order, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n_seen long, places array<long>, values array<double>", "n_seen long, places array<long>, values array<double>", "update", GroupStateTimeout.NoTimeout)


def ema_stream(df: DataFrame, key: str, order: str, value: str, momentum: float) -> DataFrame:
    """Stream form of ema; rows of a trigger are taken in order."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, theta = state.get if state.exists else (0, 0.0)
        pdf = pd.concat(list(batches)).dropna(subset=[value]).sort_values(order)
        for x in pdf[value]:
            theta = float(x) if n == 0 else momentum * theta + (1 - momentum) * float(x)
            n += 1
        state.update((n, theta))
        yield pd.DataFrame({key: [group[0]], "n": [n], "ema": [theta]})

    kind = dict(df.dtypes)[key]
    return df.select(key, order, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


def once_per_step(df: DataFrame, *keys: str) -> DataFrame:
    """At most one row for each key, in batch or in a stream with a watermark."""
    return df.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def fan_out(df: DataFrame, sinks: list, checkpoint: str):
    """Write every micro-batch to several sinks; each gets (batch, number)."""

    def send(batch: DataFrame, number: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, number)
        batch.unpersist()

    return df.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, mode: str = "update") -> DataFrame:
    """Run a stream over what is there now, into Parquet in the shared folder, and read it."""
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, "stream"), fresh_path(spark, "stream-checkpoint")
    stream.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parque[t]"  # a pattern, so that a file and a folder are both taken
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(path)


def q_fifo_last_k(spark, sf_dir):
    return last_k(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], 5)


def q_fifo_last_k_stream(spark, sf_dir):
    d = drain(last_k_stream(event_stream(spark, sf_dir), "user_id", "event_id", "value", 5))
    newest = d.groupBy("user_id").agg(F.max_by(F.struct("n_seen", "places"), "batch").alias("x"))
    return newest.select("user_id", "x.n_seen", F.array_join(F.transform("x.places", lambda p: p.cast("string")), ",").alias("places"))


def q_combined_queues(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]
    return combine_queues({t: last_k(e.where(F.col("event_type") == t), "event_type", ["event_id"], 7) for t in kinds})


def q_ema_fold(spark, sf_dir):
    return ema(table(spark, sf_dir, "events"), "user_id", ["event_id"], "value", 0.9).select("user_id", "n", F.round(F.col("ema") + 1e-10, 6).alias("ema"))


def q_ema_fold_stream(spark, sf_dir):
    d = drain(ema_stream(event_stream(spark, sf_dir), "user_id", "event_id", "value", 0.9))
    return d.groupBy("user_id").agg(F.max_by(F.struct("n", "ema"), "batch").alias("x")).select("user_id", "x.n", F.round(F.col("x.ema") + 1e-10, 6).alias("ema"))


def q_once_per_step(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 100).alias("step"), "event_type")
    return once_per_step(e, "step", "event_type")


def q_auto_steps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, F.col("event_id")).alias("step"))
    return auto_step(e, "user_id", "event_id", "step")


def q_queue_feeders(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("batch"), (F.col("vec_id") % 50).alias("pos"), "embedding")
    parts = [queue_rows(v, "batch", "pos", "embedding", 64, s, 16).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)) + 1e-9, 5).alias("x")).select("batch", F.lit(s).alias("strategy"), "n", "x") for s in ("pooled", "per_position", "subsample")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_momentum_update(spark, sf_dir):
    """One step of a momentum encoder over whole weight arrays."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    t = e.withColumn("t", ema_update(F.transform("x", lambda v: v * 2), F.col("x"), 0.99))
    return t.select("vec_id", F.round(F.aggregate(F.transform("t", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v) + 1e-9, 6).alias("total"))


def q_restarted_stream(spark, sf_dir):
    """A stream over two files, stopped after the first and started again from its checkpoint: state and counts go on."""
    folder, out, checkpoint = (fresh_path(spark, x) for x in ("in", "out", "checkpoint"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    for k in range(2):
        e.where(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(folder)
        rows = spark.readStream.schema(e.schema).parquet(folder)
        ema_stream(rows, "user_id", "event_id", "value", 0.9).writeStream.outputMode("update").foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    newest = spark.read.parquet(out).groupBy("user_id").agg(F.max_by(F.struct("n", "ema"), "batch").alias("x"), F.max("batch").alias("last_batch"))
    return newest.select("user_id", "x.n", F.round(F.col("x.ema") + 1e-10, 6).alias("ema"))


def q_fanned_out_stream(spark, sf_dir):
    """One stream to two sinks, both of which get every row once."""
    a, b, checkpoint = (fresh_path(spark, x) for x in ("a", "b", "checkpoint"))
    rows = event_stream(spark, sf_dir).select("event_id", "event_type")
    fan_out(rows, [lambda d, n: d.write.mode("append").parquet(a), lambda d, n: d.groupBy("event_type").count().write.mode("append").parquet(b)], checkpoint).awaitTermination()
    left = spark.read.parquet(a).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_ids"))
    return left.join(spark.read.parquet(b).groupBy("event_type").agg(F.sum("count").alias("n_other")), "event_type")


def q_once_per_step_stream(spark, sf_dir):
    """The step guard on a stream with a watermark."""
    rows = event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 100).alias("step"), "event_type").withWatermark("ts", "1000 days")
    return drain(once_per_step(rows, "step", "event_type"), "append").select("step", "event_type")


QUERIES = {f.__name__[2:]: f for f in (q_momentum_update, q_restarted_stream, q_fanned_out_stream, q_once_per_step_stream, q_fifo_last_k, q_fifo_last_k_stream, q_combined_queues, q_ema_fold, q_ema_fold_stream, q_once_per_step, q_auto_steps, q_queue_feeders)}
_EMA = "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS e FROM events WHERE value IS NOT NULL) SELECT user_id, count(*) AS n, round(sum(0.9::DOUBLE ** e * (CASE WHEN f = 1 THEN 1.0 ELSE 0.1 END)::DOUBLE * value) + 1e-10, 6) AS ema FROM r GROUP BY 1"
ORACLES = {
    "momentum_update": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: (x::DOUBLE * 2 * 0.99::DOUBLE + x::DOUBLE * 0.01::DOUBLE) * i)) + 1e-9, 6) AS total FROM embeddings",
    "restarted_stream": _EMA.replace("ORDER BY event_id)", "ORDER BY event_id % 2, event_id)").replace("ORDER BY event_id DESC)", "ORDER BY event_id % 2 DESC, event_id DESC)"),
    "fanned_out_stream": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids, count(*)::BIGINT AS n_other FROM events GROUP BY 1",
    "once_per_step_stream": "SELECT DISTINCT event_id % 100 AS step, event_type FROM events",
    "fifo_last_k": "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5",
    "fifo_last_k_stream": "WITH k AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5) SELECT user_id, max(n) AS n_seen, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS places FROM k GROUP BY 1",
    "combined_queues": "SELECT event_type, event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS tag FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 7",
    "ema_fold": _EMA,
    "ema_fold_stream": _EMA,
    "once_per_step": "SELECT DISTINCT event_id % 100 AS step, event_type FROM events",
    "auto_steps": "SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN event_id ELSE row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 END AS step FROM events",
    "queue_feeders": """
        WITH v AS (SELECT vec_id // 50 AS batch, vec_id % 50 AS pos, list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)) AS x FROM embeddings),
        s AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY batch ORDER BY sha256('0:' || batch || ':' || pos)) <= 16)
        SELECT batch, 'pooled' AS strategy, 1::BIGINT AS n, round(avg(x) + 1e-9, 5) AS x FROM v GROUP BY 1 UNION ALL SELECT batch, 'per_position', count(*), round(sum(x) + 1e-9, 5) FROM v GROUP BY 1 UNION ALL SELECT batch, 'subsample', count(*), round(sum(x) + 1e-9, 5) FROM s GROUP BY 1""",
}
