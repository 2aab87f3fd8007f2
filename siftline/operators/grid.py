"""Experiment grids: expansion, excludes, resume, cell ids, running cells."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.tables import table
from siftline.plans.storage import fresh_path

TOLERANCE = 1e-9
# Columns of the result tables.
PRETRAIN_SCHEMA = "cell_id string, seed long, axes_json string, metric string, metric_value string, status string, elapsed_s double, error string, started_at string, backbone_path string"
RESULT_SCHEMA = "method string, dataset string, fraction double, seed long, task string, metric string, metric_value double, status string, elapsed_s double, error string, started_at string"


def expand(spark: SparkSession, axes: dict[str, list], seeds: list[int] | None = None) -> DataFrame:
    """The product of all axes (and seeds) in product order, with ``ordinal``.

    Axes are lists in a configuration, so the tables are a few rows each and the product is the
    grid itself; nothing of the data is crossed.
    """
    axes = axes | ({"seed": seeds} if seeds is not None else {})
    parts = []
    for name, values in axes.items():
        if not values:
            raise ValueError(f"axis {name} has no values")
        parts.append((name, F.array(*(F.lit(v) for v in values)), len(values)))
    grid, ordinal = spark.range(1).select(), F.lit(0).cast("long")
    for name, values, n in parts:
        grid = grid.select("*", F.posexplode(values).alias(f"__{name}", name))
        ordinal = ordinal * n + F.col(f"__{name}")
    return grid.select(*axes, ordinal.alias("ordinal"))


def exclude_condition(columns: list[str], excludes: list[dict]) -> Column:
    """True where all fields of any filter match; a field may list values; numbers match within TOLERANCE.

    A filter that names an unknown axis matches nothing, one without fields everything.
    """

    def one(col: str, value) -> Column:
        if isinstance(value, (list, tuple)):
            return reduce(Column.__or__, (one(col, v) for v in value), F.lit(False))
        if isinstance(value, float):
            return F.abs(F.col(col) - F.lit(value)) < TOLERANCE
        return F.col(col) == F.lit(value)

    known = [e for e in excludes if all(k in columns for k in e)]
    return reduce(Column.__or__, (reduce(Column.__and__, (one(k, v) for k, v in e.items()), F.lit(True)) for e in known), F.lit(False))


def apply_excludes(grid: DataFrame, excludes: list[dict]) -> DataFrame:
    return grid.where(~F.coalesce(exclude_condition(grid.columns, excludes), F.lit(False)))


def exclude_by_table(grid: DataFrame, excludes: DataFrame) -> DataFrame:
    """The same with filters as rows, a null field matching anything.

    Every filter row counts: one left anti join on equal fields for each set of fields that rows
    name (at most 2 to the number of columns), so none needs the table on one machine.
    """
    columns = excludes.columns
    named = excludes.select(*(F.col(c).isNotNull().alias(c) for c in columns)).distinct().collect()
    for fields in named:
        rows = excludes.where(reduce(Column.__and__, (F.col(c).isNotNull() == F.lit(fields[c]) for c in columns)))
        keys = [c for c in columns if fields[c]]
        if not keys:
            return grid.limit(0)
        grid = grid.join(rows.select(*keys).distinct(), keys, "left_anti")
    return grid


def pending(grid: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Cells without a result whose status is ok."""
    done = results.where("status = 'ok'").select(*keys).distinct()
    return grid.join(done, keys, "left_anti")


def axes_json(columns: list[str]) -> Column:
    """JSON of the named columns with sorted keys, blanks after comma and colon."""
    def item(c):
        value = F.col(c)
        return F.concat(F.lit(f'"{c}": '), F.when(value.isNull(), F.lit("null")).otherwise(F.expr(f"to_json(named_struct('v', `{c}`))").substr(F.lit(6), F.length(F.expr(f"to_json(named_struct('v', `{c}`))")) - 6)))

    return F.concat(F.lit("{"), F.concat_ws(", ", *(item(c) for c in sorted(columns))), F.lit("}"))


def cell_id(columns: list[str]) -> Column:
    """Twelve hex digits of the SHA-1 of a cell's JSON."""
    return F.substring(F.sha1(axes_json(columns)), 1, 12)


def check_grid(config: dict, runners: dict) -> None:
    """Raises for a grid that can't be run."""
    for key in ("methods", "datasets", "fractions", "seeds", "task"):
        if key not in config:
            raise ValueError(f"the grid lacks {key}")
    if config["task"] not in runners:
        raise ValueError(f"no runner for {config['task']}")
    if any(isinstance(x, dict) and "name" not in x for x in (*config["methods"], *config["datasets"])):
        raise ValueError("methods and datasets have names")
    if any(not 0 < f <= 1 for f in config["fractions"]):
        raise ValueError("fractions lie above 0 and up to 1")


def run_cells(spark: SparkSession, cells: DataFrame, runner: Callable[[dict], dict], path: str, keys: list[str], on_error: str = "continue", resume: bool = True, schema: str = RESULT_SCHEMA) -> DataFrame:
    """Run the pending cells one after the other and append a result row each.

    Cells are the rows of a configuration; each is an outside training run, so the driver's
    loop is the work itself. A failure is a row with status failed, or is raised.
    """
    from siftline.sources.manifest import path_exists

    def results():
        return spark.read.schema(schema).option("header", True).option("nullValue", "").option("escape", '"').csv(path) if path_exists(spark, path) else spark.createDataFrame([], schema)

    todo = pending(cells, results(), keys) if resume else cells
    for row in todo.orderBy("ordinal").collect():
        cell, began, started = row.asDict(), time.time(), datetime.now().strftime("%Y-%m-%dT%H:%M:%S")
        out = {"status": "ok", "error": None}
        try:
            out |= runner(cell)
        except Exception as x:
            if on_error == "raise":
                raise
            out |= {"status": "failed", "error": f"{type(x).__name__}: {x}"}
        out |= cell | {"elapsed_s": round(time.time() - began, 2), "started_at": started}
        names = [f.split()[0] for f in schema.split(", ")]
        spark.createDataFrame([tuple(out.get(n) for n in names)], schema).coalesce(1).write.mode("append").option("header", True).option("nullValue", "").option("escape", '"').csv(path)
    return results()


def cv_matrix(backbones: list[dict], folds: list[dict], seed: int = 0, baselines: tuple[str, ...] = (), fractions: tuple[float, ...] = (1.0,)) -> dict:
    """Methods times folds times fractions; a name may occur once."""
    names = [b["name"] for b in backbones] + list(baselines)
    if len(set(names)) < len(names):
        raise ValueError("a method name occurs twice")
    return {"methods": names, "datasets": [f["name"] for f in folds], "fractions": list(fractions), "seeds": [seed], "task": "detection"}


def load_methods(spec: list) -> list[dict]:
    """Method list with the path under any of three keys; bare paths are named in order."""
    out = []
    for k, x in enumerate(spec):
        x = {"ckpt": x} if isinstance(x, str) else dict(x)
        path = x.get("backbone_ckpt") or x.get("ckpt") or x.get("path")
        out.append({"name": x.get("name") or f"bb_{k + 1:0{max(2, len(str(len(spec))))}d}", "backbone_ckpt": path})
    if len({x["name"] for x in out}) < len(out):
        raise ValueError("a method name occurs twice")
    return out


GRID = {"method": ["a", "b", "c"], "dataset": ["x", "y"], "fraction": [0.01, 0.1, 1.0]}


def q_grid_expand(spark, sf_dir):
    return expand(spark, GRID, [0, 1])


def q_grid_exclude(spark, sf_dir):
    g = expand(spark, GRID, [0, 1])
    return apply_excludes(g, [{"method": "a", "fraction": 0.1}, {"dataset": "y", "method": ["b", "c"], "seed": 1}, {"nothing": 1}]).select("method", "dataset", "fraction", "seed")


def _results(spark, sf_dir):
    """Events as result rows: users are seeds, types are datasets."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.element_at(F.array(*map(F.lit, GRID["method"])), (F.col("user_id") % 3 + 1).cast("int")).alias("method"), F.col("event_type").alias("dataset"),
        F.element_at(F.array(F.lit(0.1), F.lit(1.0)), (F.col("event_id") % 2 + 1).cast("int")).alias("fraction"), (F.col("user_id") % 5).alias("seed"),
        F.when(F.col("event_id") % 11 == 0, "failed").otherwise("ok").alias("status"), "event_id", "value",
    )


def q_grid_resume(spark, sf_dir):
    types = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]
    g = expand(spark, {"method": ["a", "b", "c", "d"], "dataset": [*types, "new"], "fraction": [0.1, 1.0]}, [0, 7])
    return pending(g, _results(spark, sf_dir), ["method", "dataset", "fraction", "seed"]).select("method", "dataset", "fraction", "seed")


def q_cell_id(spark, sf_dir):
    g = expand(spark, {"mode": ["none", "both"], "size": [1, 20]}, [0, 1])
    return g.select("mode", "size", "seed", axes_json(["mode", "size", "seed"]).alias("axes_json"), cell_id(["mode", "size", "seed"]).alias("cell_id"))


def q_grid_exclude_table(spark, sf_dir):
    """Cells by region and nation against filters as rows, of every set of fields."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.explode(F.array(*map(F.lit, range(8)))).alias("seed"))
    rules = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey").cast("int")).alias("n_nationkey"), F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 2).cast("int")).alias("n_regionkey"), (F.col("c_custkey") % 5).cast("int").alias("seed"))
    return exclude_by_table(n, rules)


def q_grid_exclude_edges(spark, sf_dir):
    """Filters without fields, with unknown ones, with lists and near numbers: what each leaves of the grid."""
    g, out = expand(spark, GRID, [0, 1]), None
    for k, e in enumerate(([], [{}], [{"nothing": 1}], [{"nothing": 1, "method": "a"}], [{"fraction": 0.1 + 1e-12}], [{"seed": [0, 1], "method": ["a", "b"]}])):
        part = apply_excludes(g, e).agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def q_cells_run(spark, sf_dir):
    """Cells run with failures, run again, and run with the table kept: rows by status and method."""
    path = fresh_path(spark, "cells")
    cells = expand(spark, {"method": ["a", "b"], "dataset": ["x", "y"], "fraction": [1.0]}, [0]).withColumn("task", F.lit("t"))
    keys, tries = ["method", "dataset", "fraction", "seed"], []

    def runner(cell):
        tries.append(cell["method"])
        if cell["method"] == "b" and tries.count("b") < 3:
            raise RuntimeError('no "luck", yet')
        return {"metric": "m", "metric_value": 0.25 * len(cell["dataset"])}

    run_cells(spark, cells, runner, path, keys)
    run_cells(spark, cells, runner, path, keys)
    out = run_cells(spark, cells, runner, path, keys)
    return out.groupBy("method", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("metric_value"), 6).alias("mean"), F.max("error").alias("error"), F.max((F.col("elapsed_s") == F.round("elapsed_s", 2)).cast("int")).alias("rounded"), F.max(F.col("started_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$").cast("int")).alias("timed"))


def q_pretrain_cells_run(spark, sf_dir):
    """A pretraining grid with its own columns, resumed by cell id."""
    path, cells = fresh_path(spark, "pretrain"), expand(spark, {"mode": ["none", "both"], "size": [1, 20]}, [0, 1])
    cells = cells.withColumn("axes_json", axes_json(["mode", "size"])).withColumn("cell_id", cell_id(["mode", "size", "seed"]))
    runner = lambda cell: {"metric": "final_backbone", "metric_value": f"{cell['cell_id']}.pt", "backbone_path": f"{cell['cell_id']}.pt"}
    first = run_cells(spark, cells.where("ordinal < 3"), runner, path, ["cell_id"], schema=PRETRAIN_SCHEMA)
    n = first.count()
    rows = run_cells(spark, cells, runner, path, ["cell_id"], schema=PRETRAIN_SCHEMA)
    return rows.select("cell_id", "seed", "axes_json", "metric", "metric_value", "status", "backbone_path", F.lit(n).cast("long").alias("n_first"))


def q_cv_cells(spark, sf_dir):
    """Backbones under any of three keys and bare paths, times folds, as cells."""
    names = load_methods([{"name": "m1", "ckpt": "a.pt"}, {"name": "m2", "path": "b.pt"}, {"name": "m3", "backbone_ckpt": "c.pt"}])
    bare = load_methods(["x.pt", "y.pt"])
    c = cv_matrix(names, [{"name": f"fold_{k}"} for k in range(3)], 0, ("coco",), (0.1, 1.0))
    cells = expand(spark, {"method": c["methods"], "dataset": c["datasets"], "fraction": c["fractions"]}, c["seeds"])
    return cells.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first")).withColumn("bare", F.lit(",".join(b["name"] for b in bare))).withColumn("paths", F.lit(",".join(b["backbone_ckpt"] for b in names)))


QUERIES = {f.__name__[2:]: f for f in (q_grid_exclude_table, q_grid_exclude_edges, q_cells_run, q_pretrain_cells_run, q_cv_cells, q_grid_expand, q_grid_exclude, q_grid_resume, q_cell_id)}
_G = "m(method, mi) AS (VALUES ('a', 0), ('b', 1), ('c', 2)), d(dataset, di) AS (VALUES ('x', 0), ('y', 1)), f(fraction, fi) AS (VALUES (0.01::DOUBLE, 0), (0.1::DOUBLE, 1), (1.0::DOUBLE, 2)), s(seed) AS (VALUES (0), (1))"
ORACLES = {
    "grid_exclude_table": """WITH c AS (SELECT n_nationkey, n_regionkey, seed::INT AS seed FROM nation, (SELECT unnest(range(8)) AS seed)),
        r AS (SELECT CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS n, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 END AS g, c_custkey % 5 AS s FROM customer)
        SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE (r.n IS NULL OR r.n = c.n_nationkey) AND (r.g IS NULL OR r.g = c.n_regionkey) AND r.s = c.seed)""",
    "grid_exclude_edges": "SELECT k::INT AS k, n::BIGINT AS n FROM (VALUES (0, 36), (1, 0), (2, 36), (3, 36), (4, 24), (5, 12)) t(k, n)",
    "cells_run": "SELECT * FROM (VALUES ('a', 'ok', 2::BIGINT, 0.25::DOUBLE, NULL::VARCHAR, 1, 1), ('b', 'failed', 2, NULL, 'RuntimeError: no \"luck\", yet', 1, 1), ('b', 'ok', 2, 0.25, NULL, 1, 1)) t(method, status, n, mean, error, rounded, timed)",
    "pretrain_cells_run": """WITH g AS (SELECT seed, '{"mode": "' || mode || '", "size": ' || size || '}' AS axes_json, substr(sha1('{"mode": "' || mode || '", "seed": ' || seed || ', "size": ' || size || '}'), 1, 12) AS cell_id FROM (SELECT unnest(['none', 'both']) AS mode), (SELECT unnest([1, 20]) AS size), (SELECT unnest([0, 1])::BIGINT AS seed))
        SELECT cell_id, seed, axes_json, 'final_backbone' AS metric, cell_id || '.pt' AS metric_value, 'ok' AS status, cell_id || '.pt' AS backbone_path, 3::BIGINT AS n_first FROM g""",
    "cv_cells": "SELECT method, 6::BIGINT AS n, k * 6::BIGINT AS first, 'bb_01,bb_02' AS bare, 'a.pt,b.pt,c.pt' AS paths FROM (VALUES ('m1', 0), ('m2', 1), ('m3', 2), ('coco', 3)) t(method, k)",
    "grid_expand": f"WITH {_G} SELECT method, dataset, fraction, seed, (((mi * 2 + di) * 3 + fi) * 2 + seed)::BIGINT AS ordinal FROM m, d, f, s",
    "grid_exclude": f"WITH {_G} SELECT method, dataset, fraction, seed FROM m, d, f, s WHERE NOT (method = 'a' AND abs(fraction - 0.1) < 1e-9) AND NOT (dataset = 'y' AND method IN ('b', 'c') AND seed = 1)",
    "grid_resume": """
        WITH g AS (SELECT method, dataset, fraction::DOUBLE AS fraction, seed FROM (SELECT unnest(['a', 'b', 'c', 'd']) AS method), (SELECT DISTINCT event_type AS dataset FROM events UNION SELECT 'new'), (SELECT unnest([0.1, 1.0]) AS fraction), (SELECT unnest([0, 7]) AS seed)),
        r AS (SELECT ['a', 'b', 'c'][user_id % 3 + 1] AS method, event_type AS dataset, [0.1, 1.0][event_id % 2 + 1]::DOUBLE AS fraction, user_id % 5 AS seed FROM events WHERE event_id % 11 <> 0)
        SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.method = g.method AND r.dataset = g.dataset AND r.fraction = g.fraction AND r.seed = g.seed)""",
    "cell_id": """
        WITH g AS (SELECT mode, size, seed, '{"mode": "' || mode || '", "seed": ' || seed || ', "size": ' || size || '}' AS axes_json FROM (SELECT unnest(['none', 'both']) AS mode), (SELECT unnest([1, 20]) AS size), (SELECT unnest([0, 1]) AS seed))
        SELECT *, substr(sha1(axes_json), 1, 12) AS cell_id FROM g""",
}
