"""Finding images, lists, catalogs and sources; modes of a run; metric logs."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions.scalars import auto_name, is_url
from siftline.functions.tables import table
from siftline.plans.storage import fresh_path
from siftline.sources.manifest import path_exists

# Suffixes by use; they differ on purpose.
DISCOVERY_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "tiff")
LOADER_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")


class SiftlineError(Exception):
    """Base of the engine's own errors."""


class ConfigError(SiftlineError):
    """A configuration that cannot work."""


class DataError(SiftlineError):
    """Input that breaks a constraint."""


def has_suffix(path: Column, suffixes=DISCOVERY_SUFFIXES) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1)).isin(*suffixes)


def list_images(spark: SparkSession, folder: str, suffixes=DISCOVERY_SUFFIXES, recursive: bool = True, content: bool = False) -> DataFrame:
    """Image files of a folder (path, length[, content]); names alone are read unless content is asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where(has_suffix(F.col("path"), suffixes)).select("path", "length", *(["content"] if content else []))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Paths of a text list, trimmed, without blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def resolve_split(spark: SparkSession, spec: str, base: str) -> DataFrame:
    """A folder or a text list, relative to ``base``; a spec that isn't there is tried without its leading ``..``."""
    stripped = spec
    while stripped.startswith("../"):
        stripped = stripped[3:]
    for s in dict.fromkeys((spec, stripped)):
        path = s if s.startswith("/") or "://" in s else f"{base.rstrip('/')}/{s}"
        if path_exists(spark, path):
            return read_list(spark, path) if path.endswith(".txt") else list_images(spark, path, LOADER_SUFFIXES).select("path")
    raise FileNotFoundError(spec)


def build_manifest(parts: dict[str, DataFrame]) -> DataFrame:
    """(dataset, path) of several sets; a path belongs to the first set that has it."""
    out = None
    for k, (name, df) in enumerate(parts.items()):
        part = df.select("path", F.struct(F.lit(k).alias("k"), F.lit(name).alias("name")).alias("d"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("path").agg(F.min("d").alias("d")).select("d.name", "path").withColumnRenamed("name", "dataset")


def load_sources(lines: DataFrame) -> DataFrame:
    """(ordinal, name, url) of "name url" or bare "url" lines; ``#`` starts a comment; mixing both is an error.

    A source list is a page of configuration, so its lines are numbered in one window.
    """
    line = F.trim(F.regexp_replace("value", r"(^|\s)#.*$", ""))
    rows = lines.withColumn("__i", F.monotonically_increasing_id()).select("__i", F.split(line, r"\s+").alias("p")).where("p[0] <> ''")
    url = F.element_at("p", -1)
    rows = rows.select(F.row_number().over(Window.orderBy("__i")).alias("ordinal"), F.when(F.size("p") > 1, F.col("p")[0]).alias("name"), url.alias("url"))
    odd = rows.agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("named"), F.coalesce(F.sum((~is_url(F.col("url"))).cast("int")), F.lit(0)).alias("bad")).first()
    if odd.bad or odd.named not in (0, odd.n):
        raise ConfigError("sources are all named or all bare urls")
    return rows.withColumn("name", F.coalesce("name", auto_name("ds_", F.col("ordinal"), F.lit(odd.n))))


def consolidate(files: DataFrame) -> DataFrame:
    """(source, split, file) -> name in one folder: the splits in order, later equal names with _dup and a number."""
    order = F.array_position(F.array(F.lit("train"), F.lit("valid"), F.lit("val"), F.lit("test")), F.col("split"))
    k = F.row_number().over(Window.partitionBy("source", "file").orderBy(order)) - 1
    stem, suffix = F.regexp_extract("file", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("file", r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("name", F.when(k == 0, F.col("file")).otherwise(F.concat(stem, F.lit("_dup"), k.cast("string"), suffix)))


def run_mode(n_labelled: Column, n_unlabelled: Column) -> Column:
    """What a run can do with its data; null if there is none."""
    return F.when((n_labelled > 0) & (n_unlabelled > 0), "ssl_finetune").when(n_labelled > 0, "detection").when(n_unlabelled > 0, "ssl_only")


def discover(spark: SparkSession, labelled: str | None = None, unlabelled: str | None = None) -> dict:
    """Counts of both folders and the run's mode."""
    n = [list_images(spark, p).count() if p and path_exists(spark, p) else 0 for p in (labelled, unlabelled)]
    mode = spark.range(1).select(run_mode(F.lit(n[0]), F.lit(n[1]))).first()[0]
    if mode is None:
        raise ConfigError("there is neither labelled nor unlabelled data")
    return {"n_labelled": n[0], "n_unlabelled": n[1], "mode": mode}


@dataclass
class PipelineConfig:
    """Settings of a run; unknown keys of a mapping are left out."""

    labelled: str | None = None
    unlabelled: str | None = None
    epochs: int = 50
    seed: int = 42

    @classmethod
    def from_dict(cls, d: dict) -> PipelineConfig:
        return cls(**{k: v for k, v in d.items() if k in {f.name for f in fields(cls)}})


def run_pipeline(spark: SparkSession, config: PipelineConfig, steps: dict) -> dict:
    """Dispatch by mode to the caller's steps ``pretrain`` and ``finetune``."""
    info = discover(spark, config.labelled, config.unlabelled)
    if info["mode"] != "detection":
        info["pretrain"] = steps["pretrain"](config)
    if info["mode"] != "ssl_only":
        info["finetune"] = steps["finetune"](config, info.get("pretrain"))
    return info


def auto_train(spark: SparkSession, steps: dict, **settings) -> dict:
    return run_pipeline(spark, PipelineConfig.from_dict(settings), steps)


def matching_weights(checkpoint: DataFrame, model: DataFrame, backbone_layers: int | None = None) -> DataFrame:
    """Checkpoint rows (key, shape, values) whose key and shape the model has, of its first layers if asked."""
    hit = checkpoint.join(model.select("key", "shape"), ["key", "shape"])
    layer = F.regexp_extract("key", r"^model\.(\d+)\.", 1).try_cast("int")
    return hit if backbone_layers is None else hit.where(layer < backbone_layers)


def frozen_flags(model: DataFrame, layers: int) -> DataFrame:
    return model.withColumn("frozen", F.coalesce(F.regexp_extract("key", r"^model\.(\d+)\.", 1).try_cast("int") < layers, F.lit(False)))


def log_rows(spark: SparkSession, run: str, step: int, metrics: dict[str, float]) -> DataFrame:
    """Long form of one step's metrics, so that a metric that comes late changes no header."""
    return spark.createDataFrame([(run, step, k, float(v)) for k, v in metrics.items()], "run string, step long, key string, value double")


def wide_log(log: DataFrame, keys: list[str]) -> DataFrame:
    return log.groupBy("run", "step").pivot("key", keys).agg(F.max("value"))


class Logger:
    """Appends step metrics to tables; ``sinks`` are paths or callables."""

    def __init__(self, spark: SparkSession, run: str, sinks: list):
        self.spark, self.run, self.sinks, self.step = spark, run, sinks, -1

    def log(self, metrics: dict[str, float], step: int | None = None) -> int:
        self.step = self.step + 1 if step is None else step
        rows = log_rows(self.spark, self.run, self.step, metrics)
        for sink in self.sinks:
            sink(rows) if callable(sink) else rows.coalesce(1).write.mode("append").parquet(sink)
        return self.step


def build_logger(spark: SparkSession, backend: str, run: str, path: str) -> Logger:
    """none, csv or parquet; several joined by +."""
    sinks = {"none": None, "parquet": path, "csv": lambda rows: rows.coalesce(1).write.mode("append").option("header", True).csv(path)}
    if unknown := [b for b in backend.split("+") if b not in sinks]:
        raise ConfigError(f"no logger {unknown}")
    return Logger(spark, run, [s for b in backend.split("+") if (s := sinks[b]) is not None])


# The columns of a step log.
STEP_LOG = "step long, epoch long, iter_tag string, iter_a string, iter_b string, source string, det_loss double, cl_loss double, rot_loss double, total_loss double, lambda_cl double, lambda_rot double, temp double, tap_layer string, two_view int, aug_preset string, rot_acc double, pretext string"


def write_steps(rows: DataFrame, path: str) -> None:
    """Append steps; columns that a run doesn't have are null."""
    columns = [c.split() for c in STEP_LOG.split(", ")]
    rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in columns)).write.mode("append").option("header", True).csv(path)


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STEP_LOG).option("header", True).csv(path)


def leakage_main(argv: list[str], spark: SparkSession) -> str:
    """Command line of the leakage report: pool table, downstream table (name, key), key column -> JSON lines."""
    from siftline.operators.dedup import leakage_report

    pool, downstream, key = argv
    rows = leakage_report(spark.read.parquet(pool), spark.read.parquet(downstream), key).orderBy("name").collect()
    return "\n".join(json.dumps(r.asDict()) for r in rows)


def q_discover_mode(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    n = d.groupBy("source").agg(F.count("quality").alias("n_labelled"), F.sum(F.col("quality").isNull().cast("long")).alias("n_unlabelled"))
    return n.select("source", "n_labelled", "n_unlabelled", run_mode(F.when(F.col("n_labelled") > 20, F.col("n_labelled")).otherwise(0), F.when(F.col("n_unlabelled") > 28, F.col("n_unlabelled")).otherwise(0)).alias("mode"))


def q_first_dataset_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    sets = {f"lang-{x}": d.where(F.col("lang") == x) for x in ("en", "fr")} | {"named": d.where("source IS NOT NULL"), "rest": d}
    m = build_manifest({k: v.select(F.md5("text").alias("path")) for k, v in sets.items()})
    return m.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


def q_consolidated_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.element_at(F.array(F.lit("train"), F.lit("valid"), F.lit("test")), (F.col("doc_id") / 20 % 3 + 1).cast("int")).alias("split"), F.concat(F.lit("img.v1_"), (F.col("doc_id") / 60).cast("int"), F.lit(".jpg")).alias("file")).distinct()
    return consolidate(d)


def q_metric_pivot(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).cast("string").alias("run"), (F.col("event_id") % 50).alias("step"), F.col("event_type").alias("key"), "value")
    return wide_log(e, ["click", "view"])


def q_run_log(spark, sf_dir):
    """One run told to three sinks, with a step that is given and ones that count on."""
    path, rows = fresh_path(spark, "log"), []
    log = Logger(spark, "r", [f"{path}/p", lambda d: d.coalesce(1).write.mode("append").option("header", True).csv(f"{path}/c"), lambda d: rows.extend(d.collect())])
    log.log({"loss": 1.5})
    log.log({"acc": 0.5}, 7)
    log.log({"loss": 1.0})
    parts = {"parquet": spark.read.parquet(f"{path}/p"), "csv": spark.read.schema("run string, step long, key string, value double").option("header", True).csv(f"{path}/c"), "call": spark.createDataFrame(rows, "run string, step long, key string, value double")}
    out = None
    for name, d in parts.items():
        part = d.select(F.lit(name).alias("sink"), "step", "key", "value")
        out = part if out is None else out.unionByName(part)
    return out


def q_step_table(spark, sf_dir):
    """The eighteen columns of a step log, written by parts and read with their header."""
    path = fresh_path(spark, "steps")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), (F.col("event_id") % 7).alias("epoch"), F.col("value").alias("det_loss"), F.col("event_type").alias("pretext"))
    for k in range(2):
        write_steps(e.where(F.col("step") % 2 == k), path)
    d = read_steps(spark, path)
    return d.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("det_loss") + 1e-9, 4).alias("total")).withColumn("n_columns", F.lit(len(d.columns)).cast("long"))


def q_run_modes(spark, sf_dir):
    """Runs over folders with labelled data, unlabelled data and both; unknown settings are left out."""
    from siftline.sources.pool import put_files

    path, rows = fresh_path(spark, "modes"), []
    put_files(spark.createDataFrame([(f"{path}/l/a.jpg", b"x"), (f"{path}/u/b.png", b"x")], "path string, data binary")).count()
    steps = {"pretrain": lambda c: "pre", "finetune": lambda c, p: f"fine:{p}"}
    for run, settings in (("both", {"labelled": f"{path}/l", "unlabelled": f"{path}/u"}), ("labelled", {"labelled": f"{path}/l"}), ("unlabelled", {"unlabelled": f"{path}/u", "labelled": f"{path}/none"})):
        info = auto_train(spark, steps, **settings, epochs=3, nothing=1)
        rows.append((run, info["mode"], info.get("pretrain"), info.get("finetune"), PipelineConfig.from_dict({"epochs": 3, "nothing": 1}).epochs))
    return spark.createDataFrame(rows, "run string, mode string, pretrain string, finetune string, epochs long")


def q_leakage_command(spark, sf_dir):
    """The report's command line over two stored tables: its JSON lines read again."""
    d, path = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("h"), "lang", "source"), fresh_path(spark, "leakage")
    d.where("source <> 'src0'").select("id", "h").write.parquet(f"{path}/pool")
    d.where("source = 'src0'").select(F.col("lang").alias("name"), "h").write.parquet(f"{path}/down")
    rows = [json.loads(x) for x in leakage_main([f"{path}/pool", f"{path}/down", "h"], spark).splitlines()]
    return spark.createDataFrame([(r["name"], r["n_rows"]) for r in rows], "name string, n_rows long")


def q_named_backbones(spark, sf_dir):
    """A list of bare urls with comments and blank lines, as a text file."""
    path = fresh_path(spark, "list")
    spark.createDataFrame([("# all of them",), ("",), ("http://h/a  # first",), ("  https://h/b?x=1",)], "value string").coalesce(1).write.text(path)
    return load_sources(spark.read.text(path))


QUERIES = {f.__name__[2:]: f for f in (q_run_log, q_step_table, q_run_modes, q_leakage_command, q_named_backbones, q_discover_mode, q_first_dataset_wins, q_consolidated_names, q_metric_pivot)}
ORACLES = {
    "discover_mode": """WITH n AS (SELECT source, count(quality) AS n_labelled, sum((quality IS NULL)::INT)::BIGINT AS n_unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
        SELECT *, CASE WHEN n_labelled > 20 AND n_unlabelled > 28 THEN 'ssl_finetune' WHEN n_labelled > 20 THEN 'detection' WHEN n_unlabelled > 28 THEN 'ssl_only' END AS mode FROM n""",
    "first_dataset_wins": "WITH p AS (SELECT md5(text) AS path, min(CASE WHEN lang = 'en' THEN 0 WHEN lang = 'fr' THEN 1 WHEN source IS NOT NULL THEN 2 ELSE 3 END) AS k FROM documents GROUP BY 1) SELECT ['lang-en', 'lang-fr', 'named', 'rest'][k + 1] AS dataset, count(*) AS n FROM p GROUP BY 1",
    "run_log": "SELECT * FROM (VALUES ('parquet', 0::BIGINT, 'loss', 1.5::DOUBLE), ('parquet', 7, 'acc', 0.5), ('parquet', 8, 'loss', 1.0), ('csv', 0, 'loss', 1.5), ('csv', 7, 'acc', 0.5), ('csv', 8, 'loss', 1.0), ('call', 0, 'loss', 1.5), ('call', 7, 'acc', 0.5), ('call', 8, 'loss', 1.0)) t(sink, step, key, value)",
    "step_table": "SELECT event_id % 7 AS epoch, count(*) AS n, round(sum(value) + 1e-9, 4) AS total, 18::BIGINT AS n_columns FROM events GROUP BY 1",
    "run_modes": "SELECT * FROM (VALUES ('both', 'ssl_finetune', 'pre', 'fine:pre', 3::BIGINT), ('labelled', 'detection', NULL, 'fine:None', 3), ('unlabelled', 'ssl_only', 'pre', NULL, 3)) t(run, mode, pretrain, finetune, epochs)",
    "leakage_command": """WITH p AS (SELECT md5(text) AS h FROM documents WHERE source <> 'src0'), d AS (SELECT lang AS name, md5(text) AS h FROM documents WHERE source = 'src0') SELECT name, count(*) AS n_rows FROM d GROUP BY 1 UNION ALL SELECT '*', count(*) FROM d""",
    "named_backbones": "SELECT * FROM (VALUES (1, 'ds_01', 'http://h/a'), (2, 'ds_02', 'https://h/b?x=1')) t(ordinal, name, url)",
    "consolidated_names": """WITH f AS (SELECT DISTINCT source, ['train', 'valid', 'test'][(doc_id // 20) % 3 + 1] AS split, 'img.v1_' || doc_id // 60 || '.jpg' AS file FROM documents),
        k AS (SELECT *, row_number() OVER (PARTITION BY source, file ORDER BY list_position(['train', 'valid', 'val', 'test'], split)) - 1 AS k FROM f)
        SELECT source, split, file, CASE WHEN k = 0 THEN file ELSE replace(file, '.jpg', '') || '_dup' || k || '.jpg' END AS name FROM k""",
    "metric_pivot": "SELECT CAST(user_id % 4 AS VARCHAR) AS run, event_id % 50 AS step, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS view FROM events GROUP BY 1, 2",
}
