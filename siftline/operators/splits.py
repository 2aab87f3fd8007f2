"""Source-disjoint splits: holdout by targets, balanced groups, leave-one-group-out folds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.scalars import seeded_order
from siftline.functions.tables import table

HOLDOUT = {"train": 0.70, "val": 0.15, "test": 0.15}


def check_ratios(ratios: dict[str, float]) -> None:
    if any(r < 0 for r in ratios.values()) or abs(sum(ratios.values()) - 1) > 1e-6:
        raise ValueError("ratios must not be negative and must sum to one")


def place_by_deficit(sizes: list[int], targets: list[float]) -> list[int]:
    """Each size, in the given order, goes to the label whose target is furthest from met; the first on ties."""
    have, out = [0] * len(targets), []
    for s in sizes:
        k = max(range(len(targets)), key=lambda j: (targets[j] - have[j], -j))
        have[k] += s
        out.append(k)
    return out


def place_in_smallest(sizes: list[int], k: int) -> list[int]:
    """Each size, in the given order, goes to the group that holds least; the first on ties."""
    return place_by_deficit(sizes, [0.0] * k)


def _sizes(items: DataFrame, source: str, seed: int) -> DataFrame:
    """One row a source with its size and its seeded order among equals."""
    return items.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("size")).withColumn("turn", seeded_order(seed, F.col("source")))


def _assign(sizes: DataFrame, place) -> DataFrame:
    """Runs a placement over the sources, largest first, in one task: a row a source is all it sees."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "turn"], ascending=[False, True])
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "part": place(pdf["size"].tolist())})

    return sizes.groupBy().applyInPandas(run, "source string, size long, part int")


def holdout_sources(items: DataFrame, source: str, ratios: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """source, size, split: largest deficit first, so that no source is in two splits."""
    ratios = ratios or HOLDOUT
    check_ratios(ratios)
    names = [n for n, r in ratios.items() if r > 0]

    def place(sizes):
        return place_by_deficit(sizes, [ratios[n] * sum(sizes) for n in names])

    return _assign(_sizes(items, source, seed), place).select("source", "size", F.element_at(F.array(*map(F.lit, names)), F.col("part") + 1).alias("split"))


def holdout(items: DataFrame, source: str, ratios: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """Items with their split; raises if a split would be empty."""
    parts = holdout_sources(items, source, ratios, seed)
    found = {r[0] for r in parts.select("split").distinct().collect()}
    if missing := {n for n, r in (ratios or HOLDOUT).items() if r > 0} - found:
        raise ValueError(f"too few sources; empty splits: {sorted(missing)}")
    return items.join(parts.select(F.col("source").alias(source), "split"), source)


def fold_groups(items: DataFrame, source: str, k: int, seed: int = 42) -> DataFrame:
    """source, size, fold: balanced groups of whole sources."""
    return _assign(_sizes(items, source, seed), lambda sizes: place_in_smallest(sizes, k)).withColumnRenamed("part", "fold")


def logo_groups(items: DataFrame, source: str) -> DataFrame:
    """Leave one group out: each source is a fold, in the order of names."""
    sizes = items.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("fold", F.row_number().over(Window.orderBy("source")) - 1)


def with_folds(items: DataFrame, groups: DataFrame, source: str) -> DataFrame:
    """Items with ``fold``, that in which they are val; in every other fold they are train."""
    return items.join(groups.select(F.col("source").alias(source), "fold"), source)


def one_fold(marked: DataFrame, fold: int) -> DataFrame:
    """The items of ``with_folds`` with their split in one fold; nothing is copied for the others."""
    return marked.withColumn("split", F.when(F.col("fold") == fold, "val").otherwise("train"))


def folds(items: DataFrame, groups: DataFrame, source: str) -> DataFrame:
    """fold, split and the item's columns of all folds, for few of them: items times folds rows.

    Use ``with_folds`` where each source is a fold.
    """
    ids = groups.select("fold").distinct()
    mine = with_folds(items, groups, source).withColumnRenamed("fold", "__own")
    return mine.join(F.broadcast(ids)).withColumn("split", F.when(F.col("fold") == F.col("__own"), "val").otherwise("train")).drop("__own")


def fold_sizes(marked: DataFrame) -> DataFrame:
    """fold, split, n of every fold from one count by fold: train is all but the fold's own."""
    own = marked.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    both = own.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row a fold
    return both.select("fold", F.inline(F.array(F.struct(F.lit("val").alias("split"), F.col("n").alias("n")), F.struct(F.lit("train").alias("split"), (F.col("total") - F.col("n")).alias("n")))))


def cv_splits(items: DataFrame, source: str, scheme: str = "group_kfold", k: int = 5, seed: int = 42) -> DataFrame:
    """Folds by scheme; splitting single items is refused, since sources would leak."""
    if scheme == "group_kfold":
        return folds(items, fold_groups(items, source, k, seed), source)
    if scheme == "logo":
        return folds(items, logo_groups(items, source), source)
    raise ValueError(f"no source-disjoint scheme: {scheme}")


def mixed_sources(split: DataFrame, source: str) -> DataFrame:
    """Sources that occur in more than one split; empty for a right split."""
    return split.groupBy(source).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def write_split(split: DataFrame, path_col: str, folder: str, names: list[str]) -> None:
    """A text folder a split, and the catalog with class names as JSON."""
    split.select("split", F.col(path_col).cast("string").alias("value")).write.mode("overwrite").partitionBy("split").text(f"{folder}/lists")
    split.sparkSession.createDataFrame([(len(names), names)], "nc int, names array<string>").coalesce(1).write.mode("overwrite").json(f"{folder}/data")


def _items(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", "lang", "source").alias("grp"))


def q_holdout_split(spark, sf_dir):
    s = holdout(_items(spark, sf_dir), "grp")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("grp").alias("n_sources"))


def q_holdout_disjoint(spark, sf_dir):
    """Mixed sources of a right split, and of one that goes by single documents."""
    items = _items(spark, sf_dir)
    wrong = items.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int")))
    found = lambda split, name: mixed_sources(split, "grp").select(F.lit(name).alias("kind"), "grp", "n_splits")
    return found(holdout(items, "grp"), "right").unionByName(found(wrong, "wrong"))


def q_group_kfold(spark, sf_dir):
    return fold_groups(_items(spark, sf_dir), "grp", 5)


def q_logo_folds(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return cv_splits(d, "lang", "logo").groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def q_fold_sizes(spark, sf_dir):
    """Leave one source out, where each of many sources is a fold."""
    items = _items(spark, sf_dir)
    return fold_sizes(with_folds(items, logo_groups(items, "grp"), "grp"))


def q_one_fold(spark, sf_dir):
    items = _items(spark, sf_dir)
    return one_fold(with_folds(items, logo_groups(items, "grp"), "grp"), 2).select("doc_id", "split")


QUERIES = {f.__name__[2:]: f for f in (q_holdout_split, q_holdout_disjoint, q_group_kfold, q_logo_folds, q_fold_sizes, q_one_fold)}
_F = "f AS (SELECT grp, (row_number() OVER (ORDER BY grp) - 1)::INT AS fold, n FROM (SELECT lang || '_' || source AS grp, count(*) AS n FROM documents GROUP BY 1))"
_HOLD = """WITH RECURSIVE s AS (SELECT lang || '_' || source AS source, count(*) AS size FROM documents GROUP BY 1),
    o AS (SELECT source, size, row_number() OVER (ORDER BY size DESC, sha256('42:' || source)) AS r, sum(size) OVER () AS total FROM s),
    g AS (SELECT 0::BIGINT AS r, ''::VARCHAR AS source, 0::BIGINT AS size, -1 AS part, [0, 0, 0]::BIGINT[] AS have
          UNION ALL SELECT o.r, o.source, o.size, p.k, list_transform(g.have, lambda v, i: CASE WHEN i = p.k + 1 THEN v + o.size ELSE v END)
          FROM g JOIN o ON o.r = g.r + 1, LATERAL (SELECT list_transform([0.7, 0.15, 0.15]::DOUBLE[], lambda x, i: x * o.total - g.have[i]) AS d) q, LATERAL (SELECT list_position(q.d, list_max(q.d)) - 1 AS k) p),
    h AS (SELECT source, size, ['train', 'val', 'test'][part + 1] AS split FROM g WHERE r > 0)"""
_GREEDY = """WITH RECURSIVE s AS (SELECT lang || '_' || source AS source, count(*) AS size FROM documents GROUP BY 1),
    o AS (SELECT source, size, row_number() OVER (ORDER BY size DESC, sha256('42:' || source)) AS r FROM s),
    g AS (SELECT 0::BIGINT AS r, ''::VARCHAR AS source, 0::BIGINT AS size, -1 AS part, {start} AS have
          UNION ALL SELECT o.r, o.source, o.size, p.k, list_transform(g.have, lambda v, i: CASE WHEN i = p.k + 1 THEN v + o.size ELSE v END)
          FROM g JOIN o ON o.r = g.r + 1, LATERAL (SELECT list_position(g.have, list_min(g.have)) - 1 AS k) p)"""
ORACLES = {
    "group_kfold": _GREEDY.format(start="[0, 0, 0, 0, 0]::BIGINT[]") + " SELECT source, size, part::INT AS fold FROM g WHERE r > 0",
    "holdout_split": _HOLD + " SELECT split, sum(size)::BIGINT AS n, count(*) AS n_sources FROM h GROUP BY 1",
    "holdout_disjoint": _HOLD + """, i AS (SELECT 'right' AS kind, source AS grp, split FROM h UNION ALL SELECT 'wrong', lang || '_' || source, ['train', 'val', 'test'][doc_id % 3 + 1] FROM documents)
        SELECT kind, grp, count(DISTINCT split) AS n_splits FROM i GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""",
    "fold_sizes": f"WITH {_F} SELECT fold, 'val' AS split, n FROM f UNION ALL SELECT fold, 'train', (SELECT sum(n) FROM f)::BIGINT - n FROM f",
    "one_fold": f"WITH {_F} SELECT doc_id, CASE WHEN fold = 2 THEN 'val' ELSE 'train' END AS split FROM documents JOIN f ON grp = lang || '_' || source",
    "logo_folds": """
        WITH f AS (SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INT AS fold FROM (SELECT DISTINCT lang FROM documents))
        SELECT f.fold, CASE WHEN f.lang = d.lang THEN 'val' ELSE 'train' END AS split, count(*) AS n, min(doc_id) AS first_id FROM documents d, f GROUP BY 1, 2""",
}
