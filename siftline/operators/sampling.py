"""Deterministic sampling: nested fractions, stratified interleaving, water-filling, seeded picks."""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.scalars import seeded_order
from siftline.functions.tables import table

#: Class that takes the place of classes with too few rows.
FEW = -999


def global_rank(df: DataFrame, order_hash: str, *ties: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds __pos, the rank from 0 by a hex hash (in each ``by`` group), without one task sorting a group.

    Rows are ranked inside buckets of the hash's leading digits, which follow its order, and
    shifted by the counts of the earlier buckets.
    """
    rows = df.withColumn("__b", F.conv(F.substring(order_hash, 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*(by or (F.lit(0),))).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*(F.col(c).alias(f"__by{k}") for k, c in enumerate(by)), F.col("__b").alias("__bb"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(order_hash, *ties))
    same = F.col("__b") == F.col("__bb")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{k}"))
    return rows.withColumn("__r", inside).join(shifts, same).withColumn("__pos", F.col("__shift") + F.col("__r") - 1).drop("__b", "__bb", "__r", "__shift", *(f"__by{k}" for k in range(len(by))))


def fraction_size(fraction: float | Column, n: Column) -> Column:
    """Rows of a fraction, half to even, one at least."""
    f = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return F.greatest(F.lit(1), F.rint(f * n).cast("long"))


def nested_fractions(df: DataFrame, id_col: str, fractions: list[float], seed: int) -> DataFrame:
    """(fraction, id, pos): prefixes of one seeded order, so that smaller fractions lie in larger ones."""
    ranked = global_rank(df.select(id_col, seeded_order(seed, F.col(id_col)).alias("__h")), "__h", id_col)
    return _prefixes(ranked.select(id_col, F.col("__pos").alias("pos")), id_col, fractions)


def _prefixes(ranked: DataFrame, id_col: str, fractions: list[float]) -> DataFrame:
    n = ranked.agg(F.count(F.lit(1)).alias("__n"))
    each = ranked.join(F.broadcast(n)).withColumn("fraction", F.explode(F.array(*(F.lit(float(f)) for f in sorted(fractions)))))
    return each.where(F.col("pos") < fraction_size(F.col("fraction"), F.col("__n"))).select("fraction", id_col, "pos")


def nesting_violations(fractions: DataFrame, id_col: str) -> DataFrame:
    """Rows of a fraction that the next larger one lacks."""
    levels = fractions.select("fraction").distinct()
    following = levels.select("fraction", F.lead("fraction").over(Window.orderBy("fraction")).alias("next")).where("next is not null")
    small = fractions.join(F.broadcast(following), "fraction")
    return small.join(fractions.select(F.col("fraction").alias("next"), id_col, "pos"), ["next", id_col, "pos"], "left_anti")


def deficit_schedule(counts: list[int]) -> Iterator[int]:
    """Class of each step: that whose share runs furthest behind, n_c (t + 1) - taken_c N, the first on ties.

    Whole numbers throughout. A class's deficit grows by n_c a step, so its order against the
    others moves; each step costs the number of classes.
    """
    total, taken = sum(counts), [0] * len(counts)
    for t in range(total):
        best = max(range(len(counts)), key=lambda c: (counts[c] * (t + 1) - taken[c] * total if taken[c] < counts[c] else -1 - total * total, -c))
        taken[best] += 1
        yield best


def stratified_order(df: DataFrame, id_col: str, cls: str, seed: int, min_per_class: int = 1) -> DataFrame:
    """id, cls, pos: every prefix has the classes in their shares, by the deficit rule.

    Classes with fewer than ``min_per_class`` rows count as one, FEW. The schedule depends on
    the class counts alone and repeats as often as their common divisor says, so one small task makes
    one round of it, (class, rank) -> pos, and the rows, ranked inside their class by a seeded
    hash, are joined to it by their rank in the round.
    """
    own = df.select(id_col, F.col(cls).cast("long").alias(cls))
    sizes = own.groupBy(F.col(cls).alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    merged = own.join(sizes, F.col(cls).eqNullSafe(F.col("__c"))).withColumn("__g", F.when((F.col("__n") >= min_per_class) & F.col("__c").isNotNull(), F.col("__c")).otherwise(F.lit(FEW).cast("long")))
    ranked = global_rank(merged.select(id_col, cls, "__g", seeded_order(seed, F.col(id_col)).alias("__h")), "__h", id_col, by=("__g",))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        rounds = gcd(*pdf["n"].tolist())
        steps = list(deficit_schedule([n // rounds for n in pdf["n"].tolist()]))
        out = pd.DataFrame({"k": steps})
        out["r"] = out.groupby("k").cumcount()
        out["at"] = range(len(out))
        out["c"], out["each"], out["period"] = pdf["c"].to_numpy()[out["k"]], (pdf["n"] // rounds).to_numpy()[out["k"]], len(out)
        return out[["c", "r", "at", "each", "period"]]

    counts = sizes.groupBy(F.when((F.col("__n") >= min_per_class) & F.col("__c").isNotNull(), F.col("__c")).otherwise(F.lit(FEW).cast("long")).alias("c")).agg(F.sum("__n").alias("n"))
    schedule = counts.groupBy().applyInPandas(plan, "c long, r long, at long, each long, period long")
    each = schedule.groupBy(F.col("c").alias("__k")).agg(F.max("each").alias("__each"))  # a row a class
    turns = ranked.join(F.broadcast(each), F.col("__g") == F.col("__k")).withColumn("__turn", F.expr("__pos div __each")).withColumn("__r", F.expr("__pos % __each"))
    return turns.join(schedule, (F.col("__g") == F.col("c")) & (F.col("__r") == F.col("r"))).select(id_col, cls, (F.col("at") + F.col("__turn") * F.col("period")).alias("pos"))


def stratified_fractions(df: DataFrame, id_col: str, cls: str, fractions: list[float], seed: int) -> DataFrame:
    return _prefixes(stratified_order(df, id_col, cls, seed).select(id_col, "pos"), id_col, fractions)


def water_fill(counts: DataFrame, target: int, name: str = "source", count: str = "available") -> DataFrame:
    """Adds keep: equal parts of ``target`` capped by what each source has, the excess shared again.

    Closed form: in order of count a source is used up as long as count (N - rank) <= target less
    what came before. The others take the quotient, the largest of them one more of the remainder.
    """
    w = Window.orderBy(F.col(count), F.col(name))
    every = Window.partitionBy(F.lit(0))
    d = counts.withColumn("__r", F.row_number().over(w) - 1).withColumn("__p", F.coalesce(F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("__n", F.count(F.lit(1)).over(every)).withColumn("__all", F.sum(count).over(every))
    d = d.withColumn("__full", (F.col("__all") <= target) | (F.col(count) * (F.col("__n") - F.col("__r")) <= F.lit(target) - F.col("__p")))
    d = d.withColumn("__rest", F.lit(target) - F.sum(F.when(F.col("__full"), F.col(count)).otherwise(0)).over(every)).withColumn("__k", F.sum((~F.col("__full")).cast("long")).over(every))
    turn = F.row_number().over(Window.partitionBy("__full").orderBy(F.col(count).desc(), F.col(name)))
    share = F.expr("if(__full, 0, __rest div greatest(__k, 1))") + (turn <= F.expr("if(__full, 0, __rest % greatest(__k, 1))")).cast("long")
    return d.withColumn("__turn", turn).withColumn("keep", F.when(F.col("__full"), F.col(count)).otherwise(share).cast("long")).select(*counts.columns, "keep")


def select_kept(files: DataFrame, keep: DataFrame, seed: int, source: str = "source", name: str = "name") -> DataFrame:
    """The seeded ``keep`` files of each source."""
    ranked = global_rank(files.withColumn("__h", seeded_order(seed, F.col(source), F.col(name))), "__h", name, by=(source,))
    return ranked.join(keep.select(source, "keep"), source).where("__pos < keep").select(*files.columns)


def equal_sample(df: DataFrame, group: str, id_col: str, size: int, seed: int = 0) -> DataFrame:
    """The same number of rows from each group, max(1, size // groups)."""
    n = df.agg(F.count_distinct(group).alias("__g"))
    ranked = global_rank(df.withColumn("__h", seeded_order(seed, F.col(id_col))), "__h", id_col, by=(group,))
    return ranked.join(F.broadcast(n)).where(F.col("__pos") < F.greatest(F.lit(1), F.floor(F.lit(size) / F.greatest("__g", F.lit(1))))).select(*df.columns)


def write_fractions(fractions: DataFrame, id_col: str, path: str) -> None:
    """One text folder a fraction."""
    fractions.select("fraction", F.col(id_col).cast("string").alias("value")).write.mode("overwrite").partitionBy("fraction").text(path)


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def q_water_fill_allocation(spark, sf_dir):
    counts = _docs(spark, sf_dir).groupBy(F.concat_ws("_", "lang", (F.col("doc_id") % 7).cast("string")).alias("source")).agg(F.count(F.lit(1)).alias("available"))
    return water_fill(counts, 400)


def q_select_kept(spark, sf_dir):
    files = _docs(spark, sf_dir).select(F.col("lang").alias("source"), F.format_string("f%07d", F.col("doc_id")).alias("name"))
    keep = water_fill(files.groupBy("source").agg(F.count(F.lit(1)).alias("available")), 300)
    return select_kept(files, keep, 42)


def q_stratified_sample_per_source(spark, sf_dir):
    return equal_sample(_docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", 170)


def q_label_fraction_uniform(spark, sf_dir):
    return nested_fractions(_docs(spark, sf_dir).select("doc_id"), "doc_id", [0.01, 0.1, 0.5, 1.0], 42)


def q_label_fraction_stratified(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("cls")), "doc_id")
    return stratified_order(d, "doc_id", "cls", 42)


def q_label_fraction_merged(spark, sf_dir):
    """Classes of fewer than forty rows are one."""
    d = _docs(spark, sf_dir).select("doc_id", (F.col("n_chars") % 64 % 9 + F.when(F.col("doc_id") < 30, F.lit(100)).otherwise(F.lit(0))).alias("cls"))
    return stratified_order(d, "doc_id", "cls", 7, 40)


def q_verify_nested(spark, sf_dir):
    """Rows that break the nesting of true fractions, and of ones drawn with a seed each."""
    docs = _docs(spark, sf_dir).select("doc_id")
    right = nested_fractions(docs, "doc_id", [0.1, 0.3, 1.0], 1)
    wrong = nested_fractions(docs, "doc_id", [0.1], 1).unionByName(nested_fractions(docs, "doc_id", [0.3], 2)).unionByName(nested_fractions(docs, "doc_id", [1.0], 1))
    count = lambda f, name: nesting_violations(f, "doc_id").groupBy("fraction").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "fraction", "n")
    return count(right, "right").unionByName(count(wrong, "wrong"))


QUERIES = {f.__name__[2:]: f for f in (q_water_fill_allocation, q_select_kept, q_stratified_sample_per_source, q_label_fraction_uniform, q_label_fraction_stratified, q_label_fraction_merged, q_verify_nested)}


def _fill_sql(counts: str, target: int) -> str:
    return f"""c AS ({counts}), r AS (SELECT *, row_number() OVER (ORDER BY available, source) - 1 AS r, count(*) OVER () AS n, sum(available) OVER () AS a,
        coalesce(sum(available) OVER (ORDER BY available, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM c),
        f AS (SELECT *, a <= {target} OR available * (n - r) <= {target} - p AS full_ FROM r),
        g AS (SELECT *, {target} - sum(CASE WHEN full_ THEN available ELSE 0 END) OVER () AS rest, sum((NOT full_)::INT) OVER () AS k, row_number() OVER (PARTITION BY full_ ORDER BY available DESC, source) AS t FROM f),
        fill AS (SELECT source, available, CAST(CASE WHEN full_ THEN available ELSE rest // greatest(k, 1) + (t <= rest % greatest(k, 1))::INT END AS BIGINT) AS keep FROM g)"""


def _deficit_sql(rows: str, seed: int, least: int) -> str:
    """The deficit rule step by step over ``rows`` (doc_id, cls)."""
    return f"""WITH RECURSIVE d AS ({rows}), z AS (SELECT cls, count(*) AS n FROM d GROUP BY 1), m AS (SELECT doc_id, d.cls, CASE WHEN z.n >= {least} THEN d.cls ELSE -999 END AS g FROM d JOIN z ON z.cls = d.cls),
        r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY sha256('{seed}:' || doc_id), doc_id) AS r FROM m), c AS (SELECT list(n ORDER BY g) AS n, list(g ORDER BY g) AS g, sum(n)::BIGINT AS total FROM (SELECT g, count(*) AS n FROM m GROUP BY 1)),
        s AS (SELECT -1::BIGINT AS t, 0::BIGINT AS k, list_transform(n, lambda x: 0::BIGINT) AS taken FROM c
              UNION ALL SELECT s.t + 1, p.k, list_transform(s.taken, lambda x, i: CASE WHEN i = p.k THEN x + 1 ELSE x END) FROM s, c,
              LATERAL (SELECT list_transform(c.n, lambda x, i: CASE WHEN s.taken[i] < x THEN x * (s.t + 2) - s.taken[i] * c.total ELSE -9000000000000000000 END) AS v) q, LATERAL (SELECT list_position(q.v, list_max(q.v)) AS k) p WHERE s.t + 1 < c.total)
        SELECT doc_id, cls, t AS pos FROM s, c, r WHERE t >= 0 AND r.g = c.g[k] AND r.r = taken[k]"""


ORACLES = {
    "water_fill_allocation": "WITH " + _fill_sql("SELECT lang || '_' || doc_id % 7 AS source, count(*) AS available FROM documents GROUP BY 1", 400) + " SELECT * FROM fill",
    "select_kept": "WITH " + _fill_sql("SELECT lang AS source, count(*) AS available FROM documents GROUP BY 1", 300) + """,
        n AS (SELECT lang AS source, 'f' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS name FROM documents)
        SELECT source, name FROM n JOIN fill USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || source || ':' || name), name) <= any_value(keep) OVER (PARTITION BY source)""",
    "stratified_sample_per_source": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('0:' || doc_id), doc_id) <= greatest(1, 170 // (SELECT count(DISTINCT source) FROM documents))",
    "label_fraction_uniform": """
        WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
        SELECT fraction, doc_id, pos FROM r, (SELECT unnest([0.01, 0.1, 0.5, 1.0])::DOUBLE AS fraction) WHERE pos < greatest(1, round_even(fraction * n, 0)::BIGINT)""",
    "label_fraction_stratified": _deficit_sql("SELECT doc_id, quality::BIGINT AS cls FROM documents JOIN labels USING (doc_id)", 42, 1),
    "label_fraction_merged": _deficit_sql("SELECT doc_id, n_chars % 64 % 9 + CASE WHEN doc_id < 30 THEN 100 ELSE 0 END AS cls FROM documents", 7, 40),
    "verify_nested": """
        WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('1:' || doc_id), doc_id) - 1 AS p1, row_number() OVER (ORDER BY sha256('2:' || doc_id), doc_id) - 1 AS p2, count(*) OVER () AS n FROM documents),
        f AS (SELECT 'right' AS kind, fraction, doc_id, p1 AS pos FROM d, (SELECT unnest([0.1, 0.3, 1.0])::DOUBLE AS fraction) WHERE p1 < greatest(1, round_even(fraction * n, 0)) UNION ALL
              SELECT 'wrong', fraction, doc_id, CASE WHEN fraction = 0.3 THEN p2 ELSE p1 END FROM d, (SELECT unnest([0.1, 0.3, 1.0])::DOUBLE AS fraction) WHERE CASE WHEN fraction = 0.3 THEN p2 ELSE p1 END < greatest(1, round_even(fraction * n, 0)))
        SELECT kind, fraction, count(*) AS n FROM f a WHERE fraction < 1 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.kind = a.kind AND b.doc_id = a.doc_id AND b.pos = a.pos AND b.fraction = CASE WHEN a.fraction < 0.2 THEN 0.3::DOUBLE ELSE 1.0 END) GROUP BY 1, 2""",
}
