"""Label files and class columns: dominant class, class sets, multi-hot targets, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.tables import table

#: Class of an item without labels, and of the small classes together.
UNLABELLED, MERGED = -1, -999


def parse_label_lines(text: Column) -> Column:
    """Class numbers of a label file in line order; lines that don't begin with a number are skipped."""
    first = F.transform(F.split(text, "\n"), lambda line: F.split(F.trim(line), r"\s+")[0].try_cast("double"))
    return F.transform(F.filter(first, lambda x: x.isNotNull()), lambda x: x.cast("int"))


def class_set(classes: Column, num_classes: int | None = None, dropped: list[int] | None = None) -> Column:
    """Distinct classes, without dropped and out-of-range ones."""
    out = F.array_distinct(classes)
    if num_classes is not None:
        out = F.filter(out, lambda c: (c >= 0) & (c < num_classes))
    return F.array_except(out, F.array(*map(F.lit, dropped))) if dropped else out


def multi_hot(classes: Column, num_classes: int) -> Column:
    """0/1 array over the classes; null gives zeros."""
    return F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)), lambda c: F.coalesce(F.array_contains(classes, c), F.lit(False)).cast("int"))


def dominant_class(classes: Column) -> Column:
    """Most frequent class of an array, the first met on ties; UNLABELLED for none."""
    counted = F.transform(F.array_distinct(classes), lambda c: F.struct((-F.size(F.filter(classes, lambda x: x == c))).alias("n"), F.array_position(classes, c).alias("at"), c.alias("c")))
    return F.coalesce(F.array_min(counted)["c"], F.lit(UNLABELLED))


def dominant_by_rows(df: DataFrame, item: str, pos: str, cls: str) -> DataFrame:
    """The same from one row a label, for items with more labels than an array should hold."""
    n = df.groupBy(item, cls).agg(F.count(F.lit(1)).alias("__n"), F.min(pos).alias("__p"))
    return n.groupBy(item).agg(F.max_by(cls, F.struct("__n", -F.col("__p"))).alias("cls"))


def class_distribution(df: DataFrame, cls: str) -> DataFrame:
    return df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))


def merge_small(df: DataFrame, cls: str, least: int) -> DataFrame:
    """Classes with fewer than ``least`` rows become MERGED; the class counts are joined, the rows are not grouped."""
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("__n"))
    return df.join(counts, cls).withColumn(cls, F.when(F.col("__n") < least, F.lit(MERGED)).otherwise(F.col(cls))).drop("__n")


def attach_targets(items: DataFrame, labels: DataFrame, key: str, classes: str, num_classes: int, dropped: list[int] | None = None) -> DataFrame:
    """Left join of items and label arrays; items without a label get zeros."""
    kept = class_set(F.col(classes), num_classes, dropped)
    return items.join(labels.select(key, classes), key, "left").withColumn("target", multi_hot(kept, num_classes)).drop(classes)


def single_label_violations(df: DataFrame, source: str, name: str) -> DataFrame:
    """Sources that have not exactly one class name, or another one than the first source's."""
    by = df.groupBy(source).agg(F.count_distinct(name).alias("n_names"), F.min(name).alias("name"))
    first = by.agg(F.min_by("name", source).alias("expected"))
    return by.join(F.broadcast(first)).where((F.col("n_names") != 1) | ~F.col("name").eqNullSafe(F.col("expected"))).select(source, "n_names", "name")


# Queries. Orders are images, their lines are label lines, the ship month is the class.


def _label_files(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 5).alias("cls"))


def _arrays(spark, sf_dir):
    f = _label_files(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "cls"))).alias("x"))
    line = F.transform("x", lambda e: F.concat(e["cls"].cast("string"), F.lit(" 0.5 0.5 0.2 0.2")))
    return f.select("l_orderkey", parse_label_lines(F.concat(F.lit("# bad\n"), F.array_join(line, "\n"), F.lit("\n\n"))).alias("classes"))


def q_dominant_class(spark, sf_dir):
    return _arrays(spark, sf_dir).select("l_orderkey", dominant_class(F.col("classes")).alias("cls"))


def q_dominant_class_by_rows(spark, sf_dir):
    f = _label_files(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.min("cls").alias("cls"))
    return dominant_by_rows(f, "l_orderkey", "l_linenumber", "cls")


def q_class_distribution(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return class_distribution(d.select(F.coalesce("quality", F.lit(UNLABELLED)).alias("cls")), "cls")


def q_class_set_multihot(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    t = attach_targets(items, _arrays(spark, sf_dir), "l_orderkey", "classes", 4, [2])
    return t.select("l_orderkey", F.array_join(F.transform("target", lambda x: x.cast("string")), "").alias("target"))


def q_merged_classes(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("cls"))
    return class_distribution(merge_small(d, "cls", 40), "cls")


def q_single_label_check(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.when(F.col("s_suppkey") % 17 == 0, "b").otherwise("a").alias("name"))
    return single_label_violations(s, "s_nationkey", "name")


QUERIES = {f.__name__[2:]: f for f in (q_dominant_class, q_dominant_class_by_rows, q_class_distribution, q_class_set_multihot, q_merged_classes, q_single_label_check)}
ORACLES = {
    "dominant_class": "WITH n AS (SELECT l_orderkey, l_quantity::INT % 5 AS cls, count(*) AS n, min(rn) AS p FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::INT % 5) AS rn FROM lineitem) GROUP BY 1, 2) SELECT l_orderkey, cls FROM n QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, p) = 1",
    "dominant_class_by_rows": "WITH f AS (SELECT l_orderkey, l_linenumber, min(l_quantity::INT % 5) AS cls FROM lineitem GROUP BY 1, 2), n AS (SELECT l_orderkey, cls, count(*) AS n, min(l_linenumber) AS p FROM f GROUP BY 1, 2) SELECT l_orderkey, cls FROM n QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, p) = 1",
    "class_distribution": "SELECT coalesce(quality, -1) AS cls, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "class_set_multihot": """
        WITH c AS (SELECT l_orderkey, l_quantity::INT % 5 AS cls FROM lineitem)
        SELECT o_orderkey AS l_orderkey, coalesce(max((cls = 0)::INT), 0) || '' || coalesce(max((cls = 1)::INT), 0) || '0' || coalesce(max((cls = 3)::INT), 0) AS target
        FROM orders LEFT JOIN c ON o_orderkey = l_orderkey GROUP BY 1""",
    "merged_classes": "WITH n AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1) SELECT CASE WHEN n < 40 THEN -999 ELSE p_size END AS cls, sum(n)::BIGINT AS n FROM n GROUP BY 1",
    "single_label_check": """
        WITH b AS (SELECT s_nationkey, count(DISTINCT CASE WHEN s_suppkey % 17 = 0 THEN 'b' ELSE 'a' END) AS n_names, min(CASE WHEN s_suppkey % 17 = 0 THEN 'b' ELSE 'a' END) AS name FROM supplier GROUP BY 1)
        SELECT * FROM b WHERE n_names <> 1 OR name IS DISTINCT FROM (SELECT arg_min(name, s_nationkey) FROM b)""",
}
