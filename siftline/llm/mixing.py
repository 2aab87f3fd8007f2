"""Mixing sources to target weights by subset-sum budget fitting.

1. Documents are counted by exact token length in every source.
2. Each source gets a target: its weight's part of the budget, held at ``cap`` times its
   size, with the excess shared again by weight.
3. Whole passes over a source take ``floor(target / size)`` copies of all of it. What is
   left of the target takes an even part of each length, and the last remainder, below
   the sum of a few lengths, is fitted by a bounded-knapsack dynamic program over the
   lengths still free, whose reachable sums are the bits of one integer.
4. Each length's count is then given to documents in the order of a seeded hash: up to the cut, the
hash of the last one taken, which is found by counting hash buckets and then in one bucket of
each length. Whether a row is taken follows from its own source, length and hash, so neither texts
nor rows are sorted or shuffled where the plan is small enough to be broadcast.

Only (source, length) counts reach the program, never documents.

Nulls and odd rows: a null text has length 0; null sources form one source, last in order;
repeated rows are separate documents, ordered by a hash of id and text, then equal ones are
exchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.tables import own_columns
from siftline.plans.storage import write_back

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Hash buckets in which the documents of one source and length are counted.
BUCKETS = 1024
#: Rows of a plan (a row for each source and length) up to which it is broadcast; beyond, Spark joins by its sizes.
BROADCAST_ROWS = 500_000


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size -> target. One row per source, so the windows see few rows.

    Filling by water level: sort sources by cap / weight. The first sources stay at their
    caps as long as the level that the rest would reach lies above them.
    """
    every = Window.partitionBy(F.lit(0))
    named = sizes.withColumn("__r", F.row_number().over(every.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("__r", F.lit(len(weights))) + 1).cast("int"))
    named = named.withColumn("__w", w).withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    by_ratio = every.orderBy(F.col("__cap") / F.col("__w"), "__r").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(by_ratio), F.lit(0.0))) / (
        F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(by_ratio), F.lit(0.0))
    )
    held = named.withColumn("__level", level).withColumn("__full", F.col("__level") * F.col("__w") >= F.col("__cap"))
    open_level = F.min(F.when(~F.col("__full"), F.struct(F.col("__cap") / F.col("__w"), F.col("__r"), F.col("__level").alias("x")))).over(every)["x"]
    return held.select("source", "source_size", F.when(F.col("__full"), F.col("__cap")).otherwise(open_level * F.col("__w")).alias("target"))


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that the sum comes nearest to ``budget`` from below.

    An even part of each length first, then single documents from the longest length down
    while they fit, then the dynamic program on what remains.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    budget = max(0, min(budget, total))
    if not total or not budget:
        return [0] * len(lengths)
    take = [c * budget // total if n else 0 for n, c in zip(lengths, counts, strict=True)]
    rest = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted((k for k, n in enumerate(lengths) if n), key=lambda k: -lengths[k])
    for k in order:
        more = min(counts[k] - take[k], rest // lengths[k], 1)
        take[k] += more
        rest -= more * lengths[k]
    # A few documents are given back, so that the program has sums to choose from.
    for k in reversed(order):
        back = min(take[k], 2)
        if rest + back * lengths[k] > 4 * max(lengths) + 4096:
            break
        take[k] -= back
        rest += back * lengths[k]
    for k, n in zip(order, knapsack([lengths[k] for k in order], [counts[k] - take[k] for k in order], rest), strict=True):
        take[k] += n
    return take


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """Bounded subset sum: counts whose sum is the largest one not above ``budget``.

    Bit s of an integer says that sum s can be reached. Each length's count is split into
    powers of two; the way back goes through the integers kept for each split.
    """
    out = [0] * len(lengths)
    mask, reach, steps = (1 << budget + 1) - 1, 1, []
    for k, (n, c) in enumerate(zip(lengths, counts, strict=True)):
        c, part = min(c, budget // n if n else 0), 1
        while c > 0:
            now = min(part, c)
            steps.append((k, now, reach))
            reach = (reach | reach << now * n) & mask
            c, part = c - now, part * 2
        if reach >> budget & 1:
            break
    left = reach.bit_length() - 1
    for k, now, before in reversed(steps):
        if not before >> left & 1:
            out[k] += now
            left -= now * lengths[k]
    return out


def _plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (source, size, n, target, source_size) of one source -> passes and extra documents by length."""
    pdf = pdf.sort_values("size")
    whole, goal = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = int(goal // whole) if whole else 0
    extra = fit_budget(pdf["size"].tolist(), pdf["n"].tolist(), int(round(goal - passes * whole))) if whole else [0] * len(pdf)
    return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "passes": passes, "extra": extra})


def plan_mix(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, bool]:
    """The plan of rows (source, size, order_hash, bucket), and whether a cut divides rows that are equal.

    One row for each source and length: __s, __z, source_size, target, passes, and the cut: the
    bucket, the hash in it, how many rows have that hash (ties) and how many of those are taken.
    """
    dealt = write_back(rows.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "mix-buckets")
    by_length = dealt.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = write_back(targets(sizes, weights, share, cap), "mix-targets")
    plan = (
        by_length.join(goals, by_length["source"].eqNullSafe(goals["source"])).drop(goals["source"])
        .groupBy("source").applyInPandas(_plan_source, "source string, size long, passes long, extra long")
    )
    plan = write_back(plan.select(F.col("source").alias("__s"), F.col("size").alias("__z"), "passes", "extra"), "mix-plan")
    here = F.expr("source <=> __s AND size = __z")
    before = lambda c: F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = dealt.join(plan.where("extra > 0"), here).withColumn("prior", before("bucket")).where("prior < extra AND extra <= prior + n")
    cuts = write_back(cuts.select("__s", "__z", F.col("bucket").alias("cut"), (F.col("extra") - F.col("prior")).alias("need")), "mix-cuts")
    # Equal rows are one row here; a bucket of a length is a 1024th of it.
    inside = rows.join(cuts, F.expr("source <=> __s AND size = __z AND bucket = cut")).groupBy("source", "size", "order_hash", "cut", "need").agg(F.count(F.lit(1)).alias("n"))
    ends = inside.withColumn("prior", before("order_hash")).where("prior < need AND need <= prior + n")
    ends = ends.select(F.col("source").alias("__es"), F.col("size").alias("__ez"), "cut", F.col("order_hash").alias("last"), F.col("n").alias("ties"), (F.col("need") - F.col("prior")).alias("ties_taken"))
    whole = plan.drop("extra").join(ends, F.expr("__s <=> __es AND __z = __ez"), "left").drop("__es", "__ez").alias("p").join(goals.alias("g"), F.expr("p.__s <=> g.source"))
    whole = write_back(whole.select("__s", "__z", "source_size", "target", "passes", "cut", "last", "ties", "ties_taken"), "mix-whole-plan")
    divided = not whole.where("ties_taken < ties").isEmpty()
    return (F.broadcast(whole) if whole.count() <= BROADCAST_ROWS else whole), divided


def with_copies(rows: DataFrame, plan: DataFrame, divided: bool, source: Column, size: str, order_hash: str) -> DataFrame:
    """``rows`` with the plan's columns and ``copies``, the passes and one more up to the cut.

    Of equal rows that a cut divides the first ones are taken, by any numbering.
    """
    d = rows.join(plan, source.eqNullSafe(F.col("__s")) & (F.col(size) == F.col("__z")))
    bucket, at_cut = F.shiftrightunsigned(order_hash, 54), F.col(order_hash) == F.col("last")
    one = F.when(F.col("cut").isNull(), 0).when(bucket != F.col("cut"), (bucket < F.col("cut")).cast("int")).otherwise((F.col(order_hash) <= F.col("last")).cast("int"))
    copies = (F.col("passes") + one).cast("long").alias("copies")
    if not divided:
        return d.select("*", copies)
    part = F.coalesce(at_cut & (F.col("ties_taken") < F.col("ties")), F.lit(False))
    turn = F.row_number().over(Window.partitionBy("__s", "__z", order_hash).orderBy("__s"))
    return d.where(~part).select("*", copies).unionByName(d.where(part).select("*", (F.col("passes") + (turn <= F.col("ties_taken")).cast("long")).cast("long").alias("copies")))


def _lengths(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), id_col, text_col).alias("order_hash"),
    )
    assert BUCKETS == 1 << 10  # the ten leading bits
    return write_back(rows, "mix-lengths").withColumn("bucket", F.shiftrightunsigned("order_hash", 54))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source, source_size, target, copies, taken, order_hash."""
    rows = _lengths(docs, id_col, text_col, source_col, seed)
    plan, divided = plan_mix(rows, weights, share, cap)
    out = with_copies(rows, plan, divided, F.col("source"), "size", "order_hash")
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "order_hash")


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns.

    Each row's length and hash are worked out again where it lies, so that its text is not moved.
    """
    plan, divided = plan_mix(_lengths(docs, id_col, text_col, source_col, seed), weights, share, cap)
    own = F.struct(*own_columns(docs)).alias("__row")
    rows = docs.select(own, F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size"), F.xxhash64(F.lit(seed), id_col, text_col).alias("__hash"))
    taken = with_copies(rows, plan, divided, F.col("__source"), "__size", "__hash")
    return taken.where("copies > 0").select("__row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("__row.*")
