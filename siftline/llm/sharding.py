"""Hierarchical weighted hash tree: region, rack and shard levels (native DataFrame code).

A row descends the tree. At each level every child draws ``-ln(u) / weight`` with ``u``
hashed from the row's key and the child's name, and the smallest draw wins. A child's
draw depends on its own name and weight only, so when a weight rises rows move
only into that child's subtree, when it falls they move only out of it, and the rest
of the tree keeps its rows. A shard that is added as a region of its own therefore takes
rows only into itself.

Nulls and odd rows: a null text counts as empty, a null key hashes as the string
``null``; repeated keys land in one shard and get slots of their own, by checksum and size
of their texts, then in any order, as rows equal in all three are exchangeable; an empty table
gives an empty result. Other columns are not touched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets in which slots are counted; the table of counts has at most this times the shards.
SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Topology:
    """The leaves of the tree; the weight of an inner node is the sum of its leaves'."""

    leaves: tuple[Leaf, ...]

    def __post_init__(self):
        if not self.leaves:
            raise ValueError("a topology needs a shard")
        if any(x.weight <= 0 for x in self.leaves):
            raise ValueError("weights must be positive")
        if len({x.shard for x in self.leaves}) < len(self.leaves):
            raise ValueError("a shard number is used twice")

    @classmethod
    def balanced(cls, regions: int, racks: int, shards: int) -> Topology:
        """Equal weights; shard numbers run through racks and regions in order."""
        return cls(tuple(Leaf(f"g{k // (racks * shards)}", f"k{k // shards % racks}", k) for k in range(regions * racks * shards)))

    def with_shard(self, weight: float = 1.0) -> Topology:
        """One more shard, in a region of its own, so that rows move only into it."""
        n = max(x.shard for x in self.leaves) + 1
        return Topology((*self.leaves, Leaf(f"g+{n}", "k0", n, weight)))

    def children(self, path: tuple[str, ...]) -> list[tuple[str, float, tuple]]:
        """(hashed name, weight, path or leaf) of the nodes below ``path``."""
        own = [x for x in self.leaves if (x.region, x.rack)[: len(path)] == path]
        if len(path) == 2:
            return [(f"{x.region}/{x.rack}/s{x.shard}", x.weight, x) for x in own]
        names = dict.fromkeys((x.region, x.rack)[len(path)] for x in own)
        return [("/".join((*path, n)), sum(x.weight for x in own if (x.region, x.rack)[len(path)] == n), (*path, n)) for n in names]


def draw_cost(key: Column, name: str, weight: float) -> Column:
    """Exponential draw of one child: -ln(u) / weight, u from 52 bits of MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"@{name}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 1.0) / F.lit(float(2**52))) / F.lit(float(weight))


def shard_of(key: Column, topology: Topology) -> Column:
    """The shard number of a string key, as one expression without any join."""

    def descend(path: tuple[str, ...]) -> Column:
        below = topology.children(path)
        found = [F.lit(x.shard) if isinstance(x, Leaf) else descend(x) for _, _, x in below]
        if len(below) == 1:
            return found[0]
        costs = [draw_cost(key, name, weight) for name, weight, _ in below]
        least = F.least(*costs)
        return reduce(lambda rest, k: F.when(costs[k] == least, found[k]).otherwise(rest), reversed(range(len(below) - 1)), found[-1])

    return descend(()).cast("int")


def add_slots(df: DataFrame, shard: str, order: list[str], bucket_by: list[str], buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Gapless slots from 0 in each shard, without sorting a shard in one task.

    Rows are numbered inside (shard, hash bucket) and shifted by the counts of the
    earlier buckets. The shifts, at most ``buckets`` times shards rows, are broadcast.
    ``bucket_by`` should tell rows of one key apart, so that a hot key fills many buckets.
    """
    rows = df.withColumn("__bucket", F.pmod(F.xxhash64(*bucket_by), F.lit(buckets)))
    counts = rows.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col(shard).alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = F.row_number().over(Window.partitionBy(shard, "__bucket").orderBy(*order))
    return (
        rows.withColumn("__rank", inside)
        .join(F.broadcast(shifts), (F.col(shard) == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
        .withColumn("slot", (F.col("__shift") + F.col("__rank") - 1).cast("long"))
        .drop("__bucket", "__rank", "__shift", "__s", "__b")
    )


def assign(docs: DataFrame, topology: Topology, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Size, checksum, shard, slot and the shard in the grown tree of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, topology).alias("shard"),
        shard_of(key, topology.with_shard()).alias("grown_shard"),
    )
    return add_slots(rows, "shard", ["doc_id", "text_crc32", "size"], ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
