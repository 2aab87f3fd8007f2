"""SimHash near-duplicates by tiled exact comparison.

Fingerprints. Words of the text in lower case (A-Z) form shingles, repeats included; each bit
of the fingerprint is 1 if it is set in over half of the shingles' XXH64 hashes.

Comparison. Distinct fingerprints are compared with numpy exclusive-or and bit counts, tile
against tile, in the order of their population counts; tiles whose population counts differ
by more than the radius are skipped. Up to ``FILL`` fingerprints are one such group. More are
partitioned first: fingerprints that differ in at most ``radius`` bits agree in at least
``blocks - radius`` of any ``blocks`` parts of their bits, so each is put under every choice of
that many parts, and tiles are made of the fingerprints under one key. This loses no link.
The number and width of the parts follow the number of fingerprints, so that a key holds
about ``FILL`` of them at any size. A key with more than ``SPLIT`` fingerprints is dealt into
several sets, and each pair of sets is a group of its own.

Links inside a group are reduced to a spanning forest on the spot, so a group of n
fingerprints sends fewer than n rows. Components are then joined by alternating large-star
and small-star steps, each written to the shared folder.

Nulls and odd rows: a null or wordless text has fingerprint zero, linked like any other; texts
with fewer words than a shingle hash their whole sequence of words; equal texts share one
fingerprint and are compared once; a null id is never a component's smallest; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.tables import own_columns
from siftline.llm.tokens import batches
from siftline.plans.storage import write_back

#: Side of a tile; fingerprints from which a key is dealt into several sets.
TILE, SPLIT = 256, 65_536
#: Fingerprints a key should hold on average, for choosing the number and width of the parts.
FILL = 2048


def fingerprints(texts: list[str], words: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints of whole texts, as signed integers."""
    import xxhash

    hashes, counts = [], []
    digest = xxhash.xxh64_digest
    for text in texts:
        w = text.encode("utf-8", "surrogatepass").lower().split()
        joined = b" ".join(w)
        if len(w) <= words:
            found = [digest(joined, seed)] if w else []
        else:
            ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
            found = [digest(joined[a:b], seed) for a, b in zip([0, *ends[:-words].tolist()], (ends[words - 1 :] - 1).tolist(), strict=True)]
        hashes += found
        counts.append(len(found))
    return majority_bits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), np.array(counts, np.int64))


def majority_bits(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of n hashes, each eight bytes from the highest on; 0 for an empty run."""
    out = np.zeros((len(n), 8), np.uint8)
    some = np.flatnonzero(n)
    if len(some):
        at = (np.cumsum(n) - n)[some]
        total = np.add.reduceat(np.unpackbits(hashes, axis=1), at, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * total > n[some, None], axis=1)
    return out.view(">i8").ravel().astype(np.int64)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, row_hash, fp of every row."""

    def run(stream):
        for batch in stream:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            fp = [fingerprints(texts[a:b], words, seed) for a, b in batches(texts, 500_000)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(fp) if fp else np.zeros(0, np.int64))], ["doc_id", "row_hash", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_hash"), text_col).mapInArrow(run, "doc_id long, row_hash long, fp long")


def schemes(n: int, radius: int, bits: int = 64) -> list[int]:
    """Masks of key bits for about n fingerprints: the fewest and narrowest parts whose keys hold FILL at most on average."""
    need = max(0, (max(n, 1) - 1) // FILL).bit_length()
    if not need:
        return [0]
    for blocks in range(radius + 1, radius + 4):
        together = blocks - radius
        width = min(-(-need // together), bits // blocks)  # used bits of a part
        if width * together >= need:
            break
    edges = [bits * k // blocks for k in range(blocks)]
    masks = [sum(((1 << width) - 1) << e for e in c) for c in combinations(edges, together)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def tile_links(left: np.ndarray, right: np.ndarray, radius: int, same: bool, seen: list[int] | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, column, matches) of tiles with a link; both sides stand in order of population count.

    ``seen`` counts the tile pairs compared and those skipped by population count.
    """
    lp, rp = np.bitwise_count(left).astype(np.int64), np.bitwise_count(right).astype(np.int64)
    starts = np.arange(0, len(right), TILE)
    low, high = rp[starts], rp[np.minimum(starts + TILE, len(right)) - 1]
    for a in range(0, len(left), TILE):
        x = left[a : a + TILE, None]
        near = (low - lp[min(a + TILE, len(left)) - 1] <= radius) & (lp[a] - high <= radius)
        if same:
            near &= starts >= a
        if seen is not None:
            seen[0] += int(near.sum())
            seen[1] += int((starts >= a).sum() if same else len(starts)) - int(near.sum())
        for b in starts[near].tolist():
            hit = np.bitwise_count(x ^ right[None, b : b + TILE]) <= radius
            if same and a == b:
                np.fill_diagonal(hit, False)
            if hit.any():
                yield a, b, hit


def _settle(hit: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest label that rows and columns of a tile reach through its links."""
    none = np.iinfo(np.int64).max
    while True:
        new_rows = np.minimum(rows, np.where(hit, cols, none).min(axis=1))
        new_cols = np.minimum(cols, np.where(hit, new_rows[:, None], none).min(axis=0))
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols


class Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return int(k)

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def spanning(n: int, shift: int, tiles: Iterator[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of a spanning forest of the matches in ``tiles``, by place; columns stand ``shift`` places after rows."""
    forest = Forest(n)
    for a, b, hit in tiles:
        rows, cols = np.arange(a, a + hit.shape[0]), np.arange(b, b + hit.shape[1]) + shift
        if np.count_nonzero(hit) <= 2 * sum(hit.shape):
            i, j = np.nonzero(hit)
            pairs = zip(rows[i].tolist(), cols[j].tolist(), strict=True)
        else:
            lr, lc = _settle(hit, rows, cols)
            pairs = zip([*rows.tolist(), *cols.tolist()], [*lr.tolist(), *lc.tolist()], strict=True)
        for p, q in pairs:
            forest.join(p, q)
    moved = np.flatnonzero(forest.up != np.arange(n))
    return moved, np.fromiter((forest.root(k) for k in moved), np.int64, len(moved))


def forest_of(left: np.ndarray, right: np.ndarray | None, radius: int, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of a spanning forest of the links in one group; ``right`` is None for a set with itself."""
    same = right is None
    left = left[np.argsort(np.bitwise_count(left), kind="stable")]
    right = left if same else right[np.argsort(np.bitwise_count(right), kind="stable")]
    every = left if same else np.concatenate([left, right])
    moved, roots = spanning(len(every), 0 if same else len(left), tile_links(left, right, radius, same, seen))
    return every[moved], every[roots]


def deal(keyed: DataFrame, key: list[str], own: str, split: int) -> DataFrame:
    """Adds i, j and second: a key with more than ``split`` rows is dealt into sets by a hash of ``own``.

    Each pair of sets (i, j) is a group of its own, where ``second`` marks the rows of set j.
    """
    # Written first: its size is known when the join is planned. Usually it has no row.
    large = write_back(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") > split).select(*key, F.ceil(F.col("__k") / split).cast("int").alias("__sets")), "simhash-large")
    dealt = keyed.join(large, key, "left").withColumn("__sets", F.coalesce("__sets", F.lit(1)))
    dealt = dealt.withColumn("__own", F.pmod(F.xxhash64(own), F.col("__sets")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__sets") - 1)))
    return dealt.select(*keyed.columns, F.least("__own", "__other").alias("i"), F.greatest("__own", "__other").alias("j"), (F.col("__own") > F.col("__other")).alias("second"))


def by_group(n_keys: int, compare):
    """Arrow function that hands ``compare`` the columns of sorted rows and the spans of whole groups, equal in the first ``n_keys`` columns."""

    def run(stream):
        held = None
        for batch in stream:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = np.zeros(len(cols[0]), bool)
            for c in cols[:n_keys]:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist()]
            yield from compare(cols, zip(cuts, cuts[1:], strict=False))
            held = [c[cuts[-1] :].copy() for c in cols]
        if held is not None:
            yield from compare(held, [(0, len(held[0]))])

    return run


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """u, v: edges whose components are those of all links between the fingerprints in ``nodes`` (fp)."""
    masks = schemes(nodes.count(), radius)
    keyed = nodes.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)))).alias("x")).select("fp", "x.band", "x.key")
    dealt = deal(keyed, ["band", "key"], "fp", SPLIT).select("band", "key", "i", "j", "second", "fp")
    group = ["band", "key", "i", "j"]

    def compare(cols, spans):
        us, vs = [], []
        for a, b in spans:
            if b - a < 2:
                continue
            fp, second = cols[5][a:b].view(np.uint64), cols[4][a:b].astype(bool)
            u, v = forest_of(fp, None, radius) if cols[2][a] == cols[3][a] else forest_of(fp[~second], fp[second], radius)
            if len(u):
                us.append(u)
                vs.append(v)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us).view(np.int64)), pa.array(np.concatenate(vs).view(np.int64))], ["u", "v"])

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(by_group(4, compare), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each component, for nodes with an edge.

    Large-star: each node's larger neighbours are pointed at its smallest one. Small-star: its
    smaller neighbours are. When nothing changes, every node points at its component's
    smallest. Neighbours are never gathered; only their minimum is.
    """
    edges = write_back(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = write_back(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """doc_id, row_hash, fingerprint (hex), component_id (smallest id of the component) and label (its smallest fingerprint) of every row."""
    rows = write_back(with_fingerprints(docs, id_col, text_col, words, seed), "simhash")
    nodes = write_back(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    label = components(links(nodes.select("fp"), radius))
    named = nodes.join(label, nodes["fp"] == label["node"], "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = named.join(least, "label").select("fp", "label", "component_id")
    return rows.join(found, "fp").select("doc_id", "row_hash", "label", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, seed: int = 42, radius: int = 4) -> DataFrame:
    """One row of each component, that with the smallest id, with the columns of ``docs``."""
    return keep_first(docs, near_duplicates(docs, id_col, text_col, words, seed, radius), id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each label of ``found`` (doc_id, row_hash, label, component_id), that with the smallest id.

    Only the dropped rows' ids and hashes are joined, from a written table whose size Spark
    knows. Rows that share the smallest id are told apart by their text, then one is taken.
    """
    found = found.select("doc_id", "row_hash", "label", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("first"))
    found = write_back(found, "simhash-rows")
    first = found.where("first").groupBy("label").agg(F.min("row_hash").alias("h"), F.count(F.lit(1)).alias("n"))
    bad = found.where("not first").select("doc_id", "row_hash")
    shared = write_back(first.where("n > 1"), "simhash-shared")
    again = found.where("first").join(shared, "label")
    bad = write_back(bad.union(again.where("row_hash <> h").select("doc_id", "row_hash")).select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__h")).distinct(), "simhash-dropped")
    kept = docs.join(bad, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__h")), "left_anti")
    if shared.isEmpty():
        return kept
    own = again.where("row_hash = h").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    key = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__h"))
    return kept.join(own, key, "left_anti").unionByName(kept.join(own, key).dropDuplicates(["__id", "__h"]).select(*own_columns(docs)))
