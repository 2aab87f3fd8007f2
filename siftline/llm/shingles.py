"""Near-duplicates by exact similarity of shingle sets, with SimHash tiles as the comparison.

Sets. Words of the text in lower case (A-Z) form shingles of five words; a text is the set of
their XXH64 hashes. Rows with equal sets are one node, with a SimHash fingerprint of the set, twice
64 bits. Two nodes are linked if the Jaccard similarity of their sets is at least 4/5.

Partition. All sets are put in one order of the shingles. If two sets are similar, at least
4/5 of either is shared, so their first fifths (rounded, and one more) share a shingle: only
nodes that meet under such a shingle are compared. Shingles that are frequent in a sample of the
rows stand last in the order; that keeps the groups small and has no bearing on the result.

Comparison. Nodes of a group whose sizes allow the similarity and whose fingerprints differ in at
most ``RADIUS`` of 128 bits are candidates. Sets with similarity 4/5 differ in 19 bits on average
(standard deviation 4), so a link is left out at that stage with a chance of some 1 in
100,000, and only if no other of its component ties it; unrelated sets differ in 64. Every
candidate is confirmed by the whole sets, which are taken from the texts again: a bitmap of row
hashes, of bounded size, is broadcast, so that no other text is moved.

First each node is held against one node of each of its groups, so that a large group of copies
is one component after one pass. Then groups that still hold several components go through tiles
of exclusive-or and bit counts in numpy: tiles of one component with itself, and tiles whose
population counts differ by more than the radius, are skipped. A group sends a spanning forest of
its candidates, never its pairs; the trees of all groups make clusters, and in each cluster the
whole sets are compared in blocks, which again send forests. So what is sent grows with the
nodes; comparisons grow with the square of a cluster of sets that are all nearly similar.

Nulls and odd rows: null and wordless texts have the empty set and are linked to each other;
texts with fewer words than a shingle have one, their whole sequence of words; a null id is
never a component's smallest; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.tables import own_columns
from siftline.llm.simhash import TILE, by_group, components, deal, keep_first, majority_bits, spanning
from siftline.llm.tokens import batches
from siftline.plans.storage import forget, write_back

#: Similarity from which nodes are linked, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Rows that are sampled for the order; rows of them that make a shingle frequent; most frequent shingles told to the workers.
SAMPLE, FREQUENT, MAX_FREQUENT = 20_000, 3, 100_000
#: Differing bits of the fingerprints of candidates; nodes from which a group, and a cluster of whole sets, is dealt into several parts.
RADIUS, SPLIT, SPLIT_SETS = 36, 8192, 1024
#: Shingles whose incidence is multiplied at once; pairs from which that is cheaper than one by one, for each of them.
COLUMNS, DENSE = 8192, 2e-3
#: Bits of the bitmap for each row that it marks, and its smallest and largest size as powers of two.
BITS_A_ROW, LEAST_BITS, MOST_BITS = 16, 16, 26
#: Candidates of a node in a tile that are tried first.
NEAREST = 4


def shingle_set(text: str, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= words:
        found = [digest(b" ".join(w), seed)] if w else []
    else:
        joined, ends = b" ".join(w), np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        found = [digest(joined[a:b], seed) for a, b in zip([0, *ends[:-words].tolist()], (ends[words - 1 :] - 1).tolist(), strict=True)]
    return np.unique(np.array(found, np.uint64).view(np.int64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Other 64 bits of each hash, by a public finaliser (multiply and shift)."""
    x = h.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def two_fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    return tuple(majority_bits(h.astype(">u8").view(np.uint8).reshape(-1, 8), n) for h in (every.view(np.uint64), mixed(every)))


def first_part(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of a set that a similar set must share one of; ``frequent`` is sorted, ``rank`` its places in the order."""
    n = len(s)
    if n and len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        late = frequent[at] == s
        s = np.concatenate([s[~late], s[late][np.argsort(rank[at[late]])]])
    return s[: n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1] if n else s


def _lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))


def frequent_shingles(docs: DataFrame, text_col: str, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and the rank of each by rising frequency."""

    def run(stream):
        for batch in stream:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in batches(texts, 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(t, words, seed) for t in texts[a:b]]))], ["shingle"])

    rows = docs.count()
    some = docs.select(text_col).sample(SAMPLE / rows, 0) if rows > SAMPLE else docs.select(text_col)
    counts = some.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    found = counts.orderBy(F.desc("n"), "shingle").limit(MAX_FREQUENT).select("shingle").toArrow().column(0).to_numpy()
    order = np.argsort(found)
    return found[order], (len(found) - order).astype(np.int64)


def with_nodes(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """doc_id, row_hash, node, n (size of the set), part (its first part) of every row."""
    frequent, rank = frequent_shingles(docs, text_col, words, seed)

    def run(stream):
        from xxhash import xxh64_intdigest

        for batch in stream:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in batches(texts, 500_000):
                sets = [shingle_set(t, words, seed) for t in texts[a:b]]
                node = np.array([xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                n = np.array([len(s) for s in sets], np.int64)
                fp, fq = two_fingerprints(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(node), pa.array(n), pa.array(fp), pa.array(fq), _lists([first_part(s, frequent, rank) for s in sets])], ["doc_id", "row_hash", "node", "n", "fp", "fq", "part"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_hash"), text_col).mapInArrow(run, "doc_id long, row_hash long, node long, n long, fp long, fq long, part array<long>")


def _near_in_size(a: Column, b: Column) -> Column:
    return DENOMINATOR * F.least(a, b) >= NUMERATOR * F.greatest(a, b)


def _candidates(a: str, b: str) -> Column:
    """Whether two nodes' sizes and fingerprints allow the similarity."""
    apart = sum(F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in ("fp", "fq"))
    return _near_in_size(F.col(f"{a}.n"), F.col(f"{b}.n")) & (apart <= RADIUS)


def candidate_tiles(left: tuple, right: tuple, same: bool, seen: list[int] | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, column, matches) of tiles with candidates of different labels; sides are (n, fp, fq, label, ones) by label and bit count.

    ``seen`` counts tile pairs compared and skipped.
    """
    starts = np.arange(0, len(right[0]), TILE)
    if not len(starts):
        return
    ends = np.minimum(starts + TILE, len(right[0]))
    low, high = np.minimum.reduceat(right[4], starts), np.maximum.reduceat(right[4], starts)
    for a in range(0, len(left[0]), TILE):
        xs, xp, xq, xl, xo = (c[a : a + TILE] for c in left)
        near = (low - xo.max() <= RADIUS) & (xo.min() - high <= RADIUS)
        near &= ~((xl[0] == xl[-1]) & (right[3][starts] == xl[0]) & (right[3][ends - 1] == xl[0]))
        if same:
            near &= starts >= a
        if seen is not None:
            seen[0] += int(near.sum())
            seen[1] += int((starts >= a).sum() if same else len(starts)) - int(near.sum())
        for b, e in zip(starts[near].tolist(), ends[near].tolist(), strict=True):
            ys, yp, yq, yl, _ = (c[b:e] for c in right)
            hit = np.bitwise_count(xp[:, None] ^ yp) + np.bitwise_count(xq[:, None] ^ yq) <= RADIUS
            if not hit.any():
                continue
            hit &= (xl[:, None] != yl) & (DENOMINATOR * np.minimum(xs[:, None], ys) >= NUMERATOR * np.maximum(xs[:, None], ys))
            if hit.any():
                yield a, b, hit


def _sides(n, fp, fq, label, second):
    """Places and columns of both sides, by label and bit count; one side if ``second`` is None.

    Labels of one row stand first, by bit count alone.
    """
    ones = np.bitwise_count(fp).astype(np.int64) + np.bitwise_count(fq)
    _, place, count = np.unique(label, return_inverse=True, return_counts=True)
    order = np.where(count[place] > 1, place + 1, 0)
    out = []
    for pick in (np.ones(len(n), bool),) if second is None else (~second, second):
        k = np.flatnonzero(pick)
        k = k[np.lexsort((ones[k], order[k]))]
        out.append((k, tuple(c[k] for c in (n, fp, fq, label, ones))))
    return out


def candidate_forest(n: np.ndarray, fp: np.ndarray, fq: np.ndarray, label: np.ndarray, second: np.ndarray | None, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges by place of a spanning forest of the candidates in one group, or between its ``second`` rows and the others."""
    sides = _sides(n, fp, fq, label, second)
    every = np.concatenate([k for k, _ in sides])
    moved, roots = spanning(len(every), 0 if second is None else len(sides[0][0]), candidate_tiles(sides[0][1], sides[-1][1], second is None, seen))
    return every[moved], every[roots]


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, by products of their incidence."""
    sizes = np.array([len(s) for s in (*left, *right)])
    _, at, n = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    owner, often = np.repeat(np.arange(len(sizes)), sizes), n[at] > 1
    column = np.cumsum(n > 1) - 1
    owner, column = owner[often], column[at[often]]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        here = (column >= first) & (column < first + COLUMNS)
        m = np.zeros((len(sizes), min(COLUMNS, int(column.max()) + 1 - first)), np.float32)
        m[owner[here], column[here] - first] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def similar_forest(sets: list[np.ndarray], n: np.ndarray, fp: np.ndarray, fq: np.ndarray, label: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Edges by place of a spanning forest of the pairs of different labels whose whole sets are similar.

    Of each tile with candidates either those pairs are intersected one by one, or all at once.
    """
    sides = _sides(n, fp, fq, label, second)
    (left, x), (right, y) = sides[0], sides[-1]

    def tiles():
        for a, b, hit in candidate_tiles(x, y, second is None):
            rows, cols = left[a : a + hit.shape[0]], right[b : b + hit.shape[1]]
            i, j = np.nonzero(hit)
            if len(i) > DENSE * hit.size * (1 + int(n[rows].sum() + n[cols].sum()) / 65536):
                shared = shared_counts([sets[k] for k in rows], [sets[k] for k in cols])[i, j]
            else:
                shared = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(rows[i].tolist(), cols[j].tolist(), strict=True)])
            found = np.zeros_like(hit)
            found[i, j] = DENOMINATOR * shared >= NUMERATOR * (n[rows[i]] + n[cols[j]] - shared)
            if found.any():
                yield a, b, found

    every = np.concatenate([k for k, _ in sides])
    moved, roots = spanning(len(every), 0 if second is None else len(left), tiles())
    return every[moved], every[roots]


def in_groups(groups: DataFrame, split: int, forest) -> DataFrame:
    """u, v: the nodes that ``forest`` ties in each group of (key, node, n, fp, fq, label, ...)."""
    more = groups.columns[6:]

    def compare(cols, spans):
        us, vs = [], []
        for a, b in spans:
            if b - a < 2:
                continue
            _, i, j, second, node, n, fp, fq, label, *rest = (c[a:b] for c in cols)
            u, v = forest(*rest, n, fp.view(np.uint64), fq.view(np.uint64), label, None if i[0] == j[0] else second.astype(bool))
            us.append(node[u])
            vs.append(node[v])
        if us and sum(map(len, us)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    dealt = deal(groups, ["key"], "node", split).select("key", "i", "j", "second", "node", "n", "fp", "fq", "label", *more)
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(by_group(3, compare), "u long, v long").distinct()


def marked(docs: DataFrame, hashes: DataFrame, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose text's hash may be in ``hashes`` (row_hash).

    A bitmap of the hashes' last bits is broadcast, as rows of 64 bits: at most 2 to the MOST_BITS
    bits, whatever the number of hashes, so no text is shuffled. What it lets through besides is
    left to the caller.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (hashes.count() * BITS_A_ROW).bit_length()))
    place = lambda c: F.pmod(c, F.lit(1 << bits))
    words = hashes.groupBy(F.shiftright(place(F.col("row_hash")), 6).alias("__word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(row_hash, {1 << bits}L) & 63 as int))")).alias("__bits"))
    words = write_back(words, "shingle-bitmap")
    p = place(F.xxhash64(text_col))
    found = docs.join(F.broadcast(words), F.shiftright(p, 6) == F.col("__word"))
    return found.where(F.expr("__bits").bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{text_col}`), {1 << bits}L) & 63 as int))")) != 0).select(*own_columns(docs))


def whole_sets(nodes: DataFrame, docs: DataFrame, rows: DataFrame, text_col: str, words: int, seed: int) -> DataFrame:
    """node, s: the whole sets of the given nodes, from one text of each."""
    hashes = write_back(rows.join(nodes, "node").groupBy("node").agg(F.min("row_hash").alias("row_hash")), "shingle-wanted")
    texts = marked(docs.select(text_col), hashes, text_col).select(F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"))

    def run(stream):
        from xxhash import xxh64_intdigest

        for batch in stream:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in batches(texts, 500_000):
                sets = [shingle_set(t, words, seed) for t in texts[a:b]]
                node = np.array([xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(node), _lists(sets)], ["row_hash", "node", "s"])

    # One row of each node: of rows with a text in common one is taken.
    sets = texts.mapInArrow(run, "row_hash long, node long, s array<long>").join(hashes, ["node", "row_hash"], "left_semi")
    return write_back(sets.groupBy("node").agg(F.any_value("s").alias("s")), "shingle-sets")


def confirmed(pairs: DataFrame, docs: DataFrame, rows: DataFrame, text_col: str, words: int, seed: int) -> DataFrame:
    """u, v: the pairs (u, v) whose whole sets are similar."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    sets = whole_sets(wanted, docs, rows, text_col, words, seed)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    both = both.select("u", "v", (F.size("a") + F.size("b")).alias("n"), F.size(F.array_intersect("a", "b")).alias("shared"))
    found = write_back(both.where(DENOMINATOR * F.col("shared") >= NUMERATOR * (F.col("n") - F.col("shared"))).select("u", "v"), "shingle-links")
    forget(sets)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, row_hash, label (the component's smallest node) and component_id (its smallest id) of every row."""
    rows = write_back(with_nodes(docs, id_col, text_col, words, seed), "shingle-rows")
    nodes = write_back(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("fq").alias("fq"), F.min("part").alias("part")), "shingle-nodes")
    keyed = nodes.select("node", F.explode("part").alias("key"))
    # Most shingles stand in one set; the others' groups are all that is compared.
    hubs = write_back(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("hub")).where("k > 1").select("key", "hub"), "shingle-groups")
    met = keyed.join(hubs, "key").join(nodes.select("node", "n", "fp", "fq"), "node")
    shared = write_back(met.select("key", "hub", "node", "n", "fp", "fq"), "shingle-shared")
    own = shared.where("node <> hub").select("node", "n", "fp", "fq", "hub").distinct().alias("a")
    first = own.join(shared.where("node = hub").select("node", "n", "fp", "fq").distinct().alias("b"), F.expr("a.hub = b.node")).where(_candidates("a", "b"))
    tried = write_back(first.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct(), "shingle-pairs")
    edges = confirmed(tried, docs, rows, text_col, words, seed)
    label = components(edges)
    named = shared.join(label, "node", "left").select("key", "node", "n", "fp", "fq", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    open_ = named.join(write_back(mixed, "shingle-mixed"), "key", "left_semi")
    trees = write_back(in_groups(open_, SPLIT, candidate_forest), "shingle-trees")
    forget(shared, hubs)
    if not trees.isEmpty():
        cluster = write_back(components(trees).select("node", F.col("label").alias("key")), "shingle-clusters")
        cluster = cluster.union(cluster.select(F.col("key").alias("node"), "key").distinct())
        of = nodes.select("node", "n", "fp", "fq").join(cluster, "node").join(label, "node", "left").select("key", "node", "n", "fp", "fq", F.coalesce("label", "node").alias("label"))
        of = of.join(whole_sets(cluster.select("node"), docs, rows, text_col, words, seed), "node").select("key", "node", "n", "fp", "fq", "label", "s")
        label = components(edges.union(in_groups(of, SPLIT_SETS, similar_forest)))
    every = write_back(nodes.select("node", "rep").join(label, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label")), "shingle-labels")
    least = every.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = every.join(least, "label").select("node", "label", "component_id")
    return rows.select("doc_id", "row_hash", "node").join(found, "node").select("doc_id", "row_hash", "label", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, seed: int = 42) -> DataFrame:
    """One row of each component, that with the smallest id, with the columns of ``docs``."""
    return keep_first(docs, near_duplicates(docs, id_col, text_col, words, seed), id_col, text_col)
