"""Quality classifier by importance resampling.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. Two generative
bag-of-n-gram models are counted: one of the target, labelled good documents, and one of the
raw text, all documents. A document's log importance weight is the sum over its n-grams of
log(target share / raw share). Documents are sampled without replacement by Gumbel top-k: seeded
Gumbel noise is added to each log weight and the k largest sums are kept.

k is the raw documents' number times the target's share among the labelled ones unless it is
given. Labelled rows used for the fit are bounded by ``max_labels``, taken by smallest hash; the raw
model, the scores and the threshold cover every document.

Nulls and odd rows: a null or wordless text has no n-grams and weight 0; labels without a
document and documents without a label are fine; without a single good label every weight is 0;
rows that share id and text are kept or dropped together; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.tables import own_columns
from siftline.llm.tokens import batches
from siftline.plans.storage import write_back

BUCKETS = 16_384
#: Labelled rows that are used at most.
MAX_LABELS = 20_000
SMOOTHING = 1.0
#: Log weights are kept to this part, so that thresholds are exact integers.
SCALE = 1_000_000
_WORDS: dict[bytes, int] = {}


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, then pairs, of each text in turn, and their number by text."""
    import xxhash

    if len(_WORDS) > 60_000:
        _WORDS.clear()
    known, hashes, counts = _WORDS, [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").split()
        found = list(map(known.get, words))
        if None in found:
            for k, h in enumerate(found):
                if h is None:
                    found[k] = known[words[k]] = xxhash.xxh32_intdigest(words[k])
        hashes += found
        counts.append(len(words))
    h = np.array(hashes, np.uint64)
    n = np.array(counts, np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    mixed = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
    mixed[h[1:] == h[:-1]] = 0  # a word said twice running is one feature, whatever the word
    inside = owner[1:] == owner[:-1]
    first = np.concatenate([h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40), mixed[inside]]) % np.uint64(BUCKETS)
    return first.astype(np.int64), np.concatenate([owner, owner[1:][inside]])


def count_grams(docs: DataFrame) -> DataFrame:
    """(text, target) -> bucket, raw, target counts over all rows. Each task sends one row a bucket."""

    def run(stream):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in stream:
            texts, good = [t or "" for t in batch.column(0).to_pylist()], np.array(batch.column(1).to_pylist(), bool)
            for a, b in batches(texts, 1_000_000):
                bucket, owner = grams(texts[a:b])
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[a:b][owner]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    return docs.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Log ratios by bucket, and the target's share among the labelled rows used."""
    used = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__l_id"), (F.col(label_col) == 1).alias("good"))
    used = write_back(used.orderBy(F.xxhash64("__l_id"), "__l_id").limit(max_labels), "labels-used")
    n, n_good = used.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0))).first()
    good = used.where("good").select("__l_id").distinct()
    # At most max_labels rows are broadcast.
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    marked = rows.join(F.broadcast(good), F.col("__id") == F.col("__l_id"), "left").select("text", F.col("__l_id").isNotNull().alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in count_grams(marked).collect():  # one row a bucket
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(BUCKETS), 1.0

    def share(x):
        return np.log((x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS))

    return share(target) - share(raw), n_good / n


def with_weights(docs: DataFrame, ratio: np.ndarray, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with __grams and __weight (log weight in units of 1 / SCALE) added."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    at = docs.columns.index(text_col)

    def run(stream):
        for batch in stream:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            n, w = [], []
            for a, b in batches(texts, 1_000_000):
                bucket, owner = grams(texts[a:b])
                n.append(np.bincount(owner, minlength=b - a))
                w.append(np.bincount(owner, weights=shared.value[bucket], minlength=b - a))
            n, w = (np.concatenate(x) if x else np.zeros(0) for x in (n, w))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n.astype(np.int64)), pa.array(np.rint(w * SCALE).astype(np.int64))], [f.name for f in schema])

    from pyspark.sql.types import LongType, StructField, StructType

    # Columns go by their places on the way, since their names may hold dots.
    schema = StructType([*(StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema)), StructField("grams", LongType()), StructField("weight", LongType())])
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).mapInArrow(run, schema).toDF(*docs.columns, "__grams", "__weight")


def gumbel(seed: int, *cols: str):
    """Seeded Gumbel noise of a row, in units of 1 / SCALE."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return F.round(-F.log(-F.log(u)) * SCALE).cast("long")


def kth_largest(values: DataFrame, col: str, k: int, bins: int = 4096) -> tuple[int, int]:
    """(the k-th largest value, rows above it) of an integer column, by counts of ever finer bins.

    Each round counts rows in at most ``bins`` bins and goes into the bin with rank k; nothing is sorted.
    """
    low, high = values.agg(F.min(col), F.max(col)).first()
    above = 0
    while low < high:
        width = (high - low) // bins + 1
        counts = values.where(F.col(col).between(low, high)).groupBy(F.expr(f"cast(({col} - {low}L) div {width}L as int)").alias("bin")).count().collect()
        for b, n in sorted(((r[0], r[1]) for r in counts), reverse=True):
            if above + n >= k:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            above += n
    return low, above


def top_k(scored: DataFrame, key: str, tie: str, k: int):
    """Condition that holds for the k rows largest by (key, tie); rows equal in both go together."""
    if k <= 0:
        return F.lit(False)
    edge, above = kth_largest(scored, key, k)
    at_edge = scored.where(F.col(key) == edge)
    tie_edge, _ = kth_largest(at_edge, tie, k - above)
    return (F.col(key) > edge) | (F.col(key) == edge) & (F.col(tie) >= tie_edge)


def score(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, seed: int, max_labels: int) -> tuple[DataFrame, float]:
    """All columns of ``docs`` with __grams, __weight, __key and __tie; the target's share."""
    ratio, share = fit(docs, labels, max_labels, id_col, text_col)
    scored = with_weights(docs, ratio, text_col)
    return scored.withColumn("__key", F.col("__weight") + gumbel(seed, id_col, text_col)).withColumn("__tie", F.xxhash64(F.lit(seed + 1), id_col, text_col)), share


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, k: int | None = None, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, n_grams, log_weight, key and kept of every row; texts are scored once."""
    scored, share = score(docs.select(id_col, text_col), labels, id_col, text_col, seed, max_labels)
    rows = write_back(scored.select(F.col(id_col).alias("doc_id"), "__grams", "__weight", "__key", "__tie"), "importance")
    kept = top_k(rows, "__key", "__tie", round(share * rows.count()) if k is None else k)
    return rows.select("doc_id", F.col("__grams").alias("n_grams"), (F.col("__weight") / SCALE).alias("log_weight"), (F.col("__key") / SCALE).alias("sampling_key"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, k: int | None = None, max_labels: int = MAX_LABELS) -> DataFrame:
    """The sampled rows of ``docs`` with their own columns; texts are scored again rather than shuffled."""
    scored, share = score(docs, labels, id_col, text_col, seed, max_labels)
    keys = write_back(scored.select("__key", "__tie"), "importance-keys")
    kept = top_k(keys, "__key", "__tie", round(share * keys.count()) if k is None else k)
    return scored.where(kept).select(*own_columns(docs))
