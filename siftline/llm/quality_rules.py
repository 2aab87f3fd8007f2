"""Quality rules by distribution divergence (native DataFrame code).

Two histograms are taken of every document: its characters by class, and its words over the
common words of its language, which are learned from the documents: those that stand most
often between blanks in all of the language's texts. Each is compared with the language's reference by the
Jensen-Shannon distance (base 2, so 0 to 1). A document is dropped if a distance is above its
limit; documents under the minimum lengths are not judged by it, since a histogram of a few
words says nothing.

References: first the mean histogram of a language's documents that are long enough and pass
the base rules, then the mean of those near the first (by wider limits), so that junk
doesn't shape what it is measured by.

Base rules: at least 20 words, and at most 30 % of the words in 8-word windows that occur
twice or more in the text.

Nulls and odd rows: a null text has no words and fails the base rules; a language is its
code's first part in lower case (``de-DE`` is ``de``); a null or odd one, or one without a
reference, is compared with the mean over all languages, by characters only, and has a null word
distance; each row is judged by itself, so repeated rows get equal verdicts; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.plans.storage import write_back

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: Guards: below these a histogram is not judged.
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 200, 60
#: Limits of the Jensen-Shannon distances, and those within which documents shape the reference.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.18, 0.28
SHAPING_CHAR_DISTANCE, SHAPING_WORD_DISTANCE = 0.27, 0.34
#: Common words of a language, and letters of the longest one.
N_COMMON, MAX_LETTERS = 16, 4
#: Shares are summed as integers, so that a reference doesn't depend on the order of rows.
SCALE = 1_000_000_000

# Character classes by Java pattern, taken out in this order.
CLASSES = (r"\p{Ll}+", " +", r"\n+", r"\p{Lu}+", r"\p{Nd}+", r"[.,;:'\"()\-]+", "[!?]+", r"[#*$%&|<>]+")


def _without(text: Column, chars: str) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), chars, text)


def language(lang: Column) -> Column:
    """The first part of a language code in lower case; null if it isn't two or three letters."""
    code = F.lower(F.regexp_extract(lang.cast("string"), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.when(code != "", code)


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """ref, list: the N_COMMON most frequent words of each language over all its texts, in that order.

    There are at most as many languages as codes of three letters.
    """
    words = docs.select(language(F.col(lang_col)).alias("ref"), F.explode(F.split(F.replace(F.col(text_col), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.where(F.col("ref").isNotNull() & F.length("w").between(1, MAX_LETTERS)).groupBy("ref", "w").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("n"), "w"))
    top = counts.where(F.col("w").rlike(r"^\p{L}+$")).withColumn("place", place).where(F.col("place") <= N_COMMON)
    return top.groupBy("ref").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "w"))), lambda x: x["w"]).alias("list"))


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, row_hash, ref (its language), the base figures and both histograms of every row."""
    lists = write_back(common_words(docs, text_col, lang_col), "rules-words")
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), language(F.col(lang_col)).alias("ref"), F.xxhash64(text_col).alias("row_hash"), text.alias("t"))
    d = d.join(F.broadcast(lists), "ref", "left")
    d = d.select("doc_id", "ref", "row_hash", "t", "list", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("*", lines.alias("ls"))
    # A word's hash is taken once; a window is the hash of its eight words' hashes.
    codes = F.transform(F.filter("w", lambda x: F.char_length(x) <= MAX_LETTERS), lambda x: F.array_position("list", x))
    d = d.select(
        "doc_id", "ref", "row_hash", "t", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h1"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"), F.size("list").alias("n_listed"), F.filter(codes, lambda c: c > 0).alias("hits"),
    )
    first = F.slice("h1", F.lit(1), F.greatest(F.size("h1") - F.lit(WINDOW - 1), F.lit(0)))
    h8 = F.transform(first, lambda x, i: F.xxhash64(x, *(F.get("h1", i + k) for k in range(1, WINDOW))))
    d = d.select(*(c for c in d.columns if c != "h1"), h8.alias("h8"))
    d = d.select("*", (F.size(F.array_distinct("h8")) < F.size("h8")).alias("again"))
    d = d.select("*", F.when(F.col("again"), F.sort_array(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s")).drop("h8", "again")
    twin = F.filter("s", lambda x, k: F.coalesce(F.get("s", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", k + 1)["h"] == x["h"], F.lit(False)))
    d = d.select("*", F.sort_array(F.transform(twin, lambda x: x["i"])).alias("p")).drop("s")
    gaps = F.zip_with("p", F.slice("p", F.lit(2), F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    d = d.select("*", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long")).alias("n_repeat_words")).drop("p")
    # Characters by class: each class is taken out of what the earlier ones left, so the strings get short fast.
    left = ["t"]
    for k, pattern in enumerate(CLASSES):
        less = F.replace(F.col(left[-1]), F.lit(" "), F.lit("")) if pattern == " +" else F.regexp_replace(F.regexp_replace(left[-1], "[a-z]+", "") if not k else left[-1], pattern, "")
        d = d.select("*", less.alias(f"t{k}"))
        left.append(f"t{k}")
    chars = F.array(*(F.char_length(a) - F.char_length(b) for a, b in zip(left, left[1:], strict=False)), F.char_length(left[-1]))
    # t0 has no small letters, but all blanks and symbols.
    d = d.select(
        "doc_id", "ref", "row_hash", F.col("n").cast("long").alias("n_words"),
        (F.char_length("t") - F.char_length("t0") + F.char_length(_without(F.col("t0"), BLANKS))).cast("long").alias("word_chars"),
        (F.octet_length("t0") - F.octet_length(_without(F.col("t0"), SYMBOLS))).cast("long").alias("n_symbols"),
        "n_dup_lines", "n_repeat_words", chars.alias("chars"), F.char_length("t").alias("n_chars"), "hits", "n_listed",
    )
    seen = F.transform(F.sequence(F.lit(1), F.greatest("n_listed", F.lit(1))), lambda k: F.size(F.filter("hits", lambda c: c == k)))
    return d.withColumn("common", F.when(F.col("n_listed") > 0, seen)).drop("hits", "n_listed")


def _shares(counts: Column, total: Column) -> Column:
    """Counts as shares of a total, in units of 1 / SCALE; all 0 where the total is."""
    return F.transform(counts, lambda c: F.when(total > 0, F.floor(c.cast("long") * F.lit(SCALE) / total)).otherwise(F.lit(0)).cast("long"))


def _normal(a: Column) -> Column:
    """An array of numbers divided by their sum, which is worked out once."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.array(total), lambda t: F.transform(a, lambda x: x / F.greatest(t, F.lit(1.0))))[0]


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares that sum to one; null if either is."""

    def part(x, y):
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    squared = F.aggregate(F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x)), F.lit(0.0), lambda s, x: s + x) / 2
    return F.sqrt(F.when(squared > 0, squared).otherwise(squared * 0))


def references(rows: DataFrame) -> DataFrame:
    """ref, q_char, q_word: mean histograms of each language, and by characters of all together (ref ``*``)."""
    n_char, n_word = len(CLASSES) + 1, N_COMMON + 1
    sums = [F.sum(F.get("p_char", F.lit(k))).alias(f"c{k}") for k in range(n_char)] + [F.sum(F.get("p_word", F.lit(k))).alias(f"w{k}") for k in range(n_word)]
    by_lang = rows.groupBy("ref").agg(*sums)
    refs = by_lang.where("ref is not null").unionByName(by_lang.groupBy(F.lit("*").alias("ref")).agg(*(F.sum(c).alias(c) for c in by_lang.columns[1:])))
    q_word = F.filter(F.array(*(F.col(f"w{k}").cast("double") for k in range(n_word))), lambda x: x.isNotNull())
    return refs.select("ref", _normal(F.array(*(F.col(f"c{k}").cast("double") for k in range(n_char)))).alias("q_char"), F.when((F.col("ref") != "*") & (F.size(q_word) > 0), _normal(q_word)).alias("q_word"))


def with_distances(d: DataFrame, refs: DataFrame) -> DataFrame:
    """``d`` with char_distance and word_distance; null below the minimum lengths and without a reference.

    The broadcast has a row for each language code that has documents.
    """
    own, every = refs.where("ref <> '*'"), refs.where("ref = '*'").select(F.col("q_char").alias("q_all"))
    d = d.join(F.broadcast(own), "ref", "left").join(F.broadcast(every), F.lit(True), "left")
    p_char, p_word = (F.transform(c, lambda x: x / F.lit(float(SCALE))) for c in ("p_char", "p_word"))
    char = F.when(F.col("n_chars") >= MIN_CHARS_JUDGED, _distance(p_char, F.coalesce("q_char", "q_all")))
    word = F.when(F.col("n_words") >= MIN_WORDS_JUDGED, _distance(p_word, F.col("q_word")))
    return d.withColumn("char_distance", char).withColumn("word_distance", word).drop("q_char", "q_word", "q_all")


def _within(char: float, word: float) -> Column:
    return (F.coalesce("char_distance", F.lit(0.0)) <= char) & (F.coalesce("word_distance", F.lit(0.0)) <= word)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base figures, distances and verdict of every row of ``docs``."""
    d = base_features(docs, id_col, text_col, lang_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    d = d.withColumn("p_char", _shares(F.col("chars"), F.col("n_chars")))
    words = F.concat("common", F.array(F.greatest(F.lit(0), F.col("n_words").cast("int") - F.aggregate("common", F.lit(0), lambda s, x: s + x))))
    d = d.withColumn("words", words)
    d = d.withColumn("p_word", _shares(F.col("words"), F.aggregate("words", F.lit(0), lambda s, x: s + x)))
    d = write_back(d.drop("chars", "common", "words"), "rules")
    good = d.where(~F.col("base_failed") & (F.col("n_chars") >= MIN_CHARS_JUDGED) & (F.col("n_words") >= MIN_WORDS_JUDGED))
    first = write_back(references(good), "rules-first")
    refs = write_back(references(with_distances(good, first).where(_within(SHAPING_CHAR_DISTANCE, SHAPING_WORD_DISTANCE))), "rules-references")
    d = with_distances(d, refs)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & _within(MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE)).alias("kept"), "char_distance", "word_distance", "row_hash")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns.

    Only the dropped rows' ids and hashes are joined, from a written table whose size Spark
    knows: a small one is broadcast, a large one is shuffled.
    """
    bad = write_back(judge(docs, id_col, text_col, lang_col).where(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__h")).distinct(), "rules-dropped")
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__h")), "left_anti")
