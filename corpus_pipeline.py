"""From raw documents to packed training sequences, each stage over all that the last one kept.

Near-duplicates are taken by exact five-word shingle similarity, with SimHash tiles as the comparison; the
other stages have the parameters of their queries. Every stage's result is written to the shared folder
and read again.

Odd rows: every stage takes null texts, languages, sources and ids, repeated rows, empty tables and extra
columns of any name, and returns the columns it got (the last one its pieces). What becomes of such rows
is said at each stage.
"""

from __future__ import annotations

from siftline.functions.tables import table
from siftline.llm import importance, mixing, packing, quality_rules, shingles
from siftline.plans.storage import write_back


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def quality_classifier(spark, docs, sf_dir):
    """Drops the documents that importance resampling doesn't draw.

    A null or wordless text has weight 0 and is drawn or not by its noise; rows that share id and text go
    together; without labels every weight is 0 and all rows stay.
    """
    return importance.keep_good(docs, table(spark, sf_dir, "labels"))


def rules(spark, docs, sf_dir):
    """Drops the documents that fail the base rules or stray from their language's histograms.

    Null and short texts fail the base rules; a null or unknown language is judged by characters only;
    repeated rows get one verdict.
    """
    return quality_rules.keep_good(docs)


def near_dedup(spark, docs, sf_dir):
    """Keeps one document of each component of five-word shingle similarity from 0.8, that with the smallest id.

    Null and wordless texts are one component; rows with a null id stay only where no other row of their
    component has an id; of repeated rows one stays.
    """
    return shingles.keep_one(docs)


def mix_sources(spark, docs, sf_dir):
    """Repeats or leaves out documents, so that each source meets its target.

    Null sources are one source, last in order; documents without words weigh nothing; rows that share id
    and text share their copies out.
    """
    return mixing.apply(docs)


def pack_windows(spark, docs, sf_dir):
    """Packs what is left into windows of 1024 tokens; a null text is its end token alone, each copy a document of its own."""
    return packing.pack(docs, _tokenizer(), "leads", end_id=0, size=1024, max_chunks=120_000)  # its workers also hold the other stages' modules


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Tokenising and hashed models are beyond SQL; tests/llm compares a small run with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_back(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
