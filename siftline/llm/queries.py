"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions.tables import table
from siftline.llm import html_paths, importance, media, mixing, packing, quality_rules, sharding, simhash, token_store, warc


def _tokenizer(name):
    """Path of a public tokenizer file; the folder is the installed package's."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_consensus_host_paths(spark, sf_dir):
    return html_paths.main_text(table(spark, sf_dir, "pages"))


def op2_sum_of_squares_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), "leads", end_id=0, size=1024)


def op3_importance_resampling(spark, sf_dir):
    return importance.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_tiled_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, seed=42, radius=4).select("doc_id", "fingerprint", "component_id")


def op5_seekable_token_files(spark, sf_dir):
    return token_store.store(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), "drops", end_id=1)


def op6_gzip_normaliser(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages"))


def op7_hash_tree_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.Topology.balanced(2, 2, 2))


def op8_distribution_divergence(spark, sf_dir):
    d = quality_rules.judge(table(spark, sf_dir, "documents")).drop("row_hash")
    return d.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("char_distance", "word_distance")})


def op9_subset_sum_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_baseline_jpeg(spark, sf_dir):
    return media.store(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {"pipeline": pipeline} | {f.__name__: f for f in (op1_consensus_host_paths, op2_sum_of_squares_packing, op3_importance_resampling, op4_tiled_simhash, op5_seekable_token_files, op6_gzip_normaliser, op7_hash_tree_sharding, op8_distribution_divergence, op9_subset_sum_mixing, op10_baseline_jpeg)}


def _distances_sql(name: str, refs: str) -> str:
    """CTE of (doc_id, kind, distance) of all documents that are long enough, against the references ``refs``."""
    return f"""{name} AS (SELECT doc_id, kind, sqrt(greatest(0, sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (x + q)) ELSE 0 END) / 2)) AS distance
        FROM (SELECT p.doc_id, p.kind, p.share / 1e9::DOUBLE AS x, r.q FROM p JOIN {refs} r ON r.kind = p.kind AND r.k = p.k AND r.ref = CASE WHEN p.kind = 'c' AND NOT EXISTS (SELECT 1 FROM {refs} o WHERE o.kind = 'c' AND o.ref = p.ref) THEN '*' ELSE p.ref END
              WHERE CASE p.kind WHEN 'c' THEN p.n_chars >= 200 ELSE p.n_words >= 60 END) GROUP BY 1, 2)"""


def _references_sql(name: str, rows: str) -> str:
    """CTE of (ref, kind, k, q): mean histograms of the documents that the condition ``rows`` takes."""
    return f"""{name} AS (SELECT ref, kind, k, s / sum(s) OVER (PARTITION BY ref, kind) AS q FROM (
        SELECT ref, kind, k, sum(share)::DOUBLE AS s FROM (SELECT ref, kind, k, share, doc_id FROM p WHERE {rows} AND ref IS NOT NULL UNION ALL SELECT '*', kind, k, share, doc_id FROM p WHERE {rows} AND kind = 'c') GROUP BY 1, 2, 3))"""


#: The rules from the texts alone: words, lines, windows, learned words, both histograms, references taken twice.
RULES_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, text IS NULL AS none, nullif(lower(regexp_extract(lang, '^\s*([A-Za-z]{{2,3}})(?:[-_].*)?\s*$', 1)), '') AS ref FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 6, 1))) AS i, w FROM w), gw AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM g WHERE len(w) >= 8),
    gr AS (SELECT doc_id, i FROM gw QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1), rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM gr, (SELECT unnest(range(8)) AS j) GROUP BY 1),
    b AS (SELECT w.doc_id, t, ref, w, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
          (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(t) AS n_chars FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
    f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
    tok AS (SELECT ref, unnest(string_split(replace(t, chr(10), ' '), ' ')) AS x FROM d WHERE ref IS NOT NULL AND NOT none), cnt AS (SELECT ref, x, count(*) AS n FROM tok WHERE length(x) BETWEEN 1 AND {quality_rules.MAX_LETTERS} AND regexp_full_match(x, '\p{{L}}+') GROUP BY 1, 2),
    top AS (SELECT ref, x, row_number() OVER (PARTITION BY ref ORDER BY n DESC, x) AS k FROM cnt QUALIFY k <= {quality_rules.N_COMMON}),
    cls AS (SELECT unnest(['\p{{Ll}}', ' ', '\n', '\p{{Lu}}', '\p{{Nd}}', '[.,;:''"()\-]', '[!?]', '[#*$%&|<>]']) AS c, unnest(range(8)) AS k),
    cc AS (SELECT doc_id, k, n_chars - length(regexp_replace(t, c, '', 'g')) AS n FROM f, cls), call AS (SELECT * FROM cc UNION ALL SELECT f.doc_id, 8, any_value(n_chars) - sum(n)::BIGINT FROM f JOIN cc ON cc.doc_id = f.doc_id GROUP BY 1),
    wc AS (SELECT f.doc_id, top.k - 1 AS k, len(list_filter(w, lambda y: y = top.x)) AS n FROM f JOIN top ON top.ref = f.ref), wall AS (SELECT * FROM wc UNION ALL SELECT f.doc_id, {quality_rules.N_COMMON}, greatest(0, any_value(n_words) - sum(n)::BIGINT) FROM f JOIN wc ON wc.doc_id = f.doc_id GROUP BY 1),
    ws AS (SELECT doc_id, sum(n) AS total FROM wall GROUP BY 1),
    p AS (SELECT f.doc_id, f.ref, f.base_failed, f.n_chars, f.n_words, 'c' AS kind, k, CASE WHEN n_chars > 0 THEN floor(n * 1000000000 / n_chars::DOUBLE)::BIGINT ELSE 0 END AS share FROM f JOIN call ON call.doc_id = f.doc_id
          UNION ALL SELECT f.doc_id, f.ref, f.base_failed, f.n_chars, f.n_words, 'w', k, CASE WHEN total > 0 THEN floor(n * 1000000000 / total::DOUBLE)::BIGINT ELSE 0 END FROM f JOIN wall ON wall.doc_id = f.doc_id JOIN ws ON ws.doc_id = f.doc_id),
    {_references_sql("r1", "NOT base_failed AND n_chars >= 200 AND n_words >= 60")}, {_distances_sql("d1", "r1")},
    far AS (SELECT DISTINCT doc_id FROM d1 WHERE distance > CASE kind WHEN 'c' THEN {quality_rules.SHAPING_CHAR_DISTANCE} ELSE {quality_rules.SHAPING_WORD_DISTANCE} END),
    {_references_sql("r2", "NOT base_failed AND n_chars >= 200 AND n_words >= 60 AND doc_id NOT IN (SELECT doc_id FROM far)")}, {_distances_sql("d2", "r2")}
    SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(c.distance, 0) <= {quality_rules.MAX_CHAR_DISTANCE} AND coalesce(x.distance, 0) <= {quality_rules.MAX_WORD_DISTANCE} AS kept,
        round(c.distance + 1e-9, 6) AS char_distance, round(x.distance + 1e-9, 6) AS word_distance
    FROM f LEFT JOIN d2 c ON c.doc_id = f.doc_id AND c.kind = 'c' LEFT JOIN d2 x ON x.doc_id = f.doc_id AND x.kind = 'w'"""


def oracles():
    """SQL where there is some: checksums, codecs, XXH64 and trained models are beyond it."""
    return {"op8_distribution_divergence": RULES_SQL}
