"""Registered queries of the text operators, each over its whole table, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (
    collocations, decontamination, hard_negatives, jaccard_join, language, line_dedup, packing, personal_data, quality,
    sentence_pieces, substring_dedup, token_files, warc,
)
from plumbline.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_token_files")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_table(spark, read_table(spark, folder, "documents"))


@query("op2_best_fit_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(read_table(spark, folder, "documents"))


@query("op3_content_defined_line_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_table(read_table(spark, folder, "documents"), line_dedup.WIDTH)


@query("op4_parity_sketch_join")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.component_table(read_table(spark, folder, "documents"))


@query("op5_bootstrapped_personal_data")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.personal_data_table(read_table(spark, folder, "documents"))


@query("op6_ngram_quality")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_table(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query("op7_revisit_resolution", sql="""
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN octet_length(encode(h)) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(h)) >= 100 AND page_id > first THEN first END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return warc.revisit_table(spark, read_table(spark, folder, "pages"))


@query("op8_suffix_tree_substring_dedup", sql="""
WITH w AS (SELECT row_number() OVER () AS k, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
     win AS (SELECT k, s, array_to_string(ws[s:s + 34], ' ') AS words
             FROM (SELECT k, ws, unnest(range(1, len(ws) - 33)) AS s FROM w WHERE len(ws) >= 35)),
     twice AS (SELECT words FROM win GROUP BY words HAVING count(*) > 1),
     gone AS (SELECT k, list_distinct(flatten(list(range(s, s + 35)))) AS places FROM win SEMI JOIN twice USING (words) GROUP BY k),
     kept AS (SELECT doc_id, len(ws) AS n_words, coalesce(len(places), 0) AS n_removed,
                     [x.word FOR x IN list_zip(ws, range(1, len(ws) + 1)) IF NOT list_contains(coalesce(places, []), x.place)] AS left_over
              FROM (SELECT * FROM w LEFT JOIN gone USING (k)))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(left_over, ' ')) AS kept_sha256 FROM kept
""".replace("x.word FOR", "x[1] FOR").replace("x.place", "x[2]"))
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeat_table(read_table(spark, folder, "documents"))


@query("op9_winnowing_decontamination")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination_table(read_table(spark, folder, "documents"),
                                               read_table(spark, folder, "benchmark"))


@query("op10_evidence_fusion_language")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_table(read_table(spark, folder, "documents"))


@query("page_language")
def page_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.page_language_table(read_table(spark, folder, "pages"))


@query("op11_strassen_hard_negatives", sql="""
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
     s AS (SELECT a.uid, a.vec_id AS anchor_id, c.uid AS other, c.vec_id AS id, a.label = c.label AS same,
                  list_inner_product(a.q, c.q)::BIGINT AS score
           FROM v AS a JOIN v AS c ON a.vec_id % 100 = 0 AND a.uid <> c.uid),
     p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, id, other) <= 5),
     n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                  row_number() OVER (PARTITION BY p.uid, p.other ORDER BY s.score DESC, s.id, s.other) AS rank
           FROM p JOIN s ON s.uid = p.uid AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negative_table(read_table(spark, folder, "embeddings"))


@query("op12_piece_encoding")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_pieces.piece_table(read_table(spark, folder, "documents"))


@query("op13_phrase_collocations", sql="""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
     grams AS (SELECT lang, k, ws[i:i + k - 1] AS g FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
                                                        FROM w, range(1, 6) AS t(k) WHERE len(ws) >= k)),
     f AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
     totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
     inside AS (SELECT DISTINCT h.lang, h.g[i:i + j - 1] AS g, h.a
                FROM f AS h, range(2, 5) AS t(j), range(1, 5) AS u(i) WHERE h.k > j AND i + j - 1 <= h.k),
     cand AS (SELECT * FROM f WHERE k >= 2 AND NOT EXISTS (
                  SELECT 1 FROM inside WHERE inside.lang = f.lang AND inside.g = f.g AND 100 * inside.a >= 100 * f.a)),
     cuts AS (SELECT c.lang, c.g, c.a, l.a AS l, r.a AS r, n, l.k AS cut,
                     ((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
              FROM cand AS c JOIN totals USING (lang)
              JOIN f AS l ON l.lang = c.lang AND l.k < c.k AND l.g = c.g[1:l.k]
              JOIN f AS r ON r.lang = c.lang AND r.k = c.k - l.k AND r.g = c.g[l.k + 1:c.k]),
     least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
       array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM least QUALIFY rank <= 2000
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read_table(spark, folder, "documents"))
