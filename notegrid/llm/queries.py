"""The queries of the training-data operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrid.llm import chat_format, decontaminate, embedding_dedup, hard_negatives, html_extract, katz, language_id, ngram_join, packing, personal_data, secret_scan, substring_dedup, token_alignment
from notegrid.llm.common import read, tune


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return substring_dedup.dedup(read(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return decontaminate.flag(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return katz.score_held_out(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = read(spark, sf_dir, "documents")
    return secret_scan.report(docs, secret_scan.learn(docs))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return ngram_join.link(read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return embedding_dedup.dedup(read(spark, sf_dir, "embeddings"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return chat_format.format_messages(read(spark, sf_dir, "conversations"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, by rules and by a field learned from a sample of what the rules find."""
    tune(spark)
    docs = read(spark, sf_dir, "documents")
    return personal_data.report(docs, personal_data.learn(docs))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 50, against all vectors; every seventh label is moved on first."""
    tune(spark)
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two public tokenizers aligned, with a digest of its groups."""
    tune(spark)
    return token_alignment.align(read(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_benchmark_decontamination, op3_katz_backoff, op4_language_id, op5_secret_scan,
        op6_ngram_jaccard_join, op7_packing, op8_embedding_dedup, op9_html_extract, op10_chat_format, op11_personal_data, op12_hard_negatives, op13_token_alignment,
    )
}

SQL: dict[str, str] = {}

_WORDS2 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op2_benchmark_decontamination"] = f"""
WITH items AS (SELECT item_id, {_WORDS2} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, array_to_string(w[s:s+least(10, len(w))-1], ' ') AS win, least(10, len(w)) AS size
         FROM items, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS2} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM wins),
spots AS (SELECT doc_id, size, s, array_to_string(w[s:s+size-1], ' ') AS win
       FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS s) WHERE len(w) >= size),
hits AS (SELECT a.doc_id, a.s, a.size, v.item_id FROM spots a JOIN wins v ON a.win = v.win AND a.size = v.size),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + size)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""

# the given conversations hold no calls, results or tools, so that what remains is order and canonical JSON
SQL["op10_chat_format"] = """
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position, CAST(to_json({'content': coalesce(text, ''), 'role': role}) AS VARCHAR) AS message,
       CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_invalid, CAST(0 AS BIGINT) AS n_broken, 'none' AS link
FROM conversations
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL["op1_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
wins AS (SELECT doc_id, s, sha256(array_to_string(w[s:s+49], ' ')) AS win FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS s) WHERE len(w) >= 50),
first AS (SELECT win, min(doc_id) AS first FROM wins GROUP BY win),
cover AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM wins JOIN first USING (win) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS k FROM words ANTI JOIN cover USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_LOWER = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

SQL["op6_ngram_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER} AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[s:s+4], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * k >= 80 * (p.n + q.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON reach.r = edges.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

SQL["op12_hard_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
