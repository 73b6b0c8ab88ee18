"""The queries of the training-data operators, as the driver's contracts name them, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagatlas.llm import bloom_lm, centroids, collocations, decontaminate, html_main, jpeg, licenses, mixing, quality, simhash, sstable, toxicity, wordpiece
from tagatlas.llm.common import remainder, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return toxicity.score(docs.select("doc_id", "text"), machine).select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op5_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = jpeg.stored(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "media")
    return jpeg.features(media).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).select("doc_id", "license_families", "n_notices", "n_unknown")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"), keep_html=False).select("page_id", "url", "text", "n_chars")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_tokens")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = remainder(F.col("doc_id"), 10)
    model = bloom_lm.train(docs.where(fold != 0))
    return bloom_lm.score(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), *bloom_lm.RESULT)


OP8_SQL = r"""
WITH docs AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
texts AS (SELECT row_number() OVER () AS t, text, w FROM (SELECT DISTINCT text, w FROM docs WHERE len(w) > 0)),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
sized AS (SELECT item, w, least(13, len(w)) AS m FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS gram FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT m FROM windows),
runs AS (SELECT t, i, m, array_to_string(w[i:i + m - 1], ' ') AS gram FROM (SELECT t, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM texts, sizes WHERE len(w) >= m)),
met AS (SELECT t, i, m, item FROM runs JOIN windows USING (m, gram)),
words AS (SELECT t, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT t, unnest(range(i, i + m)) AS pos FROM met) GROUP BY t),
found AS (SELECT t, count(DISTINCT item) AS n_items, coalesce(string_agg(DISTINCT item, ',' ORDER BY item), '') AS ids FROM met GROUP BY t),
of_text AS (SELECT text, n_hit, n_items, sha256(ids) AS sha FROM texts JOIN words USING (t) JOIN found USING (t))
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN of_text o ON d.text = o.text"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_quality, op4_mixing, op5_jpeg, op6_licenses, op7_html, op8_decontaminate, op9_sstable, op10_token_counts, op11_collocations, op12_centroids, op13_lm_scores)}


def oracle_sql() -> dict[str, str]:
    return {"op6_licenses": licenses.scan_sql(), "op8_decontaminate": OP8_SQL, "op11_collocations": collocations.collocations_sql(), "op12_centroids": centroids.cluster_sql()}
