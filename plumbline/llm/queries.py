"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe_codec, html_extract, media, merkle, mixing, quality, simhash, token_counts, toxicity, url_filter, vector_codes, warc, winnow
from plumbline.llm._common import materialize, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op4_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_edits(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    sized = materialize(docs, "document-sizes")
    mixed = mixing.mix(sized, size=F.col("size"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "doc.source", "draws")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_html_extract": op2_html_extract,
    "op3_token_counts": op3_token_counts,
    "op4_winnow": op4_winnow,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_media": op10_media,
    "op11_url_filter": op11_url_filter,
    "op12_vector_codes": op12_vector_codes,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict = {
    "op6_warc": """
        WITH held AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
        ), coded AS (
            SELECT page_id, octet_length(payload) AS n,
                   translate(upper(to_base(('0x' || substr(hex, 1, 15))::BIGINT, 32, 12) || to_base(('0x' || substr(hex, 16, 15))::BIGINT, 32, 12)
                             || to_base(('0x' || substr(hex, 31, 10))::BIGINT, 32, 8)),
                             '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS digest
            FROM held
        ), kept AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS keeper FROM coded)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM kept
    """,
    "op11_url_filter": """
        WITH cut AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), rules(h, p, v) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), judged AS (
            SELECT *, (SELECT max_by(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule FROM parts
        )
        SELECT page_id, host, path, rule, coalesce((SELECT v FROM rules WHERE h || p = rule), 'allow') AS verdict FROM judged
    """,
    "op12_vector_codes": vector_codes.oracle(),
    "op13_merkle_manifest": merkle.oracle(),
}
