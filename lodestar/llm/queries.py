"""The subpackage's queries by name, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import importable
from . import bagminhash, exact_dedup, hilbert_packing, html_extract, interp_lm, piece_codec, projection_neardup, toxicity, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The installed file of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_projection_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_neardup.classes(table(spark, sf_dir, "embeddings"))


def op2_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(table(spark, sf_dir, "pages"))


def op6_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interp_lm.score(table(spark, sf_dir, "documents"))


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_projection_neardup,
        op2_hilbert_packing,
        op3_toxicity,
        op4_exact_dedup,
        op5_warc,
        op6_url_language_models,
        op7_html_extract,
        op8_interpolated_lm,
        op9_bagminhash,
        op10_piece_codec,
    )
}

ORACLE_SQL = {
    "op4_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
        ), k AS (
            SELECT doc_id, sha256(body) AS text_sha256,
                   min(doc_id) OVER (PARTITION BY body) AS keep_id,
                   count(*) OVER (PARTITION BY body) AS group_size,
                   row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) AS place
            FROM d
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM k
    """,
    "op5_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS place,
                   min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
        ), r AS (SELECT *, strlen(body) >= 100 AND place > 1 AND first_id IS NOT NULL AS again FROM p)
        SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to FROM r
    """,
}
