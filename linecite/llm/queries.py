"""The operators over their whole tables, with production parameters, under the contract's names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from linecite.llm import (
    decontaminate,
    divergence,
    graph_search,
    language_id,
    licenses,
    pii,
    quality,
    segment_sampling,
    simhash,
    suffix_dedup,
    vector_codes,
    vector_dedup,
    warc,
)
from linecite.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs, licenses.train(docs))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``text`` is what remains, a cut inside a character showing as a replacement character."""
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    remaining = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", remaining)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_sampling.encode_samples(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"), pii.train(spark))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_components(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, benchmark)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_pii": op4_pii,
    "op5_language_id": op5_language_id,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_quality": op7_quality,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_graph_search": op11_graph_search,
    "op12_source_divergence": op12_source_divergence,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}

LLM_ORACLES: dict[str, str] = {
    "op8_warc": """WITH p AS (
        SELECT page_id, strlen(coalesce(html, '')) AS size, sha256(coalesce(html, '')) AS digest
        FROM pages),
      f AS (SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first
            FROM p)
      SELECT page_id, size AS payload_bytes, digest AS payload_digest,
             CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
             CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op12_source_divergence": divergence.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
