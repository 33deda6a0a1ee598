"""One query per operator over the whole of its table, and the same result in DuckDB's SQL where that can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, divergence, exact, jaccard, langid, packing, phrases, quality, sharding, span_dedup, token_counts, url_filter
from .shared import read

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_histogram(read(spark, sf_dir, "documents"), tokenizer_path())


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(read(spark, sf_dir, "conversations"))


def op4_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op5_url_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), url_filter.RULES)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op7_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read(spark, sf_dir, "documents"))


def op11_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


def op12_hyperdimensional_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


SQL9 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM t
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_token_counts, op3_chat_rotation, op4_virtual_slot_sharding, op5_url_bloom_cascade, op6_sentence_span_dedup, op7_attention_quality, op8_ngram_jaccard_join, op9_exact_dedup, op10_benchmark_decontamination, op11_source_divergence_audit, op12_hyperdimensional_language_id, op13_phrase_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_rotation": chat.ORACLE, "op5_url_bloom_cascade": url_filter.ORACLE, "op8_ngram_jaccard_join": jaccard.ORACLE, "op9_exact_dedup": SQL9, "op10_benchmark_decontamination": decontam.ORACLE, "op11_source_divergence_audit": divergence.ORACLE, "op13_phrase_collocations": phrases.ORACLE}
