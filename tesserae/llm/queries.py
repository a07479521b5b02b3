"""The queries of this subpackage, thin: each reads its tables, calls its operator and shapes the rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe_trie, common, embedding_dedup, packing, paragraph_dedup, quality, simhash, suffix_dedup, token_counts, toxicity, warc

#: The vocabulary of the token queries; the operators take any.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), VOCABULARY, limit=512)


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of(table(spark, sf_dir, "pages")))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_from(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return toxicity.score(docs, model, threshold=0.3).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, window=1024)


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=2)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = common.cut(quality.measures(table(spark, sf_dir, "documents")), "measures")
    return quality.quality_rules(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_embedding_near_dup,
        op3_packing,
        op4_paragraph_dedup,
        op5_simhash,
        op6_token_counts,
        op7_warc_derivatives,
        op8_bpe_round_trip,
        op9_suffix_array_dedup,
        op10_quality_rules,
    )
}

#: DuckDB SQL for those that SQL can express.
ORACLES: dict[str, str] = {"op7_warc_derivatives": warc.oracle()}
