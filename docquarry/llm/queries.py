"""The registered queries of this subpackage: thin calls of the operators with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_documents
from .common import crc_mod, table
from .compression_bands import compression_bands
from .cross_entropy import cross_entropy_difference, learn_pair
from .gam_quality import AdditiveModel, learn_quality, score_quality
from .jaccard_join import jaccard_components
from .nn_descent import nearest
from .oracles import ORACLE_SQL as ORACLE_SQL  # the other queries are held against brute-force versions in tests/llm
from .packing import best_fit_packing
from .ppm_language import PPM, identify_languages, learn_languages
from .sharding import byte_shards
from .substring_dedup import repeated_spans

Query = Callable[[SparkSession, str], DataFrame]


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(table(spark, sf_dir, "documents"))


def language_model(docs: DataFrame) -> PPM | None:
    return learn_languages(docs, crc_mod(docs["doc_id"], 3) != 1)


def rounded(name: str) -> Column:
    """Sums of doubles depend on their order in the last digits."""
    return F.round(name, 6).alias(name)


def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, language_model(docs))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", rounded("score"), rounded("bits_per_byte"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)


def op5_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that ``labels`` marks as good."""
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = cross_entropy_difference(docs, learn_pair(docs, good))
    return found.select("doc_id", "n_tokens", *[rounded(c) for c in ("target_loss", "background_loss", "score")])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


def quality_model(docs: DataFrame, labels: DataFrame) -> AdditiveModel:
    return learn_quality(docs, labels, crc_mod(labels["doc_id"], 5) != 0)


def op7_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_quality(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_compression_bands": op1_compression_bands,
    "op2_ppm_language": op2_ppm_language,
    "op3_nn_descent": op3_nn_descent,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_cross_entropy": op5_cross_entropy,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_gam_quality": op7_gam_quality,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_byte_shards": op10_byte_shards,
}

