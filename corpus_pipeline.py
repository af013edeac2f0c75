"""A training-data pipeline over ``documents``: each stage calls one operator of docquarry.llm and gets, as Parquet, all
that the stage before kept.

In every stage columns besides those of ``documents`` pass through unread, repeated rows are judged alike, and an empty table
gives an empty one."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import shared_folder, table
from docquarry.llm.gam_quality import quality_udf
from docquarry.llm.jaccard_join import JoinRules, jaccard_components
from docquarry.llm.packing import best_fit_packing
from docquarry.llm.ppm_language import language_udf
from docquarry.llm.queries import language_model, quality_model
from docquarry.llm.substring_dedup import drop_repeated_spans

#: Documents with a lower quality score, or a lower posterior of their best language, go.
LEAST_QUALITY, LEAST_CERTAINTY = 0.3, 0.5
#: A text is in none of the learned languages if a byte takes so many times the bits that one of the best language's training
#: text takes, and all of its bytes so many bits more than that.
FOREIGN, FOREIGN_BITS = 4.0, 30.0
#: Near duplicates: five words, 80 percent.
NEAR = JoinRules(threshold=80, width=5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores as good. A null text is scored as the empty text; a null id teaches nothing
    and is judged like others."""
    score = quality_udf(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(docs["text"]) >= LEAST_QUALITY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: some letter, a best language that is likelier than all others together, and a code length
    that text of this language may have. Null and empty texts go; ids only choose what is learned from."""
    found, size = language_udf(docs, language_model(docs))(docs["text"]), F.octet_length(docs["text"])
    foreign = (found["bits_per_byte"] - FOREIGN * found["typical_bits"]) * size > FOREIGN_BITS
    return docs.where((found["score"] >= LEAST_CERTAINTY) & ~foreign)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that with the smallest id; of rows that repeat it, one. Rows without
    an id stay, and so do documents without text."""
    first = jaccard_components(docs, NEAR).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null")).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, without the passages that one with a smaller id holds; n_chars follows. Rows without an id and null
    texts stay as they are."""
    return drop_repeated_spans(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences; a null text packs as the empty one, a null id stays null."""
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

#: SQL has no form of the models and of packing; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
