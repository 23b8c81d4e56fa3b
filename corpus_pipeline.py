"""From raw documents to packed training sequences; each stage is one operator of :mod:`equiscan.llm`.

A stage takes the documents that its predecessor kept, written as Parquet and read again, and all but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiscan.llm import decontamination, jaccard_join, packing, pii, quality_classifier
from equiscan.session import broadcast_up_to, staged

#: Rejected ids that are still broadcast, 8 bytes each; beyond that documents and ids are shuffled.
BROADCAST_IDS = 5_000_000
#: A deployment passes its own secret.
PII_KEY = b"key of the registered pipeline"


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Documents whose id is not among ``rejected`` (doc_id); documents without id stay."""
    ids = broadcast_up_to(staged(rejected.select(F.col("doc_id").alias("_rejected")).distinct(), "pipeline-rejected"), BROADCAST_IDS)
    return docs.join(ids, F.col("doc_id") == F.col("_rejected"), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Of rows that share an id all go if one is rejected."""
    scores = quality_classifier.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scores.where("predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the document with the smallest id stays.

    Rows that repeat an id are copies of one document, of which one stays.
    """
    linked = staged(jaccard_join.linked_documents(docs, words=5, percent=80), "pipeline-linked")
    kept = _without(docs, linked.where("component_id < doc_id"))
    repeated = linked.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated.select(F.col("doc_id").alias("_again")), F.col("doc_id") == F.col("_again"))
    return _without(kept, repeated).union(again.drop("_again").dropDuplicates(["doc_id"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more in benchmark windows go."""
    found = decontamination.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("contaminated"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars follows the text."""
    return pii.pseudonymise(docs, PII_KEY).drop("pii_counts").withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("pii", pseudonymise),
    ("best_fit_packing", pack),
]

#: Learned scores and a tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
