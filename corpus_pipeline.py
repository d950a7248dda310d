"""A corpus pipeline: documents in, packed training sequences out. Each stage reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import discard, short_batches, written
from quillon.llm.ngram_join import without_near_copies
from quillon.llm.packing import pack_documents
from quillon.llm.quality import fit_quality, score_quality
from quillon.llm.secret_scan import mask_secrets
from quillon.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the label table, does not reject."""
    short_batches(spark)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where(F.col("predicted") == 0).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality scorer does not reject."""
    short_batches(spark)
    return score_quality(docs, fit_quality(docs)).where(F.col("kept") == 1).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    short_batches(spark)
    return without_near_copies(docs).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; masks keep lengths."""
    return mask_secrets(docs).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    short_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]
#: Models and iterated joins have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table, each written as Parquet and read again. What a stage has read goes once its own result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{i}")
            discard(before)
    return docs
