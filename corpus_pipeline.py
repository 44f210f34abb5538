"""A training-corpus pipeline: language, boilerplate lines, near-duplicates, secrets, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, linededup, packing, secret_scan, simhash
from quire.llm.common import drop, materialize, shared_dir, table
from quire.llm.queries import vocabulary


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where that column exists."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: no letter, or a score below what held-aside rows of the language reach."""
    model = langid.train(docs.where(~langid.held_out()))
    return langid.keep(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and documents that consisted of nothing else."""
    kept = linededup.clean(docs)
    return _recounted(kept.where(F.col("text").rlike(r"\S")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints, or by a five-word Jaccard of 0.8 or more, the one with the smallest doc_id stays."""
    return simhash.keep_one(docs, similarity=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return _recounted(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secrets", secrets), ("pack", pack)]
ORACLE_SQL = None  # tested against brute force in tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is stored in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_dir(spark)
            docs = materialize(docs, path)
            if before:
                drop(spark, before)
            before = path
    return docs
