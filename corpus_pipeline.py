"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Run it with run(spark, sf_dir). Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import decontaminate, lines, pieces, quality, simhash
from concord.llm.common import fresh, shared_dir, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier, learned from docs and labels, does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or line has; n_chars follows a changed text."""
    n_lines, n_removed = fresh(docs.columns, "_n_lines", "_n_removed")
    found = lines.dedup_lines(docs, n_lines, n_removed)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col(n_removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", n_chars)
    return found.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces, lossless): sampled piece ids, and whether they decode to the text."""
    return pieces.round_trip(docs).select("doc_id", "ids", "n_pieces", "lossless")


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("sentencepiece encoding", tokenization),
]

#: None of the stages but the fourth can be written in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's output lies in a new folder below the shared one."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
