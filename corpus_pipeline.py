"""Corpus pipeline: toxic documents go, near-duplicates leave one, secrets are masked, sources are mixed, tokens packed.

Each stage takes (spark, docs, folder) and returns a DataFrame that is written as Parquet before the next stage reads
it. All but the last return the columns of ``documents``. No stage is expressible in SQL as a whole (hashing, learning
and rounding decide), so ``ORACLE_SQL`` is None and the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorlens.llm import chosen_path, mixing, packing, secrets, toxicity
from doorlens.llm.shared import fold, stored


def clean(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects (score of 0.5 or more)."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(fold(F.col("doc_id"), 5) != 0)
    return toxicity.drop_toxic(docs, labels)


def deduplicated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Leaves the smallest id of each class of near-duplicates."""
    return chosen_path.keep_first(docs)


def masked(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Replaces the reported secret spans."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Repeats or leaves out documents as the mix of sources takes them."""
    return mixing.repeat_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token pieces of all documents with their places in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", clean),
    ("near duplicates", deduplicated),
    ("secret scan", masked),
    ("mixing", mixed),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages on the documents of a folder; every stage's rows are stored in the shared folder."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), name.replace(" ", "_"))
    return docs
