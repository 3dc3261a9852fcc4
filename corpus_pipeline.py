"""A corpus pipeline of five operators: judge, deduplicate, decontaminate, redact, pack.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the
stage before kept.  All but the last return the columns of ``documents``,
whatever else they hold.

Null text counts as empty in every stage, is masked to itself, and is packed as
its end id.  Rows with a null doc_id, very long texts and repeated rows are
documents like others; equal rows are copies, of which one stays.  An empty
table gives empty results.  A stage states its own ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import decontam, packing, pii, quality, simhash
from kinfold.llm.common import settle, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the classifier rejects go.  It learns from all labels."""
    return quality.reject(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), F.lit(True))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each near-duplicate class stays, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents contaminated with benchmark passages go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def without_identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: personal data, plain or disguised, is masked in the text."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the documents as pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal_data", without_identifiers),
    ("packing", packed),
]

#: The classifier and the tokenizer can't be expressed in SQL; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
