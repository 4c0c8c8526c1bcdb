"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns all that goes on; run() writes it to the shared folder and reads it
again for the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pulsemart.llm import lines, minhash, outliers, packing, toxicity
from pulsemart.llm.common import shared_folder, table
from pulsemart.llm.queries import BYTE_LEVEL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return outliers.keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_shared_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, **BYTE_LEVEL)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_outliers),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("packing", pack),
]

# classifier, estimates and tokenizer are beyond SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents in sf_dir."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
