"""Corpus pipeline over the documents table: five stages, each over all rows its predecessor kept.

Each stage is written as Parquet to the shared folder and read again, so that a lost executor costs no earlier stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.llm import decontaminate, langid, linedup, mixing, simhash
from evenhand.llm.common import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the corpus declares; others go."""
    return langid.keep_identified(docs, declared="lang", host="source")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted, and documents of which nothing is left. ``n_chars`` follows the text."""
    out = linedup.dedup_lines(docs, removed="removed_lines")
    out = out.where(~((F.size("removed_lines") > 0) & (F.trim("text") == "")))
    return out.select(*[F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else c for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return simhash.dedup(docs, shingle=3, max_bits=2)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no ten words in a row of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"), size=10)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents once for each epoch in which the mix takes them, with the epoch."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language ID", language), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated), ("mixing sources", mixed),
]
#: Components and trained text models are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus from ``documents``. The folder of the run is deleted when Spark's JVM ends."""
    shared_dir(spark)
    sc = spark.sparkContext
    folder = f"{sc.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
