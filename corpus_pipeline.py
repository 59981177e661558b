"""Corpus pipeline: stages over the documents table, each applying one operator to all its predecessor kept.

1. toxicity: documents that the classifier rejects go. It is fitted on the labels of the documents at hand.
2. near duplicates: of every group linked by shared shingles, the document with the smallest doc_id stays.
3. secrets: every secret span becomes a mark; all documents stay.
4. mixing: documents are repeated, cut or left out so that sources meet their target weights.
5. packing: pieces of the remaining documents with their ids, and their places in sequences.

All stages but the last return the columns of documents. Cases such as null texts are defined in each operator.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepscope.llm import mixing, packing, prefix_join, secrets, toxicity
from stepscope.llm.store import stored


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels, F.lit(True)))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return prefix_join.keep_first(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("toxicity", clean), ("near_duplicates", distinct), ("secrets", redacted), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None  # a fitted model decides in the first stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
