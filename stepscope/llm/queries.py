"""One registered query for each operator of this subpackage, over whole tables with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, conversations, cover_tree, lempel_ziv, mixing, multi_index, packing, prefix_join, quality, secrets, sharding, token_matrix, toxicity
from .labelled import fold
from .oracle import SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "whole", "part")


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of each document."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _classified(spark: SparkSession, sf_dir: str, module, folds: int, held_out: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = module.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), folds) != held_out)
    scored = module.predict(module.score(docs, model))
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", "predicted")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a document is toxic."""
    return _classified(spark, sf_dir, toxicity, 5, 0)


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a document is of good quality."""
    return _classified(spark, sf_dir, quality, 4, 2)


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and where they lie in the packed sequences."""
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op4_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document left without passages of earlier documents."""
    parsed = lempel_ziv.parse(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("factors").alias("n_factors"))


@query
def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth one."""
    return multi_index.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


@query
def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate vectors."""
    return cover_tree.dedup(table(spark, sf_dir, "embeddings"))


@query
def op6_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by shared shingles."""
    return prefix_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the token matrix with digests of their ids and the segments they hold."""
    rows = token_matrix.matrices(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("sequence_id", "doc_ids", "starts", "cu_seqlens", "position_resets", F.element_at("cu_seqlens", -1).alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))


@query
def op11_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of each document, and its shard once there is one more."""
    placed = sharding.places(table(spark, sf_dir, "documents").select("doc_id", "text"), [1.0] * 8, one_more=1.0)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op13_setm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best collocations of each language."""
    return collocations.top(table(spark, sf_dir, "documents").select("lang", "text"))


@query
def op12_dawg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of damaged conversations and their cheapest repair."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.report(conversations.damaged(told), told)
