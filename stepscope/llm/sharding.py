"""Rendezvous hashing of stable record keys over weighted shards; DataFrame functions only.

Each pair of a key and a shard has a hash, uniform in (0, 1), of the two alone. The shard with the least ``-ln(hash) / weight`` holds the
key: shards get keys in proportion to their weights, and a shard's claim on a key never depends on the other shards. So one more shard
takes keys from all others and moves none between them, and a shard that goes gives its keys away and leaves the others where they are.
A key costs one hash per shard, inside the scan; whole documents are not shuffled to be assigned or written.

Places of rows inside a shard (``slot``) are numbered by ranges of (shard, key), see :mod:`.numbering`; equal keys, equal texts and
equal rows may be any share of the table.

Defined cases: a null key is a key of its own; null text has no bytes; rows with one key go to one shard, whatever their texts; weights
of 0 or less take no keys; other columns are kept by :func:`assign` and :func:`write` and not read by :func:`places`; a column that
has the name of the new one is kept, and the new one gets underscores at its end; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import free_name, numbered
from .store import stored

HEX_DIGITS = 13  # 52 bits, which a double holds with a half added


def claim(key: Column, shard: Column, weight: Column) -> Column:
    """What a shard asks for a key; the least claim wins."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), shard.cast("string")))
    share = (F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") + 0.5) / float(1 << (4 * HEX_DIGITS))
    return -F.log(share) / weight


def holder(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that holds a key."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight above 0")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights) if w > 0])
    claims = F.transform(shards, lambda s: F.struct(claim(key, s["shard"], s["weight"]).alias("claim"), s["shard"].alias("shard")))
    return F.array_min(claims)["shard"]


def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """The rows with the number of their shard."""
    return docs.withColumn(free_name(docs, name), holder(F.col(key), weights))


def write(docs: DataFrame, path: str, weights: Sequence[float], key: str = "doc_id", name: str = "shard") -> None:
    """Write one folder per shard; tasks write the rows they read. An existing folder is not replaced."""
    column = free_name(docs, name)
    assign(docs, weights, key, name).write.mode("errorifexists").partitionBy(column).parquet(path)


def places(docs: DataFrame, weights: Sequence[float], one_more: float | None = None, key: str = "doc_id") -> DataFrame:
    """``key, size, text_crc32, shard, slot, grown_shard`` per row: size in bytes plus 1, the place in its shard by key, size and
    checksum, and the shard once another of weight ``one_more`` joins (the same one without it)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    grown = list(weights) + ([one_more] if one_more is not None else [])
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       holder(F.col(key), weights).alias("shard"), holder(F.col(key), grown).alias("grown_shard"))
    return numbered(stored(rows), ["shard"], ["doc_id", "size", "text_crc32"], "slot")
