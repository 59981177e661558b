"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Sources, ordered by code point (null last), take the weights in turn. A budget of words is shared by weight. Sources
whose share exceeds ``max_epochs`` times their own size are clamped there and the excess is shared again by weight among
the others, until no share is above its cap. A source's target is met by whole repetitions of all its documents and one
seeded fractional repetition: documents in the order of a seeded hash are taken until the target is reached; the last of
them gives only its first words. So the words taken from a source are its target, rounded.

No source is gathered in one task: sizes are partial aggregates, hash order is cut into about sqrt(n) buckets of sqrt(n)
documents a source, and only the bucket in which the fractional repetition ends is put in order.

Defined cases: null text has size 0; a null source is a source of its own; a source of size 0 has target 0; repeated
doc_ids are separate rows; an empty table gives no rows. Other columns, whatever their names, are kept by :func:`mixed_documents`
and not read by :func:`mix`.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

WORD = r"[^\x20\x09-\x0D]+"
RANGE = 1 << 32


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_place(doc_id: Column, seed: int) -> Column:
    """Seeded place of a document in [0, 2**32)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """What the plan reads of each document."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash_place(F.col("doc_id"), seed).alias("_place"))


def ordinals(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Number rows from 0 in a global order: range partitions, ranks inside them, and offsets of the partitions."""
    ranged = stored(df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    return (ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
            .join(offsets, "_part").withColumn(name, F.col("_base") + F.col("_rank")).drop("_part", "_base", "_rank"))


def targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """``source, n_docs, source_size, weight, cap, target`` by water-filling; ``sizes`` as from :func:`sized`."""
    per_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_ordinal") % len(weights) + 1).cast("int")).cast("long")
    sources = stored(ordinals(per_source, F.col("source").asc_nulls_last(), "_ordinal")
                     .select("source", "n_docs", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap")))
    budget = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    clamped, rest, open_weight = 0, budget, 0
    while True:  # each round clamps at least one more source, or ends
        share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(open_weight or 1))
        above = F.lit(False) if not open_weight else share > F.col("cap")
        n, cap, left = sources.agg(F.count_if(above), F.sum(F.when(above, F.col("cap")).otherwise(0)),
                                   F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if open_weight and n == clamped:
            break
        clamped, rest, open_weight = n, budget - (cap or 0), left or 0
        if not open_weight:
            break
    target = F.when(above, F.col("cap").cast("double")).otherwise(share) if open_weight else F.col("cap").cast("double")
    return sources.withColumn("target", target)


def plan(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """One row per source with what each of its documents has to know."""
    per_source = stored(targets(sizes, weights, max_epochs)
                        .withColumn("_goal", F.least(F.round("target").cast("long"), F.col("cap")))
                        .withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("_goal") / F.greatest("source_size", F.lit(1)))).otherwise(0))
                        .withColumn("_whole", F.col("_whole").cast("long"))
                        .withColumn("_rest", F.col("_goal") - F.col("_whole") * F.col("source_size"))
                        .withColumn("_buckets", F.ceil(F.sqrt("n_docs")).cast("long")))
    buckets = with_plan(sizes, per_source.select("source", "_rest", "_buckets")).groupBy("source", "_bucket", "_rest").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = (buckets.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
            .filter("_before < _rest AND _rest <= _before + _sum").select("source", F.col("_bucket").alias("_last"), "_before"))
    planned = per_source.alias("a").join(last.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    return planned.select("a.*", F.coalesce("_last", F.lit(-1)).alias("_last"), F.coalesce("_before", F.lit(0)).alias("_before"))


def with_plan(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Attach the plan of its source to each row, and the row's bucket."""
    right = per_source.withColumnRenamed("source", "_source")
    bucket = F.floor(F.col("_place") * F.col("_buckets") / F.lit(float(RANGE))).cast("long")
    return rows.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_bucket", bucket)


def apply_plan(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``_whole`` (whole repetitions) and ``_part`` (words of the fractional one) of each row with ``source, size, _place``."""
    placed = with_plan(rows, per_source)
    sure = placed.filter("_bucket <> _last").withColumn("_part", F.when(F.col("_bucket") < F.col("_last"), F.col("size")).otherwise(0).cast("long"))
    before = Window.partitionBy("source").orderBy("_place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_rest") - F.col("_before") - F.coalesce(F.sum("size").over(before), F.lit(0))
    edge = placed.filter("_bucket = _last").withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))
    return sure.unionByName(edge)


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, whole, part, taken``; ``taken = whole * size + part``."""
    sizes = stored(sized(docs, seed))
    return apply_plan(sizes, stored(plan(sizes, weights, max_epochs))).select(
        "doc_id", "source", "size", "source_size", "target", F.col("_whole").alias("whole"), F.col("_part").alias("part"),
        (F.col("_whole") * F.col("size") + F.col("_part")).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its nth word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it came with. The text is not shuffled."""
    per_source = stored(plan(stored(sized(docs, seed)), weights, max_epochs))
    rows = docs.select(F.struct("*").alias("_doc"), "doc_id", "source", word_count(F.col("text")).alias("size"), hash_place(F.col("doc_id"), seed).alias("_place"))
    taken = apply_plan(rows, per_source)
    copies = taken.withColumn("_copies", F.col("_whole") + F.when(F.col("_part") > 0, 1).otherwise(0)).filter("_copies > 0")
    each = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    cut = (F.col("_copy") > F.col("_whole")) & (F.col("_part") < F.col("size"))
    text = F.when(cut, first_words(F.col("_doc.text"), F.col("_part"))).otherwise(F.col("_doc.text"))
    changed = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return each.select(*[changed.get(c, F.col("_doc").getField(c).alias(c)) for c in docs.columns])
