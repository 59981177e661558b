"""Phrase collocations by set-oriented mining (SETM): occurrence relations, adjacent joins, group counts and semi-joins.

Texts are folded (A-Z), split into pieces at punctuation and line ends, and into words at spaces and tabs. The occurrences are a stored
relation, sorted by place: a block holds the places of about 2 MB of consecutive documents, a gap parts two pieces, and a place holds the
number of the group (language and word) that occurs there. One round per phrase length then

* joins the relation with itself at adjacent places: both sides are in order, so each block merges them by shifting one against the other;
* counts groups, inside the block first, then over all blocks in Spark, streaming through rows sorted by group;
* semi-joins the block's groups with those that are frequent, and stores the occurrences that are left as the relation of the round: the
  numbers of the block's groups, and for each place which of these it is.

A phrase of k + 1 words is a pair of frequent phrases of k words at adjacent places, so its group is a pair of two numbers whatever its
length. No group is held in memory: a hot phrase has one row per block, and the count keeps fewer than ``least`` rows before it knows the
group to be frequent. Blocks overlap by ``most_words - 1`` places, so nothing is lost where a long document is cut.

A candidate's cuts are scored ``floor(1000000 a a / (l r))`` in decimals of 38 digits (counts up to 10**15), the lowest counts. A candidate
goes if a longer frequent phrase around it has at least ``absorbed`` percent of its count; the longest such counts are those of the phrases
one word longer, so only these are met.

Defined cases: null and empty texts have no words; a null language is ``und``, together with documents of that name; repeated rows and
doc_ids count as often as they occur; texts of any length are cut into blocks; words are told apart inside a block by 64-bit hashes, between
blocks by their texts; other columns are not read; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered
from .store import drop, stored
from .words import STEP, U, mixed, slices, words_of

PLACE_BITS = 22
BLOCK = 1 << 20  # below 2**PLACE_BITS, with the overlap
TEXT = 2 << 20  # bytes of text gathered for a block; a task needs some fifty times as much
PAIRS = 1 << 16  # rows of a batch that leaves a task
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*b".,;:!?", *range(10, 14)]] = True
GAPS = BREAKS.copy()
GAPS[[32, 9]] = True
NONE = -1
# Rows of blocks are megabytes each, so few are read or passed to Python at once; numbers repeat, so they are worth compressing.
LARGE_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "8", "spark.sql.parquet.compression.codec": "zstd",
              "spark.sql.execution.arrow.maxBytesPerBatch": str(TEXT)}
OCCURRENCES = "block bigint, place int, lang string, word string, n bigint, items binary"
ADJACENT = "block bigint, place int, first bigint, second bigint, n bigint"


def places_of(texts: pa.Array, langs: pa.Array):
    """Words of some documents with, for each, its place (a gap parts two pieces) and a hash of language and word."""
    words = words_of(texts, lower=True, gaps=GAPS)
    breaks = np.concatenate([np.zeros(1, np.int32), np.cumsum(BREAKS[words.data], dtype=np.int32)])
    row = words.row
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (breaks[words.start[1:]] > breaks[words.end[:-1]])
    code = langs.dictionary_encode()
    kind = code.indices.to_numpy(zero_copy_only=False).astype(np.uint64)[row]
    return words, np.cumsum(1 + fresh.astype(np.int64)), mixed(words.hash + STEP * (kind + U(1))), code, row


def word_rows(docs: DataFrame, overlap: int) -> DataFrame:
    """Blocks of occurrences (``items``: number of the word inside the block at each place) and a row per block and distinct word."""
    def blocks(texts: pa.Array, langs: pa.Array, number: int) -> Iterator[pa.RecordBatch]:
        words, place, key, code, row = places_of(texts, langs)
        data = words.data.tobytes()
        for a in range(0, len(key), BLOCK):
            own = min(a + BLOCK, len(key)) - a
            b = min(a + BLOCK + overlap, len(key))
            item = pd.factorize(key[a:b])[0]
            at = np.flatnonzero(np.diff(np.maximum.accumulate(item), prepend=-1))  # words are numbered as they first appear
            items = np.full(place[b - 1] - place[a] + 1, NONE, np.int32)
            items[place[a:b] - place[a]] = item
            ends = np.array([place[a + own - 1] - place[a] + 1], np.int64).tobytes()  # phrases that start later belong to the next block
            spans = zip(words.start[a + at].tolist(), words.end[a + at].tolist())
            size = len(at)
            yield rows(block=pa.array(np.full(size, number)), place=pa.array(np.arange(size, dtype=np.int32)),
                       lang=code.dictionary.take(code.indices.take(pa.array(row[a + at]))),
                       word=pa.array([data[s:e] for s, e in spans], pa.binary()).cast(pa.string()),
                       n=pa.array(np.bincount(item[:own], minlength=size)))
            yield rows(block=pa.array([number], pa.int64()), items=pa.array([ends + items.tobytes()], pa.binary()))
            number += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, texts, langs, held = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for piece in slices(batch, "text", TEXT):
                texts.append(piece.column("text").cast(pa.large_string()))
                langs.append(piece.column("lang"))
                held += piece.column("text").nbytes
                if held >= TEXT:
                    for out in blocks(pa.concat_arrays(texts), pa.concat_arrays(langs), number):
                        number += out.num_rows if out.column("items").null_count == 0 else 0
                        yield out
                    texts, langs, held = [], [], 0
        if texts:
            yield from blocks(pa.concat_arrays(texts), pa.concat_arrays(langs), number)

    return docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(run, OCCURRENCES)


def rows(**columns: pa.Array) -> pa.RecordBatch:
    """A batch of occurrence rows; columns not given are null."""
    size = len(next(iter(columns.values())))
    kinds = {"block": pa.int64(), "place": pa.int32(), "lang": pa.string(), "word": pa.string(), "n": pa.int64(), "items": pa.binary()}
    return pa.record_batch({name: columns[name].cast(kind) if name in columns else pa.nulls(size, kind) for name, kind in kinds.items()})


def relation_row(own: bytes, places: int, at: np.ndarray, group: np.ndarray, number: np.ndarray) -> bytes:
    """A block's relation: how many places are its own, the numbers of its frequent groups, and which of them starts at each place. ``group``
    is the group at the places ``at``; ``number`` is that of each group, ``NONE`` if it is not frequent."""
    frequent = number != NONE
    code = np.where(frequent, np.cumsum(frequent, dtype=np.int32) - 1, NONE).astype(np.int32)
    codes = np.full(places, NONE, np.int32)
    codes[at] = code[group]
    known = number[frequent]
    return b"".join([own, np.array([len(known)], np.int64).tobytes(), known.tobytes(), codes.tobytes()])


def adjacent(items: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Merge a block's relation with itself at the next place: places of the pairs, both numbers, the groups, and how many places are its own."""
    own, size = np.frombuffer(items, np.int64, 2).tolist()
    known, code = np.frombuffer(items, np.int64, size, 16), np.frombuffer(items, np.int32, -1, 16 + 8 * size)
    at = np.flatnonzero((code[:-1] != NONE) & (code[1:] != NONE))
    group, pairs = pd.factorize((code[at].astype(np.int64) << 32) | code[at + 1])
    return at, known[pairs >> 32], known[pairs & 0xFFFFFFFF], group, own


def pair_rows(relation: DataFrame) -> DataFrame:
    """A row per block and pair of numbers at adjacent places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, items in zip(batch.column("block"), batch.column("items")):
                at, first, second, group, own = adjacent(items.as_buffer())
                n = np.bincount(group[at < own], minlength=len(first))
                for a in range(0, len(first), PAIRS):
                    b = min(a + PAIRS, len(first))
                    yield pa.record_batch({"block": pa.array(np.full(b - a, block.as_py())), "place": pa.array(np.arange(a, b, dtype=np.int32)),
                                           "first": pa.array(first[a:b]), "second": pa.array(second[a:b]), "n": pa.array(n[a:b])})

    return relation.mapInArrow(run, ADJACENT)


def frequent(found: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Group count over all blocks. Of each group that occurs ``least`` times: a row ``id, block, place`` for each block it occurs in, and
    one row with its keys and its count ``f``. The number of a group is that of its first row."""
    schema = "id bigint, block bigint, place int, lang string, word string, first bigint, second bigint, f bigint"
    kinds = {"id": pa.int64(), "block": pa.int64(), "place": pa.int32(), "lang": pa.string(), "word": pa.string(), "first": pa.int64(),
             "second": pa.int64(), "f": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of the last group; only its first row once it is known to be frequent
        sent = 0  # what the rows of that group that are already out count
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            n, change = table.column("n").to_numpy().copy(), np.zeros(table.num_rows, bool)
            if not table.num_rows:
                continue
            if sent:
                n[0] = sent
            for key in keys:
                column = table.column(key)
                change[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(change)])
            counts = np.add.reduceat(n, edge)
            number = (table.column("block").to_numpy()[edge] << PLACE_BITS) | table.column("place").to_numpy()[edge]
            lengths = np.diff(np.append(edge, len(n)))
            enough = counts >= least
            keep = np.repeat(enough, lengths)
            keep[0] &= not sent
            yield members(table, np.repeat(number, lengths), keep)
            done = np.flatnonzero(enough[:-1])
            yield totals(table, edge[done], number[done], counts[done])
            sent = int(counts[-1]) if enough[-1] else 0
            held = table.slice(edge[-1], 1) if sent else table.slice(edge[-1])
        if sent:
            number = (held.column("block").to_numpy() << PLACE_BITS) | held.column("place").to_numpy()
            yield totals(held, np.array([0]), number, np.array([sent]))

    def members(table: pa.Table, number: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
        at = pa.array(np.flatnonzero(keep))
        return batch_of({"id": pa.array(number[keep]), "block": table.column("block").take(at), "place": table.column("place").take(at)}, len(at))

    def totals(table: pa.Table, at: np.ndarray, number: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return batch_of({"id": pa.array(number), "f": pa.array(counts), **{k: table.column(k).take(pa.array(at)) for k in keys}}, len(at))

    def batch_of(columns: dict, size: int) -> pa.RecordBatch:
        arrays = {}
        for name, kind in kinds.items():
            column = columns.get(name)
            column = pa.nulls(size, kind) if column is None else column
            arrays[name] = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(kind)
        return pa.record_batch(arrays)

    # A group has at most one row per block, whatever its share of the words.
    dealt = found.select("block", "place", *keys, "n").repartition(*keys)
    return dealt.sortWithinPartitions(F.xxhash64(*keys), *keys).mapInArrow(run, schema)


def relation_of(before: DataFrame, found: DataFrame, group_of) -> DataFrame:
    """The stored relation of a round: at each place the frequent group that starts there."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "items": pa.array([], pa.binary())})
        items = left.column("items")[0].as_buffer()
        places, at, group, size = group_of(items)
        number = np.full(max(size, 1), NONE, np.int64)
        number[right.column("place").to_numpy()] = right.column("id").to_numpy()
        return pa.table({"block": left.column("block")[:1], "items": pa.array([relation_row(items[:8].to_pybytes(), places, at, group, number)], pa.binary())})

    members = found.filter("block IS NOT NULL").select("block", "place", "id")
    return before.select("block", "items").groupBy("block").cogroup(members.groupBy("block")).applyInArrow(run, "block bigint, items binary")


def _words(items: pa.Buffer) -> tuple[int, np.ndarray, np.ndarray, int]:
    item = np.frombuffer(items, np.int32, -1, 8)
    at = np.flatnonzero(item != NONE)
    return len(item), at, item[at], int(item.max(initial=0)) + 1


def _pairs(items: pa.Buffer) -> tuple[int, np.ndarray, np.ndarray, int]:
    at, first, _, group, _ = adjacent(items)
    size = int(np.frombuffer(items, np.int64, 1, 8)[0])
    return (len(items) - 16 - 8 * size) // 4, at, group, len(first)


def mine(docs: DataFrame, most_words: int = 3, least: int = 10, absorbed: int = 50) -> tuple[DataFrame, DataFrame]:
    """All candidates of 2 to ``most_words`` words that no longer phrase absorbs, ``lang, phrase, a, l, r, score``; and ``lang, n``, the
    words of each language."""
    overlap = most_words - 1
    found = stored(word_rows(docs, overlap), **LARGE_ROWS)
    vocabulary = found.filter("items IS NULL")
    n = stored(vocabulary.groupBy("lang").agg(F.sum("n").alias("n")))
    groups = stored(frequent(vocabulary, ["lang", "word"], least))
    no_counts = F.array().cast("array<bigint>")
    level = groups.filter("block IS NULL").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f",
                                                  no_counts.alias("heads"), no_counts.alias("tails"))
    levels: list[DataFrame] = []
    relation = stored(relation_of(found.filter("items IS NOT NULL"), groups, _words), **LARGE_ROWS)
    drop(found)
    for length in range(2, most_words + 1):
        groups = stored(frequent(pair_rows(relation), ["first", "second"], least), **LARGE_ROWS)
        before, relation = relation, stored(relation_of(relation, groups, _pairs), **LARGE_ROWS) if length < most_words else None
        drop(before)
        level = stored(longer(groups.filter("block IS NULL"), level))
        levels.append(level)
    kept = []
    for level, around in zip(levels, [*levels[1:], None]):
        if around is not None:
            longest = stored(around.select(F.explode(F.array("first", "second")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("_around")))
            level = level.join(longest, "id", "left").filter(f"_around IS NULL OR 100 * _around < {int(absorbed)} * f")
        kept.append(scored(level))
    candidates = kept[0]
    for more in kept[1:]:
        candidates = candidates.unionByName(more)
    return candidates, n


def longer(found: DataFrame, level: DataFrame) -> DataFrame:
    """Frequent pairs of phrases as phrases one word longer, with the counts of their first and of their last words, by number of words."""
    head = level.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("_phrase"), F.col("f").alias("_f1"), F.col("heads").alias("_heads"))
    tail = level.select(F.col("id").alias("second"), "last", F.col("f").alias("_f2"), F.col("tails").alias("_tails"))
    return (found.select("id", "first", "second", "f").join(head, "first").join(tail, "second")
            .select("id", "first", "second", "lang", F.concat_ws(" ", "_phrase", "last").alias("phrase"), "last", "f",
                    F.array_append("_heads", F.col("_f1")).alias("heads"), F.array_append("_tails", F.col("_f2")).alias("tails")))


def scored(level: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` by the cut that scores lowest, the first of equal ones."""
    exact = "decimal(15,0)"
    cuts = F.expr(f"""transform(heads, (l, i) -> named_struct(
        'score', (CAST(f AS {exact}) * CAST(f AS {exact}) * CAST(1000000 AS decimal(7,0)))
                 div (CAST(l AS {exact}) * CAST(tails[size(tails) - 1 - i] AS {exact})),
        'cut', i, 'l', l, 'r', tails[size(tails) - 1 - i]))""")
    return level.withColumn("_cut", F.array_min(cuts)).select("lang", "phrase", F.col("f").alias("a"), "_cut.l", "_cut.r", "_cut.score")


def top(docs: DataFrame, most: int = 2000, most_words: int = 3, least: int = 10, absorbed: int = 50) -> DataFrame:
    """The best ``most`` collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates are numbered over ranges of (language, score, ...), so a language that holds most of them spreads over tasks."""
    candidates, n = mine(docs, most_words, least, absorbed)
    ordered = stored(candidates.withColumn("_score", -F.col("score")).withColumn("_a", -F.col("a")))
    best = numbered(ordered, ["lang"], ["_score", "_a", "phrase"], "_rank").filter(F.col("_rank") < most)
    return best.join(n, "lang").select("lang", (F.col("_rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
