"""Substring dedup by relative Lempel-Ziv parsing against every indexed reference block.

Every document is cut into overlapping blocks, and all blocks of all documents are the reference. Blocks are cut by content:
of each window of ``window`` words, the anchor is the run of ``ANCHOR`` words with the smallest hash; the windows that share an
anchor form a block. The same window has the same anchor wherever it stands, so a document has to be parsed only against blocks
with its own anchors; the index by anchor finds all of them.

A block that occurs whole in an earlier document (smaller doc_id) is copied from the smallest such document, and runs of blocks whose
sources are equal are one factor. This is not the longest factor against one reference: a copy of a document whose first part also
stands in a smaller one is two factors. Where a block is not found whole, a factor's boundary lies
inside it: each of its windows is looked up among the windows of the blocks with that anchor. So a window is removed exactly if
it starts in an earlier document, and only words in blocks at factor boundaries are looked up one window at a time.

Only numbers are shuffled to find factors. Hot anchors, blocks and windows are first reduced to their smallest document by partial
aggregation; what looks them up is joined with one row each, and such joins can be split. Texts are shuffled twice: pruned by a
Bloom filter to look up boundary windows, and once to attach each document's own factors to it.

Equality is that of 64-bit hashes of word sequences. Defined cases: null and blank texts have no words; a null doc_id is neither
earlier nor later than any other, so nothing is removed from such a row, and it is no reference; rows with one doc_id are told
apart by their words, and neither is earlier; an empty table gives no rows. Of further columns none is read.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import PRUNE, stored
from .words import STEP, U, Words, mixed, slices, windows, words_of

WINDOW = 13
ANCHOR = 5


def text_marks(words: Words) -> np.ndarray:
    """A 31-bit hash of each row's words, which tells rows of one doc_id apart."""
    place = np.arange(len(words.hash)) - np.repeat(words.first[:-1], words.counts)
    total = np.zeros(len(words.hash) + 1, np.uint64)
    np.cumsum(mixed(words.hash + place.astype(np.uint64) * STEP), out=total[1:])
    return (mixed(total[words.first[1:]] - total[words.first[:-1]]) >> U(33)).astype(np.int64)


def blocks(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, row, first window and number of windows of every block."""
    n, size = len(words.hash), len(words.hash) - window + 1
    if size <= 0:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    whole, anchors = windows(words.hash, window), windows(words.hash, ANCHOR)
    best, at = anchors[:size].copy(), np.zeros(size, np.int64)
    for k in range(1, window - ANCHOR + 1):
        other = anchors[k:k + size]
        less = other < best
        best[less] = other[less]
        at[less] = k
    row_end = np.repeat(words.first[1:], words.counts)
    start = np.flatnonzero(np.arange(size) + window <= row_end[:size])
    place = start + at[start]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(place)))
    a, b = start[first], start[first + count - 1] if len(first) else start[first]
    row = np.searchsorted(words.first, a, side="right") - 1
    return best[a], mixed(whole[a] + STEP * whole[b] + count.astype(np.uint64)), row, a - words.first[row], count


MOST_WINDOWS = 15  # of a block, in 4 bits


def packed(mark: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Mark, first window (28 bits) and number of windows (4 bits) in one number."""
    return (mark << 32) | (start << 4) | count


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def block_index(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``anchor, block, doc_id, at`` for every block of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                words = words_of(piece.column("text"))
                anchor, block, row, start, count = blocks(words, window)
                yield pa.record_batch({"anchor": signed(anchor), "block": signed(block), "doc_id": piece.column("doc_id").take(pa.array(row)),
                                       "at": pa.array(packed(text_marks(words)[row], start, count))})

    return docs.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInArrow(run, "anchor bigint, block bigint, doc_id bigint, at bigint")


def boundary_windows(docs: DataFrame, pending: DataFrame, window: int) -> DataFrame:
    """``window, doc_id, at`` for each window of the pending blocks."""
    wanted = pending.groupBy("doc_id").agg(F.collect_list("at").alias("ats"))  # at most as long as the document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                words, ats = words_of(piece.column("text")), piece.column("ats")
                row = np.repeat(np.arange(piece.num_rows), np.diff(ats.offsets.to_numpy()))
                at = ats.flatten().to_numpy(zero_copy_only=False)
                own = (at >> 32) == text_marks(words)[row]
                row, at = row[own], at[own]
                count = at & 15
                inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                row, start = np.repeat(row, count), np.repeat((at >> 4) & ((1 << 28) - 1), count) + inside
                yield pa.record_batch({"window": signed(windows(words.hash, window)[words.first[row] + start]),
                                       "doc_id": piece.column("doc_id").take(pa.array(row)),
                                       "at": pa.array(packed(np.repeat(at >> 32, count), start, np.ones(len(row), np.int64)))})

    texts = docs.select("doc_id", "text").join(wanted, "doc_id")
    return texts.mapInArrow(run, "window bigint, doc_id bigint, at bigint")


def earlier(rows: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Attach ``source``, the smallest document with the same key.

    The smallest documents are stored first: an aggregate inside the join would tie all rows of a hot key to one task."""
    first = stored(rows.groupBy(key).agg(F.min("doc_id").alias("source")))
    return rows.join(first, key).select(*kept, "source")


def copied(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, at, source``: runs of windows that start in the earlier document ``source``, too."""
    if not ANCHOR <= window < ANCHOR + MOST_WINDOWS:
        raise ValueError(f"a window has {ANCHOR} to {ANCHOR + MOST_WINDOWS - 1} words")
    index = block_index(docs, window)
    shared = stored(index.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor"))
    candidates = stored(index.join(shared, "anchor"))
    found = stored(earlier(candidates, "block", ["anchor", "block", "doc_id", "at"]))
    whole = found.filter("source < doc_id").select("doc_id", "at", "source")
    varied = stored(candidates.groupBy("anchor").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).filter("lo <> hi").select("anchor"))
    pending = stored(found.filter("source = doc_id").join(varied, "anchor").select("doc_id", "at"))
    single = stored(boundary_windows(docs, pending, window), **PRUNE)
    return whole.unionByName(earlier(single, "window", ["doc_id", "at"]).filter("source < doc_id"))


def parse(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept`` (kept words joined by one space) and ``factors``: start, number
    of words and source of each copied span."""
    factors = copied(docs, window).groupBy("doc_id").agg(F.collect_list("at").alias("ats"), F.collect_list("source").alias("sources"))
    texts = docs.select("doc_id", "text").join(factors, "doc_id", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                words = words_of(piece.column("text"))
                marks, out = text_marks(words), {"n_words": words.counts, "n_removed": [], "kept": [], "factors": []}
                data = words.data.tobytes()
                for i, (ats, sources) in enumerate(zip(piece.column("ats"), piece.column("sources"))):
                    a, b = words.first[i], words.first[i + 1]
                    own = data[words.start[a]:words.end[b - 1]].split() if b > a else []
                    spans = merged(ats.values.to_numpy(), sources.values.to_numpy(), marks[i], window) if ats.is_valid else []
                    gone = np.zeros(len(own) + 1, np.int64)
                    for start, length, _ in spans:
                        gone[start] += 1
                        gone[start + length] -= 1
                    keep = np.cumsum(gone)[:-1] == 0
                    out["n_removed"].append(len(own) - int(keep.sum()))
                    out["kept"].append(b" ".join(compress(own, keep) if spans else own).decode())
                    out["factors"].append([{"start": s, "length": n, "source": d} for s, n, d in spans])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"], pa.string()),
                     pa.array(out["factors"], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", pa.int64())])))],
                    ["doc_id", "n_words", "n_removed", "kept", "factors"])

    return texts.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, factors array<struct<start:bigint,length:bigint,source:bigint>>")


def merged(at: np.ndarray, source: np.ndarray, mark: int, window: int) -> list[tuple[int, int, int]]:
    """Factors: runs of windows that continue in one source."""
    own = (at >> 32) == mark
    at, source = at[own], source[own]
    start = (at >> 4) & ((1 << 28) - 1)
    stop = start + (at & 15)
    out: list[list[int]] = []
    for k in np.lexsort((stop, start)):
        if out and out[-1][2] == source[k] and start[k] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(stop[k]))
        else:
            out.append([int(start[k]), int(stop[k]), int(source[k])])
    return [(a, b - a + window - 1, d) for a, b, d in out]
