"""Packing token sequences by minimum bin slack.

Every document is cut into whole windows and a rest shorter than a window. Only the rests have to be combined. Their lengths
form a histogram of fixed size (one count for each length below the window), so the plan is made from a bounded table,
whatever the size of the corpus: the longest length left opens a window, a subset-sum over bitsets finds the multiset of the
remaining lengths that fills it closest to capacity, its counts are traced back, and the pattern is repeated as often as the
counts allow. Each repetition uses up a length, so there are at most about as many patterns as lengths.

A pattern whose slack would exceed ``most_slack`` is not used; the rests of its longest length are laid end to end instead and
cut at window borders, the last partial window being cut into sequences of powers of two. Rests are matched with places by
their rank among rests of the same length: a running rank within a task plus an offset from one small row per task and length.
The ids are stored once and meet these rows in one join by task and length, however many rests have the same length.

Defined cases: a null text is an empty one (its only id is the closing one); repeated rows and doc_ids are packed each on
their own; texts of any length are cut; an empty table gives no rows; columns other than doc_id and text are not read.
"""
from __future__ import annotations

import base64
import json
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored
from .words import slices

WINDOW = 2048
CLOSING = 1
MOST_SLACK = 2
OUTPUT = 4 << 20  # bytes of ids returned at a time


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """Byte-level BPE over the named public vocabulary. Between added tokens it gives the ids of the ``tokenizers`` file of the
    same name, several times as fast; tests compare the two."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def added_tokens(vocabulary: str) -> dict[str, int]:
    """Tokens that the vocabulary's ``tokenizers`` file matches as they stand in a text; none without such a file."""
    import public_tokenizers

    path = public_tokenizers.path(f"{vocabulary}.json")
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError(f"added tokens of {vocabulary} that depend on their neighbours are not supported")
    return {t["content"]: t["id"] for t in tokens}


@lru_cache(maxsize=2)
def added_pattern(vocabulary: str) -> re.Pattern | None:
    tokens = sorted(added_tokens(vocabulary), key=len, reverse=True)
    return re.compile(f"({'|'.join(map(re.escape, tokens))})") if tokens else None


def id_width(vocabulary: str) -> str:
    return "<u2" if max(encoder(vocabulary).n_vocab, *[i + 1 for i in added_tokens(vocabulary).values()], 0) <= 1 << 16 else "<u4"


PIECE = 200_000  # characters encoded at a time; cut where the pre-tokeniser cuts, too


def token_ids(text: str | None, vocabulary: str) -> np.ndarray:
    """Ids of a text as unsigned 32-bit integers, with the closing id.

    Added tokens have their own ids; the text between two of them is encoded on its own. Long stretches are encoded in pieces. A
    piece ends before a single space between two letters, where the vocabulary's pattern always starts a new token, so the ids
    are those of the whole stretch.
    """
    text, marks = text or "", added_pattern(vocabulary)
    encode = encoder(vocabulary).encode_ordinary
    parts = []
    for k, stretch in enumerate(marks.split(text) if marks else [text]):  # every second one is an added token
        if k % 2:
            parts.append(np.array([added_tokens(vocabulary)[stretch]], dtype="<u4"))
            continue
        at = 0
        while at < len(stretch):
            stop = min(at + PIECE, len(stretch))
            while stop < len(stretch) and not (stretch[stop] == " " and stretch[stop - 1].isalpha() and stretch[stop + 1:stop + 2].isalpha()):
                stop += 1
            parts.append(np.array(encode(stretch[at:stop]), dtype="<u4"))
            at = stop
    return np.concatenate([*parts, np.array([CLOSING], dtype="<u4")])


def cut_documents(docs: DataFrame, vocabulary: str, window: int) -> DataFrame:
    """Ids of each document, with its place among those of its task.

    ``task, doc_id, ids`` (in two bytes each if the vocabulary allows), ``whole`` (whole windows), ``first_full`` (whole windows
    before it in the task), ``rest_length`` (ids after the whole windows) and ``rest_rank`` (rests of that length before it in the task).
    """
    width = id_width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, full, seen = TaskContext.get().partitionId(), 0, np.zeros(window, np.int64)
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                out: dict[str, list] = {c: [] for c in ("ids", "whole", "first_full", "rest_length", "rest_rank")}
                for text in piece.column("text").to_pylist():
                    ids = token_ids(text, vocabulary)
                    whole, rest = divmod(len(ids), window)
                    out["ids"].append(ids.astype(width).tobytes())
                    out["whole"].append(whole)
                    out["first_full"].append(full)
                    out["rest_length"].append(rest)
                    out["rest_rank"].append(int(seen[rest]))
                    full += whole
                    seen[rest] += 1
                n = piece.num_rows
                yield pa.record_batch({"task": pa.array([task] * n, pa.int32()), "doc_id": piece.column("doc_id"),
                                       "ids": pa.array(out["ids"], pa.binary()), "whole": pa.array(out["whole"], pa.int64()),
                                       "first_full": pa.array(out["first_full"], pa.int64()),
                                       "rest_length": pa.array(out["rest_length"], pa.int32()), "rest_rank": pa.array(out["rest_rank"], pa.int64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"task int, doc_id {kind}, ids binary, whole bigint, first_full bigint, rest_length int, rest_rank bigint")


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose sum comes closest to the capacity: length to count.

    ``reach`` holds a bit for every sum reached so far. A length's copies are added in binary portions, each portion one shift.
    The states before each portion are kept, and the best sum is traced back through them.
    """
    reach, limit, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted((n for n in counts if n <= capacity and counts[n]), reverse=True):
        left, portion = min(counts[length], capacity // length), 1
        while left:
            take = min(portion, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & limit
            left -= take
            portion *= 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


@dataclass
class Plan:
    """Where the rests of each length go, by rank.

    ``ranges[length]`` lists (first rank, per window, first sequence, offset in it); ``stream[length]`` is the first rank that is
    laid out end to end and the position of that rest in the stream, whose sequences begin at ``borders``.
    """
    ranges: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    stream: dict[int, tuple[int, int]] = field(default_factory=dict)
    sequences: int = 0
    stream_length: int = 0


def plan_rests(histogram: dict[int, int], window: int = WINDOW, most_slack: int = MOST_SLACK) -> Plan:
    """Patterns for the rests with the given counts of lengths."""
    left = {n: c for n, c in histogram.items() if n > 0 and c > 0}
    used, plan = dict.fromkeys(left, 0), Plan()
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = fill(left, window - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        slack = window - sum(n * k for n, k in pattern.items())
        if slack > most_slack:
            plan.stream[longest] = (used[longest], plan.stream_length)
            plan.stream_length += longest * left.pop(longest)
            continue
        times, offset = min(left[n] // k for n, k in pattern.items()), 0
        for n, k in sorted(pattern.items(), reverse=True):
            plan.ranges.setdefault(n, []).append((used[n], k, plan.sequences, offset))
            offset += n * k
            used[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
        plan.sequences += times
    return plan


def pieces_of(plan: Plan, length: int, rank: int, window: int) -> list[tuple[int, int, int, int]]:
    """Pieces (start in the rest, length, sequence, offset) of the rest with this length and rank."""
    if length in plan.stream and rank >= plan.stream[length][0]:
        first, base = plan.stream[length]
        at, end, out = base + (rank - first) * length, base + (rank - first + 1) * length, []
        start = at
        while at < end:
            number, begin, stop = stream_sequence(plan.stream_length, at, window)
            stop = min(stop, end)
            out.append((at - start, stop - at, plan.sequences + number, at - begin))
            at = stop
        return out
    ranges = plan.ranges[length]
    first, each, sequence, offset = ranges[bisect_right(ranges, rank, key=lambda r: r[0]) - 1]
    turn, slot = divmod(rank - first, each)
    return [(0, length, sequence + turn, offset + slot * length)]


def stream_sequence(total: int, at: int, window: int) -> tuple[int, int, int]:
    """Number, begin and end of the stream's sequence that holds a position: windows, then falling powers of two."""
    whole = total // window
    if at < whole * window:
        return at // window, at // window * window, (at // window + 1) * window
    begin, number = whole * window, whole
    while True:
        size = 1 << ((total - begin).bit_length() - 1)
        if at < begin + size:
            return number, begin, begin + size
        begin, number = begin + size, number + 1


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k", window: int = WINDOW, most_slack: int = MOST_SLACK) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers. The pieces of a sequence, by offset, are its content.
    """
    cut = stored(cut_documents(docs, vocabulary, window))
    counted = stored(cut.groupBy("task", "rest_length").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("full")))
    plan = plan_rests({r[0]: r[1] for r in counted.groupBy("rest_length").agg(F.sum("n")).collect()}, window, most_slack)
    earlier = Window.partitionBy("rest_length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counted.select("task", "rest_length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_base"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    fulls = counted.groupBy("task").agg(F.sum("full").alias("full")).select("task", F.coalesce(F.sum("full").over(before), F.lit(0)).alias("full_base"))
    held = docs.sparkSession.sparkContext.broadcast(plan)
    after = plan.sequences + plan.stream_length // window + window.bit_length()
    width, kind = id_width(vocabulary), docs.schema["doc_id"].dataType.simpleString()
    columns = ("start", "length", "doc_tokens", "sequence_id", "offset")

    def made(batch: pa.RecordBatch, doc: list[int], rows: list[tuple], ids: list[bytes]) -> pa.RecordBatch:
        values = dict(zip(columns, np.array(rows, np.int64).reshape(-1, len(columns)).T))
        return pa.record_batch({"doc_id": batch.column("doc_id").take(pa.array(doc, pa.int64())), "start": pa.array(values["start"]), "length": pa.array(values["length"]),
                                "ids": pa.array(ids, pa.binary()), **{c: pa.array(values[c]) for c in columns[2:]}})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        for batch in batches:
            doc, rows, ids, size = [], [], [], 0
            for i, (whole, full, length, rank) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("whole", "full", "rest_length", "rank")])):
                tokens = np.frombuffer(batch.column("ids")[i].as_buffer(), width)
                pieces = [(k * window, window, after + full + k, 0) for k in range(whole)]
                if length:
                    pieces += [(whole * window + a, n, sequence, offset) for a, n, sequence, offset in pieces_of(plan, length, rank, window)]
                for start, n, sequence, offset in pieces:
                    doc.append(i)
                    rows.append((start, n, len(tokens), sequence, offset))
                    ids.append(tokens[start:start + n].astype("<u4").tobytes())
                    size += 4 * n
                    if size >= OUTPUT:
                        yield made(batch, doc, rows, ids)
                        doc, rows, ids, size = [], [], [], 0
            if rows:
                yield made(batch, doc, rows, ids)

    # both tables of counts meet first, so that the ids are moved once
    numbered = (cut.join(ranks.join(fulls, "task"), ["task", "rest_length"])
                .select("doc_id", "ids", "whole", (F.col("full_base") + F.col("first_full")).alias("full"),
                        "rest_length", (F.col("rank_base") + F.col("rest_rank")).alias("rank")))
    return numbered.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
