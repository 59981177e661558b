"""Token-id matrices by best-fit-decreasing packing with a segment tree over capacities.

Documents are encoded, closed by an id and cut into segments of at most a row; whole rows stand alone. The other segments are
packed in blocks of at most ``BLOCK``, within the task that encoded them: longest first, each into the open row with the least room
that still holds it. A segment tree over room sizes finds that row in the logarithm of the row length, however many rows are open.
Memory is bounded by the block; nothing is shuffled, so copies and hot sources do not matter.

A row of the result is a row of the matrix: its ids (little endian, two bytes each if the vocabulary allows, padded), the cumulative
segment lengths that variable-length attention takes, the places at which positions start again from 0, and the document and
start of each segment, from which every document can be put together again.

Defined cases: null and empty texts are one closing id; repeated rows and doc_ids are separate segments; longer documents are split
without loss; an empty table gives no rows; columns other than doc_id and text are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .packing import id_width, token_ids
from .words import slices

ROW = 2048
BLOCK = 4096
PADDING = 0


class Rooms:
    """Open rows by room left; finds the smallest room that is large enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def put(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and number of the best row, which is taken out; None if no row has the room."""
        room = self._first(need)
        if room is None:
            return None
        self._add(room, -1)
        return room, self.rows[room].pop()

    def _add(self, room: int, change: int) -> None:
        at = self.size + room
        while at:
            self.count[at] += change
            at //= 2

    def _first(self, need: int) -> int | None:
        at = self.size + need
        while not self.count[at]:  # climb until a right neighbour holds a row
            while at & 1:
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.size:  # descend to its smallest room
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(lengths: list[int], row: int = ROW) -> list[list[int]]:
    """Items of each row, longest first; equal lengths keep their order."""
    rooms, rows = Rooms(row), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[item])
        if found is None:
            found = (row, len(rows))
            rows.append([])
        rows[found[1]].append(item)
        rooms.put(found[0] - lengths[item], found[1])
    return rows


def position_ids(cumulative: np.ndarray, row: int = ROW) -> np.ndarray:
    """Positions of a row: each segment counts from 0; padding is 0."""
    out = np.zeros(row, np.int32)
    for a, b in zip(cumulative[:-1], cumulative[1:]):
        out[a:b] = np.arange(b - a)
    return out


def matrices(docs: DataFrame, vocabulary: str = "byte_bpe_50k", row: int = ROW) -> DataFrame:
    """``sequence_id, ids, cu_seqlens, position_resets, doc_ids, starts``: one line per matrix row."""
    width, kind = id_width(vocabulary), docs.schema["doc_id"].dataType.simpleString()

    def lines(segments: list[tuple], number: int, ids_type: pa.DataType) -> pa.RecordBatch:
        out: dict[str, list] = {c: [] for c in ("sequence_id", "ids", "cu_seqlens", "position_resets", "doc_ids", "starts")}
        for k, items in enumerate(best_fit([len(s[2]) for s in segments], row)):
            ends = np.cumsum([len(segments[i][2]) for i in items]).tolist()
            ids = np.full(row, PADDING, width)
            ids[:ends[-1]] = np.concatenate([segments[i][2] for i in items])
            for name, value in (("sequence_id", number + k), ("ids", ids.tobytes()), ("cu_seqlens", [0, *ends]), ("position_resets", [0, *ends[:-1]]),
                                ("doc_ids", [segments[i][0] for i in items]), ("starts", [segments[i][1] for i in items])):
                out[name].append(value)
        types = (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(ids_type), pa.list_(pa.int64()))
        return pa.record_batch({name: pa.array(values, of) for (name, values), of in zip(out.items(), types)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, whole, parts, ids_type = TaskContext.get().partitionId() << 33, [], [], pa.int64()
        for batch in batches:
            ids_type = batch.schema.field("doc_id").type
            for piece in slices(batch, "text", 2 << 20):
                for doc, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    ids = token_ids(text, vocabulary).astype(width)
                    for start in range(0, len(ids), row):
                        (whole if len(ids) - start >= row else parts).append((doc, start, ids[start:start + row]))
                    for group, least in ((whole, 256), (parts, BLOCK)):
                        if len(group) >= least:
                            made = lines(group, number, ids_type)
                            number += made.num_rows
                            group.clear()
                            yield made
        for group in (whole, parts):
            if group:
                made = lines(group, number, ids_type)
                number += made.num_rows
                yield made

    return docs.select("doc_id", "text").mapInArrow(
        run, f"sequence_id bigint, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{kind}>, starts array<bigint>")


def write(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k", row: int = ROW) -> None:
    """Write the matrices as Parquet; an existing folder is not replaced."""
    matrices(docs, vocabulary, row).write.mode("errorifexists").parquet(path)
