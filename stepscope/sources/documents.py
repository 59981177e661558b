"""Splitting of JSON trace documents: many tasks read one document, each cutting whole events out of its byte range.

A byte range does not tell whether it begins inside a string. So each range is first summarised for every state it may begin in (outside a
string, inside, inside after a backslash): the state it ends in, how the nesting depth changes, and how many objects open at each depth. The
summaries of a document are small and are composed in order, which gives each range its state and depth, and the number of events before it.
Then ranges cut the objects that open at the depth of the event list, reading past their end for the last one. Work per byte is a few vector
operations; a task holds a few chunks and one event. Event texts are parsed by Spark.

A document that ends inside its event list keeps the events before its end and is told to be cut; what follows the list is not judged.

Compressed documents cannot be entered in the middle; each is cut by one task in the same way, as a stream.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

CHUNK = 4 << 20
SPLIT = 64 << 20
LISTS = ("traceEvents", "events")  # the list under the first name is preferred
OUTSIDE, INSIDE, ESCAPED = range(3)
QUOTE, BACKSLASH, OPEN_OBJECT = ord('"'), ord("\\"), ord("{")
CHANGE = np.zeros(256, np.int8)
CHANGE[[ord("{"), ord("[")]] = 1
CHANGE[[ord("}"), ord("]")]] = -1
BLANK = b" \t\r\n"
STRING = re.compile(rb'"(?:[^"\\]|\\.)*"', re.S)


def open_file(path: str):
    """A file that can be read from any place. Arrow's file systems take local, object-store and HDFS paths."""
    system, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return system.open_input_file(inner)


def structure(data: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and bytes of the brackets outside strings, from the state before the data; and the state after it."""
    raw = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(raw == QUOTE)
    slash = raw == BACKSLASH
    tail = 0  # backslashes at the end
    if state == ESCAPED or slash.any():
        other = np.where(slash, -1, np.arange(len(raw)))
        last = np.concatenate([[-1], np.maximum.accumulate(other)])  # last[i]: the last byte before i that is no backslash
        run = quotes - 1 - last[quotes] + ((last[quotes] < 0) & (state == ESCAPED))
        quotes = quotes[run % 2 == 0]
        tail = int(len(raw) - 1 - last[-1] + (last[-1] < 0 and state == ESCAPED))
    at = np.flatnonzero(CHANGE[raw])
    inside = state != OUTSIDE
    at = at[(np.searchsorted(quotes, at) + inside) % 2 == 0]
    ends_inside = (len(quotes) + inside) % 2 == 1
    return at, raw[at], (ESCAPED if tail % 2 else INSIDE) if ends_inside else OUTSIDE


@dataclass
class Summary:
    """What a range does to a document, for one state it may begin in; depths are relative to its start."""
    state: int
    depth: int = 0
    least: int = 0
    opened: dict[int, int] = field(default_factory=dict)

    def add(self, data: bytes) -> None:
        _, signs, self.state = structure(data, self.state)
        if len(signs):
            after = self.depth + np.cumsum(CHANGE[signs], dtype=np.int64)
            depths, counts = np.unique(after[signs == OPEN_OBJECT] - 1, return_counts=True)
            for depth, n in zip(depths.tolist(), counts.tolist()):
                self.opened[depth] = self.opened.get(depth, 0) + n
            self.depth, self.least = int(after[-1]), min(self.least, int(after.min()))


class Cutter:
    """Cuts the objects that open at one depth out of successive chunks."""

    def __init__(self, state: int, depth: int, level: int):
        self.state, self.depth, self.level = state, depth, level
        self.parts: list[bytes] | None = None  # of the object that is open
        self.closed = False  # the list has ended

    def feed(self, data: bytes, until: int | None = None) -> Iterator[bytes]:
        """Objects that end in the chunk; none that begins at ``until`` or later, or after the list."""
        at, signs, self.state = structure(data, self.state)
        after = self.depth + np.cumsum(CHANGE[signs], dtype=np.int64)
        ended = np.flatnonzero(after < self.level)
        stop = int(ended[0]) if len(ended) else len(at)
        starts = at[:stop][(signs[:stop] == OPEN_OBJECT) & (after[:stop] == self.level + 1)]
        ends = at[:stop][(CHANGE[signs[:stop]] < 0) & (after[:stop] == self.level)] + 1
        if len(after):
            self.depth = int(after[-1])
        self.closed |= len(ended) > 0
        if self.parts is not None:
            cut = ends[:1]
            self.parts.append(data[:int(cut[0])] if len(cut) else data)
            if len(cut):
                yield b"".join(self.parts)
                self.parts = None
        if until is not None:
            starts = starts[starts < until]
        place = np.searchsorted(ends, starts, side="right")
        for start, k in zip(starts.tolist(), place.tolist()):
            if k < len(ends):
                yield data[start:int(ends[k])]
            elif not self.closed:
                self.parts = [data[start:]]


class Source:
    """Bytes of a stream, with what was looked at put back."""

    def __init__(self, stream):
        self.stream, self.text, self.place, self.ended = stream, b"", 0, False

    def more(self) -> bool:
        """Append another chunk; false at the end or where a compressed stream breaks."""
        try:
            data = self.stream.read(CHUNK)
        except (OSError, EOFError, pa.ArrowInvalid):
            data = b""
        self.ended = not data
        self.text += data
        return not self.ended

    def skip(self, n: int) -> None:
        self.text, self.place = self.text[n:], self.place + n

    def sign(self, blank: bytes = BLANK) -> bytes:
        """The next byte that is not blank, which stays; empty at the end."""
        while True:
            left = self.text.lstrip(blank)
            self.skip(len(self.text) - len(left))
            if left or not self.more():
                return self.text[:1]

    def key(self) -> str | None:
        """The string that comes next, taken out; None if there is no whole one."""
        while not (found := STRING.match(self.text)):
            if not self.more():
                return None
        self.skip(found.end())
        try:
            return json.loads(found[0])
        except ValueError:
            return None

    def past_value(self) -> None:
        """Skip the value that comes next, however long, up to the comma or bracket after it."""
        state, depth = OUTSIDE, 0
        while True:
            at, signs, after = structure(self.text, state)
            depths = depth + np.cumsum(CHANGE[signs], dtype=np.int64)
            below = np.flatnonzero(depths < 0)
            end = int(at[below[0]]) if len(below) else None
            commas = _outside(self.text, b",", state)
            level = np.concatenate([[depth], depths])[np.searchsorted(at, commas)] if len(commas) else commas
            commas = commas[level == 0]
            if len(commas) and (end is None or commas[0] < end):
                end = int(commas[0])
            if end is not None:
                self.skip(end)
                return
            state, depth = after, int(depths[-1]) if len(depths) else depth
            self.skip(len(self.text))
            if not self.more():
                return


def _outside(data: bytes, sign: bytes, state: int) -> np.ndarray:
    """Places of a byte outside strings."""
    masked = np.frombuffer(data, np.uint8).copy()
    masked[CHANGE[masked] != 0] = 0
    masked[masked == sign[0]] = OPEN_OBJECT
    return structure(masked.tobytes(), state)[0]


def head(source: Source) -> tuple[int, int] | None:
    """Place after the bracket of the event list and the depth inside it; (0, 0) if the document is one event, None if it is no document."""
    sign = source.sign()
    if sign == b"[":
        return source.place + 1, 1
    if sign != b"{":
        return None
    source.skip(1)
    found = None
    while (sign := source.sign(BLANK + b",")) == b'"':
        name = source.key()
        if name is None or source.sign(BLANK + b":") == b"":
            break
        if name in LISTS and source.sign() == b"[":
            if name == LISTS[0]:
                return source.place + 1, 2
            found = found or (source.place + 1, 2)
        source.past_value()
    return found or (0, 0)


def compressed(path: str) -> bool:
    return path.endswith(".gz")


def stream_of(path: str):
    file = open_file(path)
    return pa.CompressedInputStream(file, "gzip") if compressed(path) else file


def plan(files: DataFrame, split_bytes: int) -> DataFrame:
    """``path, part, begin, until, level`` for the ranges of ``path, size`` files; compressed ones have one, others none without a list."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, size in zip(batch["path"], batch["size"]):
                if compressed(path):
                    rows.append((path, 0, 0, size, -1))
                    continue
                with open_file(path) as file:
                    found = head(Source(file))
                begin, level = found if found else (0, -2)
                cuts = range(begin, max(size, begin + 1), split_bytes) if level > 0 else [begin]
                rows += [(path, i, a, min(a + split_bytes, size) if level > 0 else size, level) for i, a in enumerate(cuts)]
            yield pd.DataFrame(rows, columns=["path", "part", "begin", "until", "level"])

    return files.select("path", "size").repartition("path").mapInPandas(run, "path string, part int, begin bigint, until bigint, level int")


def summaries(ranges: DataFrame) -> DataFrame:
    """A row per range and state it may begin in: the state it ends in, its change and least depth, and objects opened by depth."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, part, begin, until in zip(batch["path"], batch["part"], batch["begin"], batch["until"]):
                states = [Summary(s) for s in ((OUTSIDE,) if part == 0 else (OUTSIDE, INSIDE, ESCAPED))]
                with open_file(path) as file:
                    file.seek(begin)
                    for at in range(begin, until, CHUNK):
                        data = file.read(min(CHUNK, until - at))
                        for s in states:
                            s.add(data)
                rows += [(path, part, first, s.state, s.depth, s.least, list(s.opened), list(s.opened.values())) for first, s in enumerate(states)]
            yield pd.DataFrame(rows, columns=["path", "part", "first", "state", "depth", "least", "depths", "counts"])

    return ranges.filter("level > 0").repartition("path", "part").mapInPandas(
        run, "path string, part int, first int, state int, depth bigint, least bigint, depths array<bigint>, counts array<bigint>")


def composed(ranges: DataFrame, found: DataFrame) -> DataFrame:
    """Ranges with the state and depth they begin in, the number of events before them, whether the list has ended before, and whether the
    document ends inside its list (told of its last range). A document has as many rows here as ranges."""
    schema = "path string, part int, begin bigint, until bigint, level int, state int, depth bigint, before bigint, ended boolean, cut boolean"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, depth, before, ended, out = OUTSIDE, int(rows["level"].iloc[0]), 0, False, []
        options = {(r.part, r.first): r for r in rows.itertuples()}
        parts = sorted(set(rows["part"]))
        for part in parts:
            r = options[part, state]
            entered = (state, depth, before, ended)
            ended = ended or depth + r.least < r.level
            before += dict(zip(r.depths, r.counts)).get(r.level - depth, 0)
            state, depth = r.state, depth + r.depth
            cut = part == parts[-1] and not ended
            out.append((r.path, part, r.begin, r.until, r.level, *entered, cut))
        return pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    return ranges.join(found, ["path", "part"]).groupBy("path").applyInPandas(run, schema)


def cut_events(ranges: DataFrame) -> DataFrame:
    """``path, ord, text`` of each event; a null text stands for a document that cannot be read, or not to its end."""
    def events(path: str, begin: int, until: int, level: int, state: int, depth: int, ended: bool, cut: bool) -> Iterator[bytes | None]:
        if level < 0 and not compressed(path):
            yield None
        elif compressed(path) or level == 0:
            yield from streamed(path)
        elif not ended:
            yield from ranged(path, begin, until, Cutter(state, depth, level))
        if cut:
            yield None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                texts: list[bytes | None] = []
                size, ord_ = 0, r["before"]
                for text in events(*[r[c] for c in ("path", "begin", "until", "level", "state", "depth", "ended", "cut")]):
                    texts.append(text)
                    size += len(text or b"")
                    if size > CHUNK:
                        yield lines(r["path"], ord_, texts)
                        ord_, texts, size = ord_ + len(texts), [], 0
                if texts:
                    yield lines(r["path"], ord_, texts)

    def lines(path: str, ord_: int, texts: list[bytes | None]) -> pa.RecordBatch:
        return pa.record_batch({"path": pa.array([path] * len(texts)), "ord": pa.array(range(ord_, ord_ + len(texts)), pa.int64()),
                                "text": pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts], pa.string())})

    return ranges.repartition("path", "part").mapInArrow(run, "path string, ord bigint, text string")


def ranged(path: str, begin: int, until: int, cutter: Cutter) -> Iterator[bytes]:
    """Events that begin in a range."""
    with open_file(path) as file:
        file.seek(begin)
        at = begin
        while not cutter.closed and (at < until or cutter.parts is not None):
            data = file.read(CHUNK)
            if not data:
                return
            yield from cutter.feed(data, until - at)
            at += len(data)


def streamed(path: str) -> Iterator[bytes | None]:
    """Events of a document that is read from its start: one that is compressed, or that is one event."""
    with stream_of(path) as stream:
        found = head(Source(stream))
    if found is None:
        yield None
        return
    with stream_of(path) as stream:
        source = Source(stream)
        while source.place < found[0] and (source.text or source.more()):
            source.skip(min(len(source.text), found[0] - source.place))
        cutter = Cutter(OUTSIDE, found[1], found[1])
        open_ = True
        while open_:
            yield from cutter.feed(source.text)
            source.skip(len(source.text))
            open_ = source.more()
        if not (cutter.closed or (found[1] == 0 and cutter.depth == 0 and cutter.state == OUTSIDE)):
            yield None


def split_documents(files: DataFrame, split_bytes: int = SPLIT) -> DataFrame:
    """``path, ord, text`` of the events of ``path, size`` files."""
    ranges = materialize(plan(files, split_bytes))
    whole = ranges.filter("level <= 0").selectExpr("*", "0 AS state", "0L AS depth", "0L AS before", "false AS ended", "false AS cut")
    return cut_events(composed(ranges, summaries(ranges)).unionByName(whole))


def reread(files: DataFrame) -> DataFrame:
    """``path, ord, text`` of the events of some documents, each streamed by one task; for the few that a reader could not parse."""
    return cut_events(files.selectExpr("path", "0 AS part", "0L AS begin", "0L AS until", "0 AS level", "0 AS state", "0L AS depth", "0L AS before",
                                       "false AS ended", "false AS cut"))


def listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, size`` of the files under some paths, without reading them."""
    return spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
