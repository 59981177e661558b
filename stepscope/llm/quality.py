"""Quality: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities.

Every word (A-Z folded) is hashed to one of ``1 << BITS`` places. A place has a fixed sparse random index vector; its context
vector is the sum of the index vectors of the words up to two places before and after it, over all documents. Each task sums a
table of fixed size; the tables are added in two steps in Spark, so no step holds more than a bounded number of them.
The normalised word vectors have a fixed size (``PLACES * SIZE`` floats, 6 MB) and are broadcast.

A document is pooled as mean and deviation of its word vectors and of the likeness of each word to the one before, with its
length. The network is fitted in one task on at most ``most`` labelled rows; a fifth of them is kept aside to choose the
temperature by which its outputs are divided.

Defined cases: null and empty texts pool to zeros; without usable labels every score is 0.5; repeated rows score alike; an
empty table gives no rows. Only ``keep`` columns go through, so other names cannot clash.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import in_one_task, sample
from .store import stored
from .words import U, mixed, slices, words_of

BITS, SIZE = 16, 24
PLACES = 1 << BITS
BLOCK = 1024  # places a row of the added tables holds
FAN, LEVELS = 64, 4  # tables of at most FAN tasks are added at once; enough for FAN ** LEVELS tasks
REACH = 2
MOST = 16_000
STRETCH = 1 << 16
FEATURES = 2 * SIZE + 3


def index_vectors() -> np.ndarray:
    """Four entries of +1 or -1 in each place's vector, fixed by the place."""
    at = mixed(np.arange(PLACES * 4, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(7)).reshape(PLACES, 4)
    out = np.zeros((PLACES, SIZE), np.float32)
    for k in range(4):
        out[np.arange(PLACES), (at[:, k] >> U(1)) % U(SIZE)] += np.where(at[:, k] & U(1), 1.0, -1.0)
    return out


def places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = words_of(column, lower=True)
    return (words.hash >> U(64 - BITS)).astype(np.int64), words.row, words.counts


def add_contexts(table: np.ndarray, index: np.ndarray, place: np.ndarray, row: np.ndarray) -> None:
    """Add the neighbours' index vectors to the places' context vectors."""
    for a in range(0, len(place), STRETCH):
        b = min(a + STRETCH, len(place))
        total = np.zeros((b - a, SIZE), np.float32)
        for gap in (*range(-REACH, 0), *range(1, REACH + 1)):
            lo, hi = max(a, -gap), min(b, len(place) - gap)
            if lo < hi:
                near = index[place[lo + gap:hi + gap]]
                near[row[lo + gap:hi + gap] != row[lo:hi]] = 0
                total[lo - a:hi - a] += near
        order = np.argsort(place[a:b], kind="stable")
        own = place[a:b][order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        table[own[first]] += np.add.reduceat(total[order], first, axis=0)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Normalised context vectors of all places, from all documents."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, table = index_vectors(), np.zeros((PLACES, SIZE), np.float32)
        for batch in batches:
            for piece in slices(batch, "text"):
                place, row, _ = places(piece.column("text"))
                add_contexts(table, index, place, row)
        used = [b for b in range(0, PLACES, BLOCK) if table[b:b + BLOCK].any()]
        if used:
            yield pa.record_batch({"block": pa.array([b // BLOCK for b in used], pa.int32()),
                                   "task": pa.array([TaskContext.get().partitionId()] * len(used), pa.int32()),
                                   "total": pa.array([table[b:b + BLOCK].tobytes() for b in used], pa.binary())})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float32) for x in rows["total"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"block": rows["block"][:1], "task": rows["task"][:1] // FAN, "total": [total.astype(np.float32).tobytes()]})

    schema = "block int, task int, total binary"
    parts = docs.select("text").mapInArrow(gather, schema)
    for _ in range(LEVELS):
        parts = parts.groupBy("block", F.floor(F.col("task") / FAN).cast("int").alias("_share")).applyInPandas(added, schema)
    table = np.zeros((PLACES, SIZE), np.float32)
    for block, _, total in stored(parts).collect():  # PLACES rows of the table in all
        table[block * BLOCK:(block + 1) * BLOCK] = np.frombuffer(total, np.float32).reshape(-1, SIZE)
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    place, row, counts = places(column)
    n = len(counts)
    total, square, like = np.zeros((n, SIZE)), np.zeros((n, SIZE)), np.zeros((n, 2))
    for a in range(0, len(place), STRETCH):
        b = min(a + STRETCH, len(place))
        v, r = vectors[place[a:b]], row[a:b]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        total[r[first]] += np.add.reduceat(v, first, axis=0)
        square[r[first]] += np.add.reduceat(v * v, first, axis=0)
        lo = max(a, 1)
        near = np.einsum("ij,ij->i", vectors[place[lo:b]], vectors[place[lo - 1:b - 1]]) * (row[lo:b] == row[lo - 1:b - 1])
        like[:, 0] += np.bincount(row[lo:b], near, minlength=n)
        like[:, 1] += np.bincount(row[lo:b], near * near, minlength=n)
    size = np.maximum(counts, 1)[:, None]
    mean = total / size
    return np.hstack([mean, np.sqrt(np.maximum(square / size - mean * mean, 0)), like / size, np.log1p(counts)[:, None] / 10])


@dataclass(frozen=True)
class Network:
    """Standardised inputs, one hidden layer, temperature."""
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the logistic loss; rows come in hash order, so the last fifth is a random part for the temperature."""
    cut = max(1, len(x) * 4 // 5)
    mean, scale = x[:cut].mean(0), x[:cut].std(0) + 1e-6
    data, rng = (x[:cut] - mean) / scale, np.random.default_rng(seed)
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(cut)
        for at in np.array_split(order, max(1, cut // 128)):
            a, t = data[at], y[at]
            h = np.maximum(a @ p[0] + p[1], 0)
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t) / len(at)
            back = np.outer(g, p[2]) * (h > 0)
            grads = [a.T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], np.array([g.sum()])]
            step += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                p[i] = p[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    aside, truth = (x[cut:], y[cut:]) if len(x) > cut else (x, y)
    logits = net.logits(aside)
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    loss = [np.mean(np.logaddexp(0, -logits / t) * truth + np.logaddexp(0, logits / t) * (1 - truth)) for t in grid]
    return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), float(grid[int(np.argmin(loss))]))


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    network: Network | None

    def scores(self, column: pa.Array) -> np.ndarray:
        return np.full(len(column), 0.5) if self.network is None else self.network.probability(pooled(column, self.vectors))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", most: int = MOST) -> Model:
    """Word vectors from all documents; the network from labelled ones for which ``usable`` (over the labels) holds."""
    vectors = word_vectors(docs)
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                x = pooled(piece.column("text"), held.value)
                yield pa.record_batch({"doc_id": piece.column("doc_id"), "place": piece.column("place"), "label": piece.column("label"),
                                       "features": pa.array([r.tobytes() for r in x], pa.binary())})

    def learn(rows: pa.Table) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(rows["features"].to_pylist())).reshape(-1, FEATURES)
        net = train(x, rows["label"].to_numpy().astype(float))
        parts = [np.atleast_1d(np.asarray(a, float)) for a in (net.mean, net.scale, net.w1, net.b1, net.w2, net.b2, net.temperature)]
        return pa.record_batch({"part": pa.array(range(len(parts)), pa.int32()), "values": pa.array([a.ravel().tobytes() for a in parts], pa.binary())})

    rows = sample(docs, labels, label, usable, most).mapInArrow(pool, "doc_id bigint, place bigint, label int, features binary")
    parts = {part: np.frombuffer(values) for part, values in in_one_task(rows, learn, "part int, values binary").collect()}
    if not parts:
        return Model(vectors, None)
    hidden = len(parts[3])
    return Model(vectors, Network(parts[0], parts[1], parts[2].reshape(-1, hidden), parts[3], parts[4], float(parts[5][0]), float(parts[6][0])))


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score``, the calibrated probability of label 1, of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in names], pa.array(held.value.scores(piece.column("text")))], [*names, "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, f"{fields}, score double")


def predict(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
