"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbours and pairs one word apart (A-Z folded), hashed to
``1 << BITS`` places. Learning rates are per coordinate and the L1 term leaves few weights other than 0, which are
broadcast as one array of fixed size. The model is fitted in one task on at most ``most`` labelled rows; all texts are scored
whole, batch by batch.

Defined cases: null and empty texts have no features and get the score of the bias; without any usable label the bias is 0,
so every score is 0.5 and predicts 1 (:func:`fit` says so by ``n_rows`` 0); repeated rows score alike; an empty table gives
no rows. Only ``keep`` columns go through, so other names cannot clash.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import in_one_task, sample
from .words import MARKS, STEP, U, mixed, slices, words_of

BITS = 18
MOST = 16_000
SALTS = (U(0x51), U(0xA7), U(0xE3))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    n_rows: int


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and place of every feature occurrence of a text column, and the number of rows."""
    words = words_of(column, lower=True, gaps=MARKS)
    h, row = words.hash, words.row
    found = [(row, mixed(h ^ SALTS[0]))]
    for gap, salt in ((1, SALTS[1]), (2, SALTS[2])):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            found.append((row[gap:][same], mixed((h[:-gap] * STEP + h[gap:])[same] ^ salt)))
    place = np.concatenate([f[1] for f in found]) >> U(64 - BITS)
    return np.concatenate([f[0] for f in found]), place.astype(np.int64), len(words.first) - 1


def distinct(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((row << BITS) | place)
    return both >> BITS, both & ((1 << BITS) - 1)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 6, alpha: float = 2.0, beta: float = 1.0, l1: float = 10.0,
         l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights after some passes in the given order; the last place is the bias, which has no L1 term."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        strength = np.where(at == size - 1, 0.0, l1)
        return np.where(np.abs(zs) <= strength, 0.0, -(zs - np.sign(zs) * strength) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for places, y in zip(rows, labels):
            at = np.append(places, size - 1)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(size))
    return w[:-1].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", most: int = MOST) -> Model:
    """Fit on labelled documents for which ``usable`` (over the labels table) holds."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                row, place = distinct(*features(piece.column("text"))[:2])
                ends = np.searchsorted(row, np.arange(piece.num_rows + 1)).astype(np.int32)
                yield pa.record_batch({"doc_id": piece.column("doc_id"), "place": piece.column("place"), "label": piece.column("label"),
                                       "features": pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))})

    def learn(rows: pa.Table) -> pa.RecordBatch:
        flat = rows["features"].combine_chunks()
        ends, values = flat.offsets.to_numpy(), flat.values.to_numpy().astype(np.int64)
        w, bias = ftrl([values[a:b] for a, b in zip(ends[:-1], ends[1:])], rows["label"].to_numpy())
        at = np.flatnonzero(w)
        return pa.record_batch({"place": pa.array(np.append(at, [-1, -2])), "weight": pa.array(np.append(w[at].astype(float), [bias, rows.num_rows]))})

    extracted = sample(docs, labels, label, usable, most).mapInArrow(extract, "doc_id bigint, place bigint, label int, features array<int>")
    weights, bias, n = np.zeros(1 << BITS, np.float32), 0.0, 0
    for place, weight in in_one_task(extracted, learn, "place bigint, weight double").collect():
        if place >= 0:
            weights[place] = weight
        elif place == -1:
            bias = weight
        else:
            n = int(weight)
    return Model(weights, bias, n)


def scores(column: pa.Array, model: Model) -> np.ndarray:
    row, place, n = features(column)
    used = model.weights[place] != 0
    row, place = distinct(row[used], place[used])
    total = np.bincount(row, model.weights[place], minlength=n) + model.bias
    return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score``, the probability of label 1, of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in names], pa.array(scores(piece.column("text"), held.value))], [*names, "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, f"{fields}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that the model does not reject, with their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield piece.filter(pa.array(scores(piece.column("text"), held.value) < threshold))

    return docs.mapInArrow(run, docs.schema)


def predict(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
