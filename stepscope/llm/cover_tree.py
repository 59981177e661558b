"""Embedding near-dedup by dual traversal of cover trees: exact pairs above a cosine threshold.

On unit vectors, cosine >= c is distance <= sqrt(2 - 2c). Identical vectors are one point with a multiplicity. Points go to the
nearest of a few top-level centres, a net with a halved radius on a bounded sample, and each such cell is cut into blocks of about
``BLOCK`` points, so a cell of any size is spread over tasks. Each block holds a cover tree: a node's points are covered by
children with half its radius, chosen as a net, down to leaves.

Two blocks meet unless their covering balls are farther apart than the threshold. Then both trees are walked together: a pair of
nodes is dropped if even its nearest points are too far apart by the centres' distance and the covering radii, and opened otherwise;
at single points cosines are computed in double precision from the original vectors. The bound never drops a pair that links, so pairs are exact. A block pair leaves, for each of its points that links, the
number of links and a spanning edge, not the pairs.

Vectors that lie all at about the same distance from each other cannot be told apart by any bound from distances; then block pairs
grow with the square of the points, and only the work on each is small. See the README for figures.

Defined cases: null, zero and non-finite vectors and rows without id link with nothing and are kept; vectors of different length
do not link; copies link with each other; repeated ids are rows of one vector each; an empty table gives no rows.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .mixing import ordinals
from .store import stored
from .vectors import bounded_sample, matrix, usable

BLOCK = 2048
CENTRES = 64
LEAF = 48
MATRIX, PAIRS, ROWS = 4096, 1 << 15, 512
SLACK = 1e-9  # rounding of distances


@dataclass
class Tree:
    """Points in the order of the leaves; node i covers ``begin[i]:end[i]`` and has children ``first[i]:last[i]`` (none: one point)."""
    points: np.ndarray
    unit: np.ndarray
    norm: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray


def net(unit: np.ndarray, radius: float) -> list[np.ndarray]:
    """Groups of points around centres that are farther than the radius from each other; the centre comes first."""
    left, groups = np.arange(len(unit)), []
    while len(left):
        near = np.einsum("ij,j->i", unit[left], unit[left[0]]) >= 1 - radius * radius / 2
        near[0] = True
        groups.append(left[near])
        left = left[~near]
    return groups


def build(x: np.ndarray) -> tuple[Tree, np.ndarray, np.ndarray]:
    """The tree over some vectors, its nodes, and the order in which it holds the vectors."""
    norm = np.linalg.norm(x, axis=1)
    unit = x / norm[:, None]
    order: list[np.ndarray] = []
    centre, radius, begin, end, first, last = [], [], [], [], [], []
    members, at = [np.arange(len(x))], 0
    reach = [2.0]
    while at < len(members):  # breadth first: a node's children are neighbours
        own, r = members[at], reach[at]
        far = float(np.sqrt(np.maximum(0, 2 - 2 * (unit[own] @ unit[own[0]]))).max()) if len(own) > 1 else 0.0
        centre.append(own[0])
        radius.append(far)
        first.append(len(members))
        groups: list[np.ndarray] = []
        while len(own) > LEAF and far > 1e-6 and len(groups) < 2:
            r = min(r / 2, far / 2) if r > far else r / 2
            groups = net(unit[own], r)
        if not groups and len(own) > 1:
            groups = [np.array([k]) for k in range(len(own))]
        members += [own[g] for g in groups]
        reach += [r] * len(groups)
        last.append(len(members))
        at += 1
    # Leaves in depth-first order give each node one range of points.
    begin, end = [0] * len(members), [0] * len(members)
    count, stack = 0, [(0, False)]
    while stack:
        node, done = stack.pop()
        if done:
            end[node] = count
        else:
            begin[node] = count
            stack.append((node, True))
            if first[node] == last[node]:
                order.append(members[node])
                count += len(members[node])
            else:
                stack += [(c, False) for c in reversed(range(first[node], last[node]))]
    places = np.concatenate(order)
    spot = np.empty(len(x), np.int64)
    spot[places] = np.arange(len(x))
    nodes = np.array([spot[np.array(centre)], begin, end, first, last], np.int64)
    return tree_of(x[places], nodes, np.array(radius)), nodes, places


def tree_of(points: np.ndarray, nodes: np.ndarray, radius: np.ndarray) -> Tree:
    """The tree from its points in leaf order and its nodes: place of the centre, range of points, range of children."""
    norm = np.linalg.norm(points, axis=1)
    unit = points / norm[:, None]
    return Tree(points, unit, norm, unit[nodes[0]], radius, *nodes[1:])


class Links:
    """Numbers of links of the left points, and a spanning forest over both sides."""

    def __init__(self, weights: np.ndarray, left: int, right: int, same: bool):
        self.weights, self.shift, self.same = weights, 0 if same else left, same
        self.counts = np.zeros(left)
        self.back = np.zeros(right)
        self.label = np.arange(left if same else left + right)

    def add(self, rows: np.ndarray, columns: np.ndarray, left_weights: np.ndarray) -> None:
        np.add.at(self.counts, rows, self.weights[columns])
        if not self.same:
            np.add.at(self.back, columns, left_weights[rows])
        a, b = self.label[rows], self.label[columns + self.shift]
        apart = a != b
        if apart.any():
            to = {}

            def find(n: int) -> int:
                while to.get(n, n) != n:
                    n = to[n]
                return n

            for p, q in np.unique(np.stack([a[apart], b[apart]], axis=1), axis=0).tolist():
                p, q = find(p), find(q)
                if p != q:
                    to[max(p, q)] = min(p, q)
            table = np.arange(len(self.label))
            for n in to:
                table[n] = find(n)
            self.label = table[self.label]


def join(a: Tree, b: Tree, cosine: float, a_weights: np.ndarray, b_weights: np.ndarray, same: bool) -> Links:
    """Walk two trees together. ``same``: they are one tree; every ordered pair is met, points with themselves left out."""
    limit = math.sqrt(2 - 2 * cosine)
    links = Links(b_weights, len(a.points), len(b.points), same)

    def test(rows: np.ndarray, columns: np.ndarray) -> None:
        for s in range(0, len(rows), PAIRS):
            r, c = rows[s:s + PAIRS], columns[s:s + PAIRS]
            hit = np.einsum("ij,ij->i", a.points[r], b.points[c]) / (a.norm[r] * b.norm[c]) >= cosine
            hit &= ~(same & (r == c))
            links.add(r[hit], c[hit], a_weights)

    def near(n: np.ndarray, m: np.ndarray, apart: np.ndarray) -> np.ndarray:
        return apart <= a.radius[n] + b.radius[m] + limit + SLACK

    def opened(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children; a single point stands for itself."""
        alone = tree.first[nodes] == tree.last[nodes]
        return np.where(alone, nodes, tree.first[nodes]), np.where(alone, 1, tree.last[nodes] - tree.first[nodes])

    def visit(n: np.ndarray, m: np.ndarray) -> None:
        """Test pairs of points; open the other pairs, many small ones at once and large ones as matrices."""
        one = (a.end[n] - a.begin[n] == 1) & (b.end[m] - b.begin[m] == 1)
        test(a.begin[n[one]], b.begin[m[one]])
        n, m = n[~one], m[~one]
        (n, n_count), (m, m_count) = opened(a, n), opened(b, m)
        size = n_count * m_count
        large = size > MATRIX
        stack.extend(zip(n[large], n_count[large], m[large], m_count[large]))
        n, m, m_count, size = n[~large], m[~large], m_count[~large], size[~large]
        for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(size) // PAIRS)) + 1) if len(n) else []:
            of = np.repeat(part, size[part])
            k = np.arange(len(of)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            left, right = n[of] + k // m_count[of], m[of] + k % m_count[of]
            apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", a.centre[left], b.centre[right])))
            keep = near(left, right, apart)
            waiting.append((left[keep], right[keep]))

    stack, waiting = [(0, 1, 0, 1)], []
    while stack or waiting:
        if waiting:
            visit(*waiting.pop())
            continue
        n, n_count, m, m_count = stack.pop()
        for s in range(0, n_count, ROWS):  # bounded matrices
            left, right = np.arange(n + s, n + min(s + ROWS, n_count)), np.arange(m, m + m_count)
            apart = np.sqrt(np.maximum(0, 2 - 2 * (a.centre[left] @ b.centre[right].T)))
            i, j = np.nonzero(near(left[:, None], right[None], apart))
            waiting.append((left[i], right[j]))
    return links


def packed_blocks(points: DataFrame) -> DataFrame:
    """One row per block: ids, multiplicities and vectors as bytes, with centre and covering radius."""
    def pack(part: pd.DataFrame) -> pd.DataFrame:
        tree, nodes, order = build(np.stack(part["embedding"].to_list()).astype(np.float64))
        centre = tree.unit.mean(axis=0)
        centre = centre / max(np.linalg.norm(centre), 1e-12)
        return pd.DataFrame({"cell": part["cell"][:1], "sub": part["sub"][:1], "ids": [part["point"].to_numpy(np.int64)[order].tobytes()],
                             "n": [part["n"].to_numpy(np.int64)[order].tobytes()], "values": [tree.points.tobytes()], "nodes": [nodes.tobytes()],
                             "radii": [tree.radius.tobytes()], "centre": [centre.tolist()], "radius": [float(np.linalg.norm(tree.unit - centre, axis=1).max())]})

    return points.groupBy("cell", "sub").applyInPandas(pack, "cell int, sub int, ids binary, n binary, values binary, nodes binary, radii binary, centre array<double>, radius double")


def block_pairs(blocks: DataFrame, count: int, cosine: float) -> DataFrame:
    """``x, y``: numbers of the blocks whose covering balls come within the threshold, every unordered pair once."""
    balls = blocks.select("number", "centre", "radius")
    turn = F.pmod(F.col("x") + F.col("step"), F.lit(count))
    half = count // 2
    steps = balls.select(F.col("number").alias("x"), F.col("centre").alias("cx"), F.col("radius").alias("rx"), F.explode(F.sequence(F.lit(0), F.lit(half))).alias("step"))
    if count % 2 == 0 and half:  # the opposite block is met from one side only
        steps = steps.filter((F.col("step") < half) | (F.col("x") < half))
    met = steps.withColumn("y", turn.cast("int")).join(balls.select(F.col("number").alias("y"), F.col("centre").alias("cy"), F.col("radius").alias("ry")), "y")
    square = F.aggregate(F.zip_with("cx", "cy", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return met.filter(F.sqrt(square) <= F.col("rx") + F.col("ry") + F.lit(math.sqrt(2 - 2 * cosine) + SLACK)).select("x", "y")


def linked(points: DataFrame, cosine: float) -> DataFrame:
    """``point, links, edge``: for each block pair, the points that link there, their links and a point of their tree."""
    spark, found = points.sparkSession, []
    for dim, count in points.groupBy("dim").count().orderBy("dim").collect():
        own = points.filter(F.col("dim") == dim)
        sample = bounded_sample(own, "point")
        sample /= np.linalg.norm(sample, axis=1)[:, None]
        groups = sorted(net(sample, 1.0), key=len, reverse=True)[:max(1, min(CENTRES, count // BLOCK))]
        held = spark.sparkContext.broadcast(sample[[g[0] for g in groups]])

        def nearest(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("embedding"))
                cell = np.argmax(x / np.linalg.norm(x, axis=1)[:, None] @ held.value.T, axis=1) if len(x) else np.zeros(0)
                yield batch.append_column("cell", pa.array(cell, pa.int32()))

        placed = stored(own.select("point", "n", "embedding").mapInArrow(nearest, f"point bigint, n bigint, embedding {own.schema['embedding'].dataType.simpleString()}, cell int"))
        sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("subs"))  # at most CENTRES rows
        dealt = placed.join(F.broadcast(sizes), "cell").withColumn("sub", F.pmod(F.xxhash64("point"), F.col("subs")).cast("int"))
        numbered = stored(ordinals(packed_blocks(dealt), F.struct("cell", "sub"), "number").withColumn("number", F.col("number").cast("int")))
        pairs = block_pairs(numbered, numbered.count(), cosine)

        def side(name: str, numbered=numbered) -> DataFrame:
            return numbered.select(F.col("number").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("ids", "n", "values", "nodes", "radii")])

        def walk(batches: Iterator[pa.RecordBatch], dim=dim) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    def arrays(name: str, batch=batch, r=r) -> tuple[Tree, np.ndarray, np.ndarray]:
                        ids, n, x, nodes, radii = (np.frombuffer(batch.column(f"{name}_{c}")[r].as_buffer(), t) for c, t in (
                            ("ids", np.int64), ("n", np.int64), ("values", np.float64), ("nodes", np.int64), ("radii", np.float64)))
                        return tree_of(x.reshape(-1, dim), nodes.reshape(5, -1), radii), ids, n.astype(float)
                    same = batch.column("x")[r].as_py() == batch.column("y")[r].as_py()
                    a, a_ids, a_n = arrays("x")
                    b, b_ids, b_n = (a, a_ids, a_n) if same else arrays("y")
                    links = join(a, b, cosine, a_n, b_n, same)
                    ids = a_ids if same else np.concatenate([a_ids, b_ids])
                    counts = links.counts if same else np.concatenate([links.counts, links.back])
                    at = np.flatnonzero(counts)
                    yield pa.record_batch({"point": pa.array(ids[at]), "links": pa.array(counts[at].astype(np.int64)), "edge": pa.array(ids[links.label[at]])})

        found.append(pairs.join(side("y"), "y").join(side("x"), "x").mapInArrow(walk, "point bigint, links bigint, edge bigint"))
    union = found[0] if found else spark.createDataFrame([], "point bigint, links bigint, edge bigint")
    for more in found[1:]:
        union = union.unionByName(more)
    return union


def dedup(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``; ``vectors`` has ``vec_id`` and ``embedding``."""
    every = vectors.select("vec_id", "embedding")
    fit = every.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    points = stored(fit.groupBy("embedding").agg(F.min("vec_id").alias("point"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("embedding")))
    found = stored(linked(points, cosine))
    joined = components(found.select(F.col("point").alias("a"), F.col("edge").alias("b")))
    links = found.groupBy("point").agg(F.sum("links").alias("links"))
    classes = stored(points.join(links, "point", "left").join(joined.withColumnRenamed("node", "point"), "point", "left").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "point").alias("component_id")))
    good = fit.join(classes, "embedding").select("vec_id", "n_links", "component_id")
    rest = every.filter(~usable(F.col("embedding")) | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
