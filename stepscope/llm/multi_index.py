"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: vectors are centred and turned by ``TURNS`` rotations, each learned on a bounded sample by alternating between signs and
the orthogonal map that best fits them; the signs are the code's bits. The Hamming radius is learned on the same sample: the
distance within which ``COVERED`` of its vectors' true neighbours lie. A sample is thinner than the table, so its neighbours are
farther and the radius errs on the wide side.

Index: rows are dealt to blocks of about ``BLOCK`` rows. A block holds, for each substring of eight bits, an inverted list of its
rows by substring value. By the pigeonhole principle a code within the radius agrees with the query in some substring up to
``radius // substrings`` bits (one less in the later substrings), so each query probes just those lists; of the rows these return, those
whose whole codes lie within the radius are reranked by exact distance. Lists are built once per block. A query that finds
fewer than k rows in all blocks together meets all rows in a second pass. Tight clusters are met through few of their rows' lists; vectors
without structure, whose neighbours are hardly nearer than others, have a wide radius, and lists return most rows. Then the order of the
tests is turned round: once a query knows k rows, one matrix product per block tells which rows may be nearer than the k-th, and only these
have their codes compared and are reranked. The sample's rows give each query a first bound.

The queries, too, are cut into blocks. Index blocks are dealt to groups; every query block meets each group once, its blocks one after the
other, and leaves its k nearest there. Every row is indexed. Only the sample, the rotations and the radius pass through the driver; their
size is fixed. Work still grows with queries times rows where lists return most rows; see the README for figures.

Defined cases: null, zero and non-finite vectors and rows without id take no part; vectors whose length differs from the
queries' are compared with their like only; equal distances are ordered by id; a repeated id is excluded from its own query;
further columns are not read; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, stored
from .vectors import SAMPLE, bounded_rows, in_blocks, usable

BLOCK = 2048
QUERIES = 4096
HELD = 128 << 20  # bytes of blocks that a task holds, at most
GROUPS = 4  # of such blocks that a task meets one after the other, at most
TILE, WIDE = 256, 1024  # queries and rows scored at once
FIRST = 256  # rows that queries without a bound meet at once
FEW = 16  # lists are followed to their rows where they return at most one in so many of a block
TURNS = 4
ROUNDS = 20
STRETCH = 1 << 15  # pairs compared at once
COVERED = 0.98
ROUNDING = 8
BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)
APART = BITS_OF[np.arange(256)[:, None] ^ np.arange(256)[None]]  # bits by which two substrings differ
BLOB = ["ids", "values", "codes", "bound"]
FOUND = ["q_ids", "at", "near", "score"]
# A row of blocks is a megabyte, so few are read or passed to Python at once.
LARGE_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "4", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@dataclass(frozen=True)
class Coder:
    centre: np.ndarray
    turns: np.ndarray
    radius: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Packed codes, eight bits a byte."""
        return np.packbits((x - self.centre) @ self.turns > 0, axis=1)


def learn(x: np.ndarray, k: int, seed: int = 3) -> Coder:
    """Rotations and radius from a sample."""
    rng, centre = np.random.default_rng(seed), x.mean(axis=0)
    data, turns = x - centre, []
    for _ in range(TURNS):
        turn = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(data.T @ np.where(data @ turn > 0, 1.0, -1.0))
            turn = u @ v
        turns.append(turn)
    coder = Coder(centre, np.hstack(turns), 0)
    picked = rng.permutation(len(x))[:256]
    apart = ((x[picked] ** 2).sum(1)[:, None] + (x ** 2).sum(1)[None] - 2 * x[picked] @ x.T)
    apart[np.arange(len(picked)), picked] = np.inf
    near = np.argsort(apart, axis=1)[:, :min(k, len(x) - 1)]
    codes = coder.codes(x)
    distance = BITS_OF[codes[picked][:, None, :] ^ codes[near]].sum(axis=2) if near.size else np.zeros(1)
    return Coder(centre, coder.turns, int(np.ceil(np.quantile(distance, COVERED))))


def substring_radii(radius: int, parts: int) -> np.ndarray:
    """Bits by which a substring may differ: a code within the radius keeps to it in one substring at least."""
    whole, rest = divmod(radius, parts)
    return np.where(np.arange(parts) <= rest, whole, whole - 1)


def inverted_lists(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each substring the rows in order of its value, and where each value's rows begin."""
    order = np.argsort(codes, axis=0, kind="stable")
    begins = np.stack([np.searchsorted(codes[order[:, j], j], np.arange(257)) for j in range(codes.shape[1])], axis=1)
    return order.astype(np.uint16 if len(codes) <= 1 << 16 else np.int32), begins.astype(np.int32)


def probe(queries: np.ndarray, order: np.ndarray, begins: np.ndarray, radius: int) -> np.ndarray:
    """Candidate matrix (queries by rows): every code within the radius, and others."""
    found = np.zeros((len(queries), len(order)), bool)
    sizes = np.diff(begins, axis=0)
    for j, allowed in enumerate(substring_radii(radius, queries.shape[1])):
        at, value = np.nonzero((APART[queries[:, j]] <= allowed) & (sizes[:, j] > 0))
        size = sizes[value, j]
        entry = np.repeat(begins[value, j] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        found[np.repeat(at, size), order[entry, j]] = True
    return found


@cache
def reach(bits: int) -> np.ndarray:
    """Which substrings lie within some bits of each other."""
    return (APART <= bits).astype(np.float32)


def listed(begins: np.ndarray, radius: int) -> np.ndarray:
    """For each value of each substring of a query, the entries of the lists it probes."""
    sizes, allowed = np.diff(begins, axis=0), substring_radii(radius, begins.shape[1])
    entries = np.zeros(sizes.shape, np.float32)
    for bits in np.unique(allowed[allowed >= 0]):
        entries[:, allowed == bits] = reach(int(bits)) @ sizes[:, allowed == bits].astype(np.float32)
    return entries


def words(codes: np.ndarray) -> np.ndarray:
    """Codes as 64-bit words."""
    return np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)


def least(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query number, id and distance of each query's k nearest pairs, and their ranks from 0."""
    short = at.astype(np.uint16) if at.max(initial=0) < 1 << 16 else at
    order = np.lexsort((score, short))
    if ((at[order[1:]] == at[order[:-1]]) & (score[order[1:]] == score[order[:-1]])).any():
        order = np.lexsort((ids, score, short))
    at, ids, score = at[order], ids[order], score[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    return at[rank < k], ids[rank < k], score[rank < k], rank[rank < k]


def pairs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of what is marked in a matrix, few of whose places are, in any order."""
    flat = marked.reshape(-1)
    if flat.size % 64:
        return np.divmod(np.flatnonzero(flat), marked.shape[1])
    eights = flat.view(np.uint64).reshape(8, -1)  # numpy looks at one place at a time once one is marked
    some = np.flatnonzero(np.bitwise_or.reduce(eights, axis=0) != 0)
    part, at = np.nonzero(eights[:, some])
    eight = part * eights.shape[1] + some[at]
    at, one = np.nonzero(flat.reshape(-1, 8)[eight])
    return np.divmod(eight[at] * 8 + one, marked.shape[1])


class Nearest:
    """The k nearest rows of some queries among the blocks met so far. ``bound`` is the distance of a query's k-th, infinite until there are k:
    a later row that is farther need not be looked at."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, codes: np.ndarray, centre: np.ndarray, k: int, bound: np.ndarray | None = None) -> None:
        self.q_ids, self.q, self.codes, self.words, self.centre, self.k = q_ids, q.astype(np.float64), codes, words(codes), centre, k
        self.off = self.q - centre
        self.norm = np.linalg.norm(self.off, axis=1)
        self.bound, self.count = np.full(len(q), np.inf) if bound is None else bound, 0
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def add(self, ids: np.ndarray, x: np.ndarray, at: np.ndarray, row: np.ndarray) -> None:
        """Rerank pairs of a query and a row of a block by their exact distance."""
        for s in range(0, len(at), STRETCH):
            a, r = at[s:s + STRETCH], row[s:s + STRETCH]
            score = np.sqrt(((self.q[a] - x[r]) ** 2).sum(axis=1))
            keep = (score <= self.bound[a]) & (self.q_ids[a] != ids[r])
            self.found.append((a[keep], ids[r[keep]], score[keep]))
            self.count += int(keep.sum())
            if self.count >= self.k * len(self.q):
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, ids, score, rank = least(*(np.concatenate(c) for c in zip(*self.found)), self.k)
        self.found, self.count = [(at, ids, score)], 0
        self.bound[at[rank == self.k - 1]] = score[rank == self.k - 1]
        return at, ids, score


def within(found: Nearest, which: np.ndarray, codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a query and a row whose whole codes lie within the radius."""
    columns = np.ascontiguousarray(codes.T)
    for s in range(0, len(which), TILE // 4):
        own = which[s:s + TILE // 4]
        apart = np.zeros((len(own), len(codes)), np.uint16)
        for w, column in enumerate(columns):
            apart += np.bitwise_count(found.words[own, w][:, None] ^ column[None])
        at, row = pairs(apart <= radius)
        yield own[at], row


def not_farther(found: Nearest, which: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a query and a row, among them all that are not farther than the query's bound; of a query without bound, its k nearest.

    Distances come from one matrix product of centred vectors, in single precision unless their squares could leave its range; what
    rounding may add or take away is allowed for.
    """
    if not len(which):
        return
    with np.errstate(all="ignore"):  # what is not a number is kept
        off = x - found.centre
        half, far = (off ** 2).sum(axis=1) / 2, float(np.linalg.norm(off, axis=1).max())
        kind = np.float32 if far > 1e-15 and far + found.norm.max() < 1e15 else np.float64
        rows = np.column_stack([off, -half, np.ones(len(x))]).astype(kind).T
        cut = np.where(np.isinf(found.bound), 0, (found.norm ** 2 - found.bound ** 2) / 2)
        slack = ROUNDING * len(rows) * np.finfo(kind).eps * ((found.norm + far) ** 2 + np.abs(cut)) + np.finfo(kind).tiny * 1e3
        asked = np.column_stack([found.off, np.ones(len(cut)), slack - cut]).astype(kind)
    free, held, count = np.isinf(found.bound[which]), [], 0
    wide = -(-len(x) // max(1, round(len(x) / WIDE)))
    room = np.empty(TILE * wide, kind), np.empty(TILE * wide, bool)  # new memory for each tile would take longer than the comparison
    own = which[~free]
    for s, first in product(range(0, len(own), TILE), range(0, len(x), wide)):
        tile, some = own[s:s + TILE], rows[:, first:first + wide]
        near, farther = (a[:len(tile) * some.shape[1]].reshape(len(tile), -1) for a in room)
        with np.errstate(all="ignore"):
            np.less(np.matmul(asked[tile], some, out=near), 0, out=farther)
        at, row = pairs(np.logical_not(farther, out=farther))
        held.append((tile[at], first + row))
        count += len(at)
        if count >= 4 * STRETCH:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, count = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))
    own = which[free]
    for s in range(0, len(own), TILE):
        tile = own[s:s + TILE]
        with np.errstate(all="ignore"):
            near = asked[tile] @ rows
            near[found.q_ids[tile][:, None] == ids[None]] = -np.inf
            last = np.partition(near, -found.k, axis=1)[:, -found.k] if len(ids) > found.k else np.full(len(tile), -np.inf)
            at, row = pairs(~(near - (last - 2 * slack[tile])[:, None].astype(kind) < 0))
        yield tile[at], row


def meet(found: Nearest, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, order: np.ndarray, begins: np.ndarray, radius: int) -> None:
    """Rerank the rows of a block that the queries' lists return and whose codes lie within the radius.

    Queries whose lists return nothing do not meet the block; where they return few rows, only these are compared. Lists that return many
    cost more than the rows themselves: such queries compare whole codes with all rows, or, once they know k rows, distances first and codes
    of the rows that are near enough. The pairs that are kept are the same, since lists return every code within the radius.
    """
    entries = listed(begins, radius)[found.codes, np.arange(codes.shape[1])].sum(axis=1)
    few, many = np.flatnonzero((entries > 0) & (entries * FEW <= len(ids))), np.flatnonzero(entries * FEW > len(ids))
    own, start, size = words(codes), 0, FIRST

    def close(at: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bitwise_count(found.words[at[s:s + STRETCH]] ^ own[row[s:s + STRETCH]]).sum(axis=1) <= radius
                               for s in range(0, len(at), STRETCH)] or [np.zeros(0, bool)])

    if len(few):
        at, row = pairs(probe(found.codes[few], order, begins, radius))
        keep = close(few[at], row)
        found.add(ids, x, few[at[keep]], row[keep])
    while len(many) and start < len(ids):
        free = np.isinf(found.bound[many])
        first = free.mean() > 0.1  # the first rows give most queries a bound for the others
        end = min(len(ids), start + size) if first else len(ids)
        for at, row in not_farther(found, many[~free], ids[start:end], x[start:end]):
            keep = close(at, start + row)
            found.add(ids, x, at[keep], start + row[keep])
        for at, row in within(found, many[free], own[start:end], radius):
            found.add(ids, x, at, start + row)
        if first:
            found.settle()
        start, size = end, 2 * size


def probed(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, coder: Coder, k: int, codes: np.ndarray, order: np.ndarray,
           begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, id and distance of each query's k nearest in one block, of those that :func:`meet` reranks."""
    found = Nearest(q_ids, q, coder.codes(q), coder.centre, k)
    meet(found, ids, x, codes, order, begins, coder.radius)
    return found.settle()


def blobs(rows: DataFrame, key: str, coder, known=None, k: int = 0) -> DataFrame:
    """One row per block: ids, vectors and codes as bytes. For queries, also a bound of the distance of their k-th: that of the k-th of some
    ``known`` rows of the table that they would find."""
    def packed(part: pa.Table) -> pa.Table:
        ids = part["vec_id"].to_numpy().astype(np.int64)
        x = part["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        x = x if x.dtype == np.float32 else x.astype(np.float64)
        codes, bound = coder.value.codes(x), np.zeros(0)
        if known is not None:
            found, (near_ids, near) = Nearest(ids, x, codes, coder.value.centre, k), known.value
            near_codes = coder.value.codes(near)
            meet(found, near_ids, near, near_codes, *inverted_lists(near_codes), coder.value.radius)
            found.settle()
            bound = found.bound
        return pa.table({key: part[key][:1], **{name: pa.array([a.tobytes()], pa.binary()) for name, a in zip(BLOB, (ids, x, codes, bound))}})

    return rows.select(key, "vec_id", "embedding").groupBy(key).applyInArrow(packed, f"{key} int, " + ", ".join(f"{c} binary" for c in BLOB))


def met(queries: DataFrame, index: DataFrame, count: int, dim: int, coder, k: int, everything: bool) -> DataFrame:
    """``query_id, vec_id, score``: the k nearest rows found of each query; with ``everything`` all rows are compared.

    Index blocks are dealt to groups that a task can hold. All query blocks are sent to each group and meet its blocks one after the other, so
    that what is found in one bounds what is looked at in the next, also in a task's later groups. A query block leaves one row per group,
    of which the nearest are taken.
    """
    spark, blocks = index.sparkSession, max(1, -(-count // BLOCK))
    least_tasks = 3 * spark.sparkContext.defaultParallelism
    groups = -(-blocks // max(1, min(HELD // (BLOCK * dim * 8), blocks // least_tasks)))
    each_task = min(GROUPS, -(-groups // least_tasks))
    tasks = -(-groups // each_task)
    groups = tasks * each_task
    both = (index.select((F.col("block") % groups).alias("group"), F.lit(-1).alias("part"), *BLOB)
            .unionByName(queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "part", *BLOB)))

    def arrays(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, values, codes, bound = (memoryview(batch.column(c)[r].as_buffer()) for c in BLOB)
        ids = np.frombuffer(ids, np.int64)
        values = np.frombuffer(values, np.float32 if len(values) == 4 * dim * len(ids) else np.float64)
        return ids, values.reshape(-1, dim), np.frombuffer(codes, np.uint8).reshape(len(ids), -1), np.frombuffer(bound, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own, bounds = None, [], {}
        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column("group")[r].as_py() != group:
                    group, own = batch.column("group")[r].as_py(), []
                part = batch.column("part")[r].as_py()
                if part < 0:
                    ids, x, codes, _ = arrays(batch, r)
                    own.append((ids, x, codes, *inverted_lists(codes)))
                    continue
                q_ids, q, q_codes, bound = arrays(batch, r)
                found = Nearest(q_ids, q, q_codes, coder.value.centre, k, bounds.get(part, bound).copy())
                for ids, x, codes, order, begins in own:
                    if not everything:
                        meet(found, ids, x, codes, order, begins, coder.value.radius)
                        continue
                    for at, row in not_farther(found, np.arange(len(q)), ids, x):
                        found.add(ids, x, at, row)
                nearest = found.settle()
                bounds[part] = found.bound
                yield pa.record_batch({"part": batch.column("part").slice(r, 1), **{name: pa.array([a.tobytes()], pa.binary()) for name, a in zip(
                    FOUND, (q_ids, *nearest))}})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, q_ids, own = None, None, []

        def merged() -> tuple[np.ndarray, ...]:
            return least(*(np.concatenate(c) for c in zip(*own)), k)[:3]

        for batch in batches:
            for r in range(batch.num_rows):
                ids, *more = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in zip(FOUND, (np.int64, np.int64, np.int64, np.float64)))
                if batch.column("part")[r].as_py() != part:
                    if own:
                        yield flat(q_ids, *merged())
                    part, q_ids, own = batch.column("part")[r].as_py(), ids, []
                own.append(tuple(more))
                if len(own) > 8:
                    own = [merged()]
        if own:
            yield flat(q_ids, *merged())

    def flat(q_ids: np.ndarray, at: np.ndarray, near: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"query_id": pa.array(q_ids[at]), "vec_id": pa.array(near), "score": pa.array(score)})

    dealt = both.repartitionById(tasks, F.col("group") % tasks).sortWithinPartitions("group", "part")
    each = stored(dealt.mapInArrow(run, "part int, " + ", ".join(f"{c} binary" for c in FOUND)), **LARGE_ROWS)
    near = stored(each.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "query_id bigint, vec_id bigint, score double"), **LARGE_ROWS)
    drop(each)
    return near


def search(vectors: DataFrame, is_query: Column, k: int = 10, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found of every query; ``vectors`` has ``vec_id`` and ``embedding``."""
    rows = stored(vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
                  .select("vec_id", "embedding", F.size("embedding").alias("dim")))
    spark, found = rows.sparkSession, []  # of what is stored, large tables are deleted once nothing reads them
    dims = [r for r in rows.groupBy("dim").agg(F.count(F.lit(1)), F.count_if(is_query)).orderBy("dim").collect() if r[2]]
    for dim, count, asked in dims:
        own = rows.filter(F.col("dim") == dim)
        ids, x = bounded_rows(own, "vec_id", sample)
        held, known = spark.sparkContext.broadcast(learn(x, k)), spark.sparkContext.broadcast((ids, x))
        index = stored(blobs(in_blocks(own, "vec_id", BLOCK, count), "block", held))
        asking = stored(own.filter(is_query))
        queries = stored(blobs(in_blocks(asking, "vec_id", QUERIES, asked).withColumnRenamed("block", "part"), "part", held, known, k))
        if dim == dims[-1][0]:
            drop(rows)
        near = met(queries, index, count, dim, held, k, False)
        served = stored(near.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id")))
        short = stored(asking.join(served, "vec_id", "left_anti"))
        found.append(near.join(served.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").select("query_id", "vec_id", "score"))
        left = short.count()
        if left:  # fewer than k codes lie within the radius, of all blocks together: these queries meet all rows
            again = stored(blobs(in_blocks(short, "vec_id", QUERIES, left).withColumnRenamed("block", "part"), "part", held, known, k))
            found.append(met(again, index, count, dim, held, k, True))
        drop(index)
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return union.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
