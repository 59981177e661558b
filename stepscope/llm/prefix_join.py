"""N-gram Jaccard join with adaptive multi-match prefixes, and its connected components.

A document is the set of its distinct word shingles, in the order of their hashes. Two sets with Jaccard similarity of at least t
share a shingle within their first ``size - ceil(t * size) + 1``: their base prefixes. If a prefix is lengthened by e shingles,
1 + e must be shared. Each set stores a reserve of a third more than its base prefix, from which its own e is chosen:

* A shingle is hot if more than ``HOT`` different sets have it in their reserve. A set whose lengthened prefix holds h <= e hot
  shingles must share at least 1 + e - h that are not hot. Such a set ("extended") is indexed only under these; among the feasible
  lengths it takes the one with the lowest estimated cost, the candidates its lists hold over the matches it asks for.
* A set for which no length within the reserve suffices (most of its shingles are hot: a member of a large group of near copies) is
  "bare". It is indexed under all shingles of its reserve that are not hot, which is enough to meet extended sets whose e is no
  larger than its own reserve: these ask for what they would ask of each other. Bare sets, and extended sets with a larger e than
  the reserve of some set they could link to, form a crowd that is also met through hot shingles.

Lists of shingles that are not hot have at most ``HOT`` entries and are joined; pairs with too few matches or unlike sizes go
unverified. Long lists are never paired: each member is verified against one star centre of its lists. What that leaves in
different components meets in blocks of at most ``BLOCK`` sets of like size, blocks of one component being skipped, and exact
overlaps are computed inside the block pair, which leaves only the links of a spanning forest. So no link between components is
missed and pairs inside a component need not be looked at.

Sets that are equal are one node, so exact copies cost nothing. Links are verified on whole sets. Components are found by
contraction in Spark.

Defined cases: null and blank texts have an empty set and link with nothing; a text with fewer words than a shingle has its whole
word sequence as its one shingle; rows with one doc_id are compared each by its own text, and a component is called by the smallest
doc_id of its rows; a row without doc_id takes no part and has no component; an empty table gives no rows; further columns are not read.
Equality is that of 64-bit hashes.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .cover_tree import Links
from .store import PRUNE, drop, stored
from .words import STEP, U, mixed, slices, windows, words_of

SHINGLE = 5
SIMILARITY = Fraction(3, 4)
HOT = 16
EXTRA = 3  # most matches asked for beyond the least number
BLOCK = 512
COLUMNS = 8192
FILTER_BITS = 26  # 8 MB, broadcast as a million words


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order, and where each row's begin."""
    words = words_of(column, lower=True)
    counts, size = words.counts, max(0, len(words.hash) - n + 1)
    row_end = np.repeat(words.first[1:], counts)
    start = np.flatnonzero(np.arange(size) + n <= row_end[:size])
    row = np.searchsorted(words.first, start, side="right") - 1
    value = windows(words.hash, n)[start]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):  # the whole sequence, told apart by its length
        whole = [mixed(reduce(lambda h, w: h * STEP + w, words.hash[words.first[i]:words.first[i + 1], None], U([counts[i]])))[0] for i in short]
        row, value = np.concatenate([row, short]), np.concatenate([value, np.array(whole, np.uint64)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(row[new], np.arange(len(counts) + 1))


def set_marks(value: np.ndarray, first: np.ndarray) -> pa.Array:
    """A hash of each set."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mixed(value + STEP), out=total[1:])
    return pa.array(mixed(total[first[1:]] - total[first[:-1]]).view(np.int64))


def base_length(size: np.ndarray, similarity: Fraction = SIMILARITY) -> np.ndarray:
    return size + 1 + (-similarity.numerator * size) // similarity.denominator


def reserve_length(size: np.ndarray, similarity: Fraction = SIMILARITY) -> np.ndarray:
    base = base_length(size, similarity)
    return np.minimum(size, base + np.maximum(EXTRA + 1, base // 3))


def sizes(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, size, mark`` (hash of the set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                value, first = shingle_sets(piece.column("text"), n)
                yield pa.record_batch({"doc_id": piece.column("doc_id"), "size": pa.array(np.diff(first).astype(np.int64)), "mark": set_marks(value, first)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, size bigint, mark bigint")


def prefixes(docs: DataFrame, n: int, similarity: Fraction) -> DataFrame:
    """``doc_id, size, mark`` (hash of the set) and ``prefix``, its reserve."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                value, first = shingle_sets(piece.column("text"), n)
                size = np.diff(first)
                take = reserve_length(size, similarity) * (size > 0)
                at = np.repeat(first[:-1], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                yield pa.record_batch({
                    "doc_id": piece.column("doc_id"), "size": pa.array(size.astype(np.int64)),
                    "mark": set_marks(value, first),
                    "prefix": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(take)).astype(np.int32)), pa.array(value[at].view(np.int64)))})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, size bigint, mark bigint, prefix array<bigint>")


def full_sets(docs: DataFrame, nodes: DataFrame, n: int, repeated: bool) -> DataFrame:
    """``node, shingles`` of the wanted ``node, doc, mark``: of the rows with that doc_id, one whose set has the mark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                value, first = shingle_sets(piece.column("text"), n)
                sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(value.view(np.int64)))
                own = pc.equal(set_marks(value, first), piece.column("mark"))
                yield pa.record_batch({"node": piece.column("node").filter(own), "shingles": sets.filter(own)})

    texts = docs.select("doc_id", "text").join(nodes.withColumnRenamed("doc", "doc_id"), "doc_id")
    sets = texts.mapInArrow(run, "node bigint, shingles array<bigint>")
    return sets.groupBy("node").agg(F.first("shingles").alias("shingles")) if repeated else sets


def like_sizes(a: str, b: str, similarity: Fraction) -> Column:
    p, q = similarity.numerator, similarity.denominator
    return F.expr(f"{q} * least({a}, {b}) >= {p} * greatest({a}, {b})")


def base_and_room(size: str, similarity: Fraction) -> tuple[str, str]:
    """SQL for the base prefix of a set and for the rest of its reserve."""
    base = f"({size} + 1 - CAST(ceil({similarity.numerator} * {size} / {similarity.denominator}D) AS BIGINT))"
    return base, f"(least({size}, {base} + greatest({EXTRA + 1}, {base} DIV 3)) - {base})"


def plans(live: DataFrame, similarity: Fraction) -> DataFrame:
    """``node, length, asked, base``: the prefix each set is indexed by and the matches it asks for; ``asked`` 0 for bare sets."""
    base, room = base_and_room("size", similarity)
    per_node = (live.groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("pos", "df"))).alias("tokens"))  # a set's own prefix
                .withColumn("base", F.expr(base)).withColumn("room", F.expr(room)))
    # A column for each number of extra matches: an expression inside the cost would be walked again for each shingle.
    lengths = {f"length_{k}": F.expr(f"base + aggregate(filter(tokens, t -> t.df > {HOT}), CAST({k} AS BIGINT), (e, t) -> IF(t.pos < base + e, e + 1, e))")
               for k in range(EXTRA + 1)}
    cost = "aggregate(tokens, 0D, (s, t) -> s + IF(t.df <= {hot} AND t.pos < length_{k}, t.df - 1, 0)) / {asked}"
    choices = ", ".join(f"IF(length_{k} <= base + room, struct({cost.format(hot=HOT, k=k, asked=k + 1)} AS cost, length_{k} AS length, {k + 1} AS asked), NULL)"
                        for k in range(EXTRA + 1))
    best = per_node.withColumns(lengths).select("node", "base", "room", F.expr(f"array_min(array_compact(array({choices})))").alias("best"))
    return best.select("node", F.coalesce("best.length", F.col("base") + F.col("room")).alias("length"), F.coalesce("best.asked", F.lit(0)).alias("asked"), "base")


def verified(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are as similar as asked."""
    p, q = similarity.numerator, similarity.denominator
    both = (pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.select("a", "b", shared.alias("shared"), (F.size("of_a") + F.size("of_b") - shared).alias("either")).filter(
        F.expr(f"{q} * shared >= {p} * either")).select("a", "b")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)

    def entries(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        column = np.minimum(np.searchsorted(common, flat), max(0, len(common) - 1))
        held = common[column] == flat
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[held], column[held]

    if len(common):
        (row_a, col_a), (row_b, col_b) = entries(flat_a, a), entries(flat_b, b)
        for s in range(0, len(common), COLUMNS):
            m = [np.zeros((len(sets), min(COLUMNS, len(common) - s)), np.float32) for sets in (a, b)]
            for matrix, row, col in ((m[0], row_a, col_a), (m[1], row_b, col_b)):
                part = (col >= s) & (col < s + COLUMNS)
                matrix[row[part], col[part] - s] = 1
            out += m[0] @ m[1].T
    return out


def block_links(members: DataFrame, similarity: Fraction) -> DataFrame:
    """Links ``a, b`` between components of sets that meet through hot shingles.

    ``members``: ``node, component, bare``, ``shingles``; at least one set of a pair is bare. A band is a range of sizes within the similarity;
    sets in bands further apart than one cannot link. A component that fills blocks of a band by itself has blocks of its own.
    """
    p, q = similarity.numerator, similarity.denominator
    banded = members.withColumn("band", F.floor(F.log(F.size("shingles")) / F.lit(float(np.log(q / p)))).cast("int"))
    groups = banded.groupBy("band", "bare", "component").count()
    large = groups.filter(F.col("count") >= BLOCK // 2).select("band", "bare", "component", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    small = groups.filter(F.col("count") < BLOCK // 2).groupBy("band", "bare").agg(F.ceil(F.sum("count") / BLOCK).cast("int").alias("rest"))
    dealt = (banded.join(large, ["band", "bare", "component"], "left").join(small, ["band", "bare"], "left")
             .withColumn("own", F.when(F.col("parts").isNotNull(), F.col("component")))
             .withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", "rest")).cast("int")))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        sets = part["shingles"].to_list()
        return pd.DataFrame({"band": part["band"][:1], "bare": part["bare"][:1], "own": part["own"][:1].astype("Int64"),
                             "nodes": [part["node"].to_numpy(np.int64).tobytes()], "components": [part["component"].to_numpy(np.int64).tobytes()],
                             "lengths": [np.array([len(s) for s in sets], np.int64).tobytes()], "values": [np.concatenate(sets).astype(np.int64).tobytes()]})

    blocks = stored(dealt.repartition("band", "bare", "own", "part").groupBy("band", "bare", "own", "part").applyInPandas(
        pack, "band int, bare boolean, own bigint, nodes binary, components binary, lengths binary, values binary").withColumn("id", F.expr("uuid()")))
    keys = blocks.select("band", "bare", "own", "id")
    left = keys.filter("bare").withColumn("met", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    right = keys.select(F.col("band").alias("met"), F.col("bare").alias("bare_b"), F.col("own").alias("own_b"), F.col("id").alias("id_b"))
    once = ~F.col("bare_b") | (F.col("id") <= F.col("id_b"))
    met = left.join(right, "met").filter(once & ~F.coalesce(F.col("own") == F.col("own_b"), F.lit(False))).select("id", "id_b")

    def side(name: str) -> DataFrame:
        return blocks.select(F.col("id").alias("id" if name == "a" else "id_b"), *[F.col(c).alias(f"{name}_{c}") for c in ("nodes", "components", "lengths", "values")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a_node, a_comp, a_size, a_value, b_node, b_comp, b_size, b_value = (
                    np.frombuffer(batch.column(f"{s}_{c}")[r].as_buffer(), np.int64) for s in "ab" for c in ("nodes", "components", "lengths", "values"))
                shared = overlaps(np.split(a_value, np.cumsum(a_size)[:-1]), np.split(b_value, np.cumsum(b_size)[:-1]))
                i, j = np.nonzero((q * shared >= p * (a_size[:, None] + b_size[None] - shared)) & (a_comp[:, None] != b_comp[None]))
                links = Links(np.ones(len(b_node)), len(a_node), len(b_node), False)
                links.add(i, j, np.ones(len(a_node)))
                node = np.concatenate([a_node, b_node])
                at = np.flatnonzero(links.label != np.arange(len(node)))
                yield pa.record_batch({"a": pa.array(node[at]), "b": pa.array(node[links.label[at]])})

    return met.join(side("b"), "id_b").join(side("a"), "id").mapInArrow(run, "a bigint, b bigint")


def join(docs: DataFrame, n: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    every, classes = _classes(docs, n, similarity)
    linked = every.filter("size > 0 AND doc_id IS NOT NULL").join(classes, ["mark", "size"]).select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return linked.unionByName(every.filter("size = 0 OR doc_id IS NULL").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def perhaps_live(tokens: DataFrame, live: DataFrame) -> DataFrame:
    """Rows whose token may be live: most shingles are seen once and need not be shuffled again. A filter of ``FILTER_BITS`` bits, whatever the
    number of tokens, is met inside the scan; it keeps every live token and a few others."""
    place = F.pmod(F.xxhash64("token"), F.lit(1 << FILTER_BITS))
    bit = F.expr("shiftleft(1L, CAST(_place % 64 AS INT))")
    word = F.floor(F.col("_place") / 64)
    held = live.withColumn("_place", place).groupBy(word.alias("id")).agg(F.bit_or(bit).alias("_bits"))
    words = stored(live.sparkSession.range(1 << (FILTER_BITS - 6)).join(held, "id", "left").select(F.col("id").alias("_word"), F.coalesce("_bits", F.lit(0).cast("long")).alias("_bits")))
    met = tokens.withColumn("_place", place).withColumn("_word", word).join(F.broadcast(words), "_word")
    return met.filter(F.col("_bits").bitwiseAND(bit) != 0).select(*tokens.columns)


def _classes(docs: DataFrame, n: int, similarity: Fraction) -> tuple[DataFrame, DataFrame]:
    """``doc_id, size, mark`` of each row, and for each set ``mark, size, component_id, doc`` (its smallest doc_id) and whether it is the
    one that stays (``first``) of its component."""
    every = stored(sizes(docs, n))
    usable = every.filter("size > 0 AND doc_id IS NOT NULL")
    named = stored(usable.groupBy("mark", "size").agg(F.min("doc_id").alias("doc")).withColumn("node", F.monotonically_increasing_id()))
    repeated = not usable.groupBy("doc_id").count().filter("count > 1").isEmpty()  # exact repetitions of a row would give a node several times
    own = prefixes(docs, n, similarity).filter("size > 0 AND doc_id IS NOT NULL")  # built once it is known which are wanted: they are the largest table
    if repeated:
        own = own.groupBy("doc_id", "mark", "size").agg(F.first("prefix").alias("prefix"))
    nodes = stored(own.join(named.withColumnRenamed("doc", "doc_id"), ["doc_id", "mark", "size"]).select("node", "size", "prefix"))
    tokens = nodes.select("node", "size", F.posexplode("prefix").alias("pos", "token"))
    live = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    listed = stored(perhaps_live(tokens, live).join(live, "token"))
    drop(nodes)
    planned = stored(plans(listed, similarity))
    index = stored(listed.join(planned, "node").filter(f"pos < base OR pos < length AND df <= {HOT}"))

    # A bare set asks for what the extended one asks for; two bare sets meet in the crowd.
    short = index.filter(f"df <= {HOT} AND pos < length").select("token", "node", "size", F.expr("IF(asked = 0, 2147483647, asked)").alias("asked"))
    other = short.select("token", F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("asked").alias("asked_b"))
    matched = (short.join(other, (short["token"] == other["token"]) & (F.col("node") < F.col("b")) & like_sizes("size", "size_b", similarity))
               .groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.least("asked", "asked_b")).alias("asked"))
               .filter("n >= asked").select("a", "b"))

    smallest = f"CAST(ceil({similarity.numerator} * size / {similarity.denominator}D) AS BIGINT)"  # of the sets this one could link to; so is their reserve
    hot = stored(index.filter(f"df > {HOT} AND pos < base").withColumn("bare", F.col("asked") == 0)
                 .filter(f"bare OR length - base > {base_and_room(smallest, similarity)[1]}"))
    centres = stored(hot.filter("bare").groupBy("token").agg(F.min(F.struct("node", "size")).alias("centre")))
    spokes = (hot.join(centres, "token").select("node", "size", F.col("centre.node").alias("c"), F.col("centre.size").alias("size_c"))
              .filter((F.col("node") != F.col("c")) & like_sizes("size", "size_c", similarity)).groupBy("node", "c").count())
    star = spokes.groupBy("node").agg(F.max_by("c", F.struct("count", -F.col("c"))).alias("c")).select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))
    pairs = stored(matched.unionByName(star).distinct())

    band = F.floor(F.log("size") / F.lit(float(-np.log(float(similarity)))))
    around = stored(hot.filter("bare").select("token", F.explode(F.array(band - 1, band, band + 1)).alias("band")).distinct())
    crowd = hot.withColumn("band", band).join(around, ["token", "band"], "left_semi").select("node", "bare").distinct()
    crowd = stored(crowd)
    drop(live, listed, planned, index, hot, centres, around)
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowd.select("node")).distinct()
    sets = stored(full_sets(docs, stored(named.join(wanted, "node").select("node", "doc", "mark")), n, repeated), **PRUNE)
    links = stored(verified(pairs, sets, similarity))
    joined = stored(components(links))
    members = crowd.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "bare").join(sets, "node")
    more = stored(block_links(members, similarity))
    final = components(links.unionByName(more)) if not more.isEmpty() else joined
    labelled = stored(named.join(final, "node", "left").withColumn("component", F.coalesce("component", "node")))
    drop(sets)
    firsts = stored(labelled.groupBy("component").agg(F.min(F.struct("doc", "mark")).alias("least")))
    classes = labelled.join(firsts, "component").select("mark", "size", "doc", F.col("least.doc").alias("component_id"),
                                                        (F.col("mark") == F.col("least.mark")).alias("first"))
    return every, classes


def keep_first(docs: DataFrame, n: int = SHINGLE, similarity: Fraction = SIMILARITY) -> DataFrame:
    """One document of each group, of the smallest doc_id (of several such texts, that whose set has the smallest hash), and all rows that
    link with nothing because they have no doc_id or no words, one per doc_id; columns stay as they were."""
    every, classes = _classes(docs, n, similarity)
    known = every.filter("doc_id IS NOT NULL")
    if known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        gone = known.join(classes.filter("component_id <> doc OR NOT first"), ["mark", "size"], "left_semi").unionByName(
            known.join(classes.filter("first"), ["mark", "size"]).filter("doc_id <> component_id").select("doc_id", "size", "mark"))
        return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    staying = stored(classes.filter("first").select(F.col("component_id").alias("_doc"), F.col("mark").alias("_first")).unionByName(
        known.filter("size = 0").select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_first"))).distinct())
    kind = docs.schema.simpleString()[len("struct<"):-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*piece.columns, set_marks(*shingle_sets(piece.column("text"), n))], [*piece.schema.names, "_mark"])

    marked = docs.filter("doc_id IS NOT NULL").mapInArrow(run, kind + ", _mark bigint")
    kept = marked.join(staying, (F.col("doc_id") == F.col("_doc")) & (F.col("_mark") == F.col("_first"))).dropDuplicates(["doc_id", "_mark"])
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))
