"""Secret scans through a trigram inverted index; DataFrame functions only.

Each rule's pattern implies a Boolean query over trigrams (``secret_rules``). The index lists, for each trigram that some
query names, the distinct texts that hold it (postings). Queries are answered by intersecting and uniting postings: the
postings of a text meet in one row of bits on which the rules' queries are evaluated. Only the candidates are verified with
the real patterns. Rules without a mandatory trigram scan every text.

A text is known by its 128-bit digest, so copies share postings and are verified once, whatever their number. Texts meet the
candidates in an inner join, before which Spark prunes them with its runtime Bloom filter (at most 8 MB); texts that are no
candidates do not have to be shuffled.

Spans are leftmost and non-overlapping per rule, in code points with exclusive ends. Matches whose group is too short are
consumed and dropped. Defined cases: null text counts as empty; repeated rows and doc_ids each give a row; an empty table
gives no rows; of further columns none is read.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secret_rules import ALL, BASE, RULES, Query, Rule, asked, check, grams, trigram_query
from .numbering import free_name
from .store import PRUNE, stored

BITS = 60  # trigram bits per column
SPANS = "array<struct<start:int,rule:int,stop:int>>"


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def whole_text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """Inverted index: ``gram`` (number of the trigram in ``wanted``), ``key`` (text)."""
    texts = docs.select(text_key(whole_text(docs)).alias("key"), F.lower(whole_text(docs)).cast("binary").alias("low"))  # folded once, not for each trigram
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g.encode())), F.lit(i)) for i, g in enumerate(wanted)]))
    return texts.select("key", F.explode_outer(held).alias("gram")).filter("gram IS NOT NULL")


def holds(query: Query, bit: dict[str, Column]) -> Column:
    """The query over a text's trigram bits."""
    if query[0] == "gram":
        return bit[query[1]]
    parts = [holds(q, bit) for q in query[1]]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``key, rules``: texts that may match, with a bit for each indexed rule."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) != ALL}
    wanted = sorted(set().union(*(grams(q) for q in queries.values())))
    index = postings(docs, wanted)
    words = range(-(-len(wanted) // BITS))
    bits = index.groupBy("key").agg(*[
        F.bit_or(F.when(F.floor(F.col("gram") / BITS) == w, F.expr(f"shiftleft(1L, gram % {BITS})")).otherwise(F.lit(0).cast("long"))).alias(f"_w{w}")
        for w in words])
    bit = {g: F.expr(f"(_w{i // BITS} & {1 << (i % BITS)}L) <> 0") for i, g in enumerate(wanted)}
    mask = reduce(lambda a, b: a + b, [F.when(holds(q, bit), F.lit(1 << i)).otherwise(F.lit(0)) for i, q in queries.items()])
    return bits.select("key", mask.alias("rules")).filter("rules > 0")


def matches(text: Column, rule: Rule, number: int) -> Column:
    """Spans of one rule in a text, as an array of (start, rule, stop)."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(found, gaps, lambda m, g: F.struct(
        F.length(g).alias("gap"), F.length(m).alias("n"), F.length(F.regexp_extract(m, rule.pattern, rule.group)).alias("group")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    walked = F.aggregate(steps, start, lambda a, s: F.struct(
        (a["at"] + s["gap"] + s["n"]).alias("at"),
        F.when(s["group"] >= rule.least, F.concat(a["spans"], F.array(F.struct(
            (a["at"] + s["gap"]).alias("start"), F.lit(number).alias("rule"), (a["at"] + s["gap"] + s["n"]).alias("stop")))))
        .otherwise(a["spans"]).alias("spans")))
    return F.when(F.rlike(text, F.lit(asked(rule))), walked["spans"]).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents' columns and ``spans``: array of (start, rule number, stop), by start, then rule. If a column has that name, the new
    one gets underscores at its end."""
    check(rules)
    found = stored(candidates(docs, rules))
    indexed = [i for i, r in enumerate(rules) if trigram_query(r.pattern) != ALL]
    full = [i for i in range(len(rules)) if i not in indexed]
    texts = docs.select(text_key(whole_text(docs)).alias("key"), whole_text(docs).alias("body"))
    verified = texts.join(found, "key").select("key", F.concat(*[
        F.when(F.expr(f"(rules & {1 << i}) <> 0"), matches(F.col("body"), rules[i], i)).otherwise(F.array().cast(SPANS)) for i in indexed]).alias("verified"))
    verified = stored(verified.filter(F.size("verified") > 0).groupBy("key").agg(F.max("verified").alias("verified")), **PRUNE)
    scanned = docs.select(F.struct("*").alias("_doc"), text_key(whole_text(docs)).alias("_key"),
                          (F.concat(*[matches(whole_text(docs), rules[i], i) for i in full]) if full else F.array().cast(SPANS)).alias("_full"))
    joined = scanned.join(verified.withColumnRenamed("key", "_key"), "_key", "left")
    spans = F.array_sort(F.concat("_full", F.coalesce("verified", F.array().cast(SPANS))))
    return joined.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns], spans.alias(free_name(docs, "spans")))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """The documents with every span replaced by a mark; overlapping spans become one mark. Columns stay as they were."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept"))
    text, spans = F.col("text"), F.col(free_name(docs, "spans"))
    walked = F.aggregate(spans, first, lambda a, s: F.struct(
        F.greatest(a["at"], s["stop"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["kept"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))))
        .otherwise(a["kept"]).alias("kept")))
    rest = F.substring(text, walked["at"] + 1, F.length(text))
    new = F.when(F.size(spans) > 0, F.concat(F.array_join(walked["kept"], ""), rest)).otherwise(text)
    changed = {"text": new.alias("text"), "n_chars": F.length(new).cast("long").alias("n_chars")}
    return scan(docs, rules).select(*[changed.get(c, F.col(f"`{c}`")) for c in docs.columns])


def digest(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, digest of the base spans and all spans as text."""
    def listed(spans: Column) -> Column:
        kinds = F.array(*[F.lit(r.kind) for r in rules])
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    counts = [F.expr(f"CAST(size(filter(spans, s -> s.rule = {i})) AS BIGINT)").alias(f"n_{r.kind}") for i, r in enumerate(rules[:BASE])]
    base = F.filter("spans", lambda s: s["rule"] < BASE)
    return scanned.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
