"""Scalar expressions: exact time, attribute lookup, symbol normalisation and text."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Unrounded share in percent; NULL on a zero or missing whole."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)


def round2(value: Column) -> Column:
    """Two decimals from the binary value of a nonnegative double."""
    return F.floor(value * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(100.0)


def us_to_ns(text: Column) -> Column:
    """Microsecond text to whole nanoseconds; NULL for anything else.

    Negative, fractional-nanosecond, infinite and non-numeric input has no exact nanosecond value.
    """
    exact = text.cast("string").try_cast("decimal(38,9)")
    nanos = exact * F.lit(1000).cast("decimal(5,0)")
    return F.when((exact >= 0) & (nanos == F.floor(nanos)), nanos).try_cast("bigint")


def ns_to_us(ns: Column) -> Column:
    """Nanoseconds to fractional microseconds."""
    return ns / F.lit(1000.0)


def ns_to_us_text(ns: Column) -> Column:
    """Nanoseconds to exact microsecond text without trailing zeros."""
    whole = F.floor(ns / F.lit(1000).cast("decimal(5,0)")).cast("bigint")
    digits = F.rtrim(F.format_string("%d.%03d", whole, ns - whole * 1000), F.lit("0"))
    return F.rtrim(digits, F.lit("."))


def normal_key(key: Column) -> Column:
    """Attribute key without case and punctuation."""
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def attribute(args: Column, *names: str) -> Column:
    """First non-null attribute among several spellings, compared by normalised key; the last equal key wins."""
    entries = F.map_entries(args)

    def lookup(spelling: str) -> Column:
        return F.try_element_at(F.filter(entries, lambda e: normal_key(e["key"]) == spelling), F.lit(-1))["value"]

    return F.coalesce(*[lookup("".join(ch for ch in n.lower() if ch.isalnum())) for n in names])


def external_id(args: Column) -> Column:
    return attribute(args, "External id", "external_id")


def correlation(args: Column) -> Column:
    return attribute(args, "correlation", "correlation_id")


def is_runtime(category: Column) -> Column:
    """Runtime or driver call."""
    return F.lower(category).rlike("runtime|driver")


def is_graph_launch(name: Column) -> Column:
    """Launch or replay of a captured graph, by name."""
    lowered = F.lower(name)
    return lowered.contains("graph") & (lowered.contains("launch") | lowered.contains("replay"))


def contains_any(text: Column, words: list[str]) -> Column:
    """True when any of the words occurs in the text; the text is evaluated once."""
    return text.rlike("|".join(re.escape(w) for w in words))


def normalized_symbol(name: Column) -> Column:
    """Symbol without addresses, ``void``, a trailing argument list and white space.

    The trailing list is the shortest balanced ``(...)`` suffix: walking back from the end, the depth
    first returns to zero at its opening parenthesis. Templates, digits and case stay significant.
    """
    text = F.trim(F.regexp_replace(name, "0x[0-9a-fA-F]+", "0xADDR"))
    text = F.when(text.startswith("void "), F.substring(text, 6, 1 << 30)).otherwise(text)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("pos"), F.lit(0).alias("cut"))

    def step(acc: Column, ch: Column) -> Column:
        depth = F.when(ch == ")", acc["depth"] + 1).when(ch == "(", acc["depth"] - 1).otherwise(acc["depth"])
        pos = acc["pos"] + 1
        cut = F.when((acc["cut"] == 0) & (ch == "(") & (depth == 0), pos).otherwise(acc["cut"])
        return F.struct(depth.alias("depth"), pos.alias("pos"), cut.alias("cut"))

    scan = F.aggregate(F.split(F.reverse(text), ""), start, step, lambda acc: acc["cut"])
    kept = F.when(text.endswith(")") & (scan > 0), F.substring(text, F.lit(1), F.length(text) - scan)).otherwise(text)
    return F.regexp_replace(kept, "\\s+", "")


def shortened(text: Column, limit: int, mark: str = "...") -> Column:
    """Text cut for display."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def flag_value(line: Column, flag: str) -> Column:
    """Value that follows a command-line flag; NULL when absent."""
    found = F.regexp_extract(line, r"(?:^|\s)" + flag + r"\s+(\S+)", 1)
    return F.nullif(found, F.lit(""))


def rank_of(file_name: Column) -> Column:
    """Rank from a trace file name; NULL when absent."""
    from ..fixed_values import RANK_IN_FILE_NAME
    base = F.element_at(F.split(file_name, "/"), -1)
    return F.regexp_extract(base, RANK_IN_FILE_NAME, 1).try_cast("int")
