"""Rule and keyword classification of kernel names.

Rules become one ``CASE`` over the name, in priority order, so a name is tested until its first match
and no rule join is needed. Callers aggregate by name first: names, not events, are classified.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (CATEGORY_ORDER, EXCLUDED_LABEL, KEYWORD_CATEGORIES, KEYWORD_KERNEL_FALLBACK)
from ..sources.rules import Rule, RuleSet


# Attributes of a classification detail.
_PLAIN = ["category", "reason", "rule_id", "rule_platform", "semantic_type", "confidence", "matched_pattern", "notes"]
_LISTS = ["evidence", "ambiguity_reasons", "category_candidates"]


def sql_text(value: str | None) -> str:
    """Spark SQL string literal."""
    return "NULL" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _first_match(name: str, rules: list[Rule], missing: int | None) -> str:
    """SQL for the number (from 1) of the first pattern that matches, over all rules in order."""
    arms = [f"WHEN {name} RLIKE {sql_text('(?i)' + p)} THEN {n}"
            for n, p in enumerate((p for r in rules for p in r.patterns), start=1)]
    otherwise = "CAST(NULL AS INT)" if missing is None else str(missing)
    return f"CASE {' '.join(arms)} ELSE {otherwise} END" if arms else otherwise


def _attribute(rule: Rule, pattern: str | None, attribute: str):
    return pattern if attribute == "matched_pattern" else \
        rule.platform if attribute == "rule_platform" else getattr(rule, attribute)


def with_detail(df: DataFrame, rules: RuleSet, attributes: Sequence[str] | None = None,
                name: str = "name", count: str = "record_count") -> DataFrame:
    """Attach the classification of aggregated names as a struct (all attributes, or those named).

    The match number is computed once per row; each attribute is a lookup in a constant list.
    Unmatched names get the fallback; a NULL category marks runtime and profiler markers. The match
    depends on the rows' ``count`` as well, which keeps filters on the classification above the
    aggregation: pushed below it, every event would be classified instead of every name.
    """
    matches = [(r, p) for r in rules.kernel_rules for p in r.patterns] + [(rules.fallback, None)]
    fields = []
    for attribute in attributes or _PLAIN + _LISTS:
        values = [_attribute(r, p, attribute) for r, p in matches]
        if attribute in _LISTS:
            items = [f"array({', '.join(sql_text(v) for v in value)})" if value else "array()" for value in values]
            fields.append(f"'{attribute}', element_at(CAST(array({', '.join(items)}) AS array<array<string>>), _match)")
        else:
            items = ", ".join(sql_text(v) for v in values)
            fields.append(f"'{attribute}', element_at(CAST(array({items}) AS array<string>), _match)")
    numbered = df.selectExpr("*", f"IF({count} >= 0, {_first_match(name, rules.kernel_rules, len(matches))}, NULL) AS _match")
    return numbered.selectExpr(*[f"`{c}`" for c in df.columns], f"named_struct({', '.join(fields)}) AS detail")


def host_rule(rules: RuleSet, name: str = "name") -> Column:
    """Rule id of the expert host operation a ``cpu_op`` name stands for; NULL without one."""
    ids = [r.rule_id for r in rules.host_rules for _ in r.patterns]
    if not ids:
        return F.lit(None).cast("string")
    listed = ", ".join(sql_text(i) for i in ids)
    return F.expr(f"try_element_at(array({listed}), {_first_match(name, rules.host_rules, None)})")


def classify_names(names: DataFrame, rules: RuleSet, attributes: Sequence[str] | None = None) -> DataFrame:
    """Distinct names with their number of rows and classification ``detail``."""
    counted = names.groupBy("name").agg(F.count(F.lit(1)).alias("record_count"))
    return with_detail(counted, rules, attributes)


def excluded_label(name: Column) -> Column:
    """Report label of a name without a category."""
    return F.when(name.isin("WAIT", "SET"), F.concat(F.lit("非计算/"), name)).otherwise(EXCLUDED_LABEL)


def category_rank(category: str) -> Column:
    """Position of a category in report order, from 0."""
    return F.expr(f"CAST(array_position(array({', '.join(sql_text(c) for c in CATEGORY_ORDER)}), {category}) AS INT) - 1")


def keyword_category(name: str = "name", rules: dict[str, list[str]] | None = None) -> Column:
    """Keyword category: ``triton_`` prefix, ordered words, kernel heuristics, then ``at::native``."""
    def any_of(words: list[str]) -> str:
        return "(" + " OR ".join(f"contains(lower({name}), {sql_text(w.lower())})" for w in words) + ")"

    arms = [f"WHEN startswith(lower({name}), 'triton_') THEN 'triton'"]
    arms += [f"WHEN {any_of(words)} THEN {sql_text(c)}"
             for c, words in (KEYWORD_CATEGORIES if rules is None else rules).items() if words]
    arms += [f"WHEN contains(lower({name}), 'kernel') AND {any_of(words)} THEN {sql_text(c)}"
             for c, words in KEYWORD_KERNEL_FALLBACK.items()]
    return F.expr(f"CASE {' '.join(arms)} ELSE 'at::native' END")
