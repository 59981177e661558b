"""Kernel rule artifact: read the editable rules, hold them against their contract, and order them.

The contract is data: for each kind of object the fields it has, and for each kind of field what its value must be. One checker walks an
artifact along the contract and lists everything that breaks it, over all platform groups, before any rule becomes part of a query.
"""
from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from importlib import resources
from itertools import chain

from pyspark.sql import SparkSession

from ..fixed_values import CATEGORY_ORDER, CONFIDENCES, DENSE_CATEGORIES, PLATFORMS, RULE_GROUPS

CATEGORIES_BY_SCHEMA = {
    1: DENSE_CATEGORIES,
    2: [c for c in CATEGORY_ORDER if c != "GDN"],
    3: CATEGORY_ORDER,
}
# Fields of each kind of object and the kind of their values; a question mark ends the name of a field that may be left out.
ENTRY = {"id": "text", "reason": "text", "semantic_type": "text", "category": "category", "confidence": "confidence", "evidence": "texts",
         "ambiguity_reasons?": "texts", "category_candidates?": "known categories", "notes?": "text"}
CONTRACT = {
    "artifact": {"schema_version": "schema", "version": "text", "categories": "categories of the schema", "compatibility_keywords": "words by category",
                 "exclude_hints": "texts", "fallback": "fallback", "platforms": "groups"},
    "fallback": ENTRY,
    "rule": {**ENTRY, "category": "category or none", "priority": "integer", "patterns": "patterns", "match_on?": "target", "source_categories?": "texts"},
}


def _is_text(value) -> bool:
    return isinstance(value, str) and value.strip() != ""


def _are_texts(value) -> bool:
    return isinstance(value, list) and all(map(_is_text, value))


# What a value of each kind must be; the second argument is the list of categories that the artifact's schema has.
KINDS = {
    "text": lambda v, names: _is_text(v),
    "texts": lambda v, names: _are_texts(v),
    "integer": lambda v, names: type(v) is int,
    "schema": lambda v, names: type(v) is int and v in CATEGORIES_BY_SCHEMA,
    "categories of the schema": lambda v, names: v == names,
    "words by category": lambda v, names: isinstance(v, dict) and sorted(v) == sorted(names) and all(map(_are_texts, v.values())),
    "category": lambda v, names: v in names,
    "category or none": lambda v, names: v is None or v in names,
    "known categories": lambda v, names: _are_texts(v) and set(v) <= set(CATEGORY_ORDER),
    "confidence": lambda v, names: v in CONFIDENCES,
    "patterns": lambda v, names: _are_texts(v) and v != [],
    "target": lambda v, names: v in ("kernel_name", "cpu_op"),
    "fallback": lambda v, names: isinstance(v, dict),
    "groups": lambda v, names: isinstance(v, dict) and sorted(v) == sorted(RULE_GROUPS) and all(isinstance(rules, list) for rules in v.values()),
}


class RuleError(ValueError):
    """The rule artifact breaks its contract."""


@dataclass(frozen=True)
class Rule:
    rule_id: str
    platform: str
    category: str | None
    reason: str
    semantic_type: str
    confidence: str
    evidence: list[str]
    ambiguity_reasons: list[str]
    category_candidates: list[str]
    notes: str | None = None
    priority: int = 0
    patterns: list[str] = field(default_factory=list)
    match_on: str = "kernel_name"


@dataclass(frozen=True)
class RuleSet:
    """Rules of the selected platform, lowest priority first."""
    kernel_rules: list[Rule]
    host_rules: list[Rule]
    fallback: Rule
    schema_version: int
    version: str
    sha256: str
    platform: str
    path: str

    @property
    def provenance(self) -> dict[str, str]:
        return {"path": self.path, "sha256": self.sha256, "version": self.version, "platform": self.platform}


def load_rules(spark: SparkSession | None = None, path: str | None = None, platform: str = "auto") -> RuleSet:
    """Rules from an artifact on any Spark file system, or the bundled ones."""
    if path is None:
        bundled = resources.files("stepscope") / "rules" / "kernel_rules.json"
        return parse_rules(bundled.read_text(encoding="utf-8"), platform, "bundled")
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        raise RuleError(f"empty rule artifact {path}")
    return parse_rules(text[0].lstrip("﻿"), platform, path)


def parse_rules(text: str, platform: str = "auto", path: str = "inline") -> RuleSet:
    """Check an artifact and keep the rules of one platform plus ``common`` (``auto`` keeps all)."""
    if platform not in PLATFORMS:
        raise RuleError(f"unsupported platform {platform!r}")
    broken = violations(text)
    if broken:
        raise RuleError(f"{path}: " + "; ".join(f"{place}: {problem}" for place, problem in broken))
    artifact = json.loads(text)
    wanted = RULE_GROUPS if platform == "auto" else ("common", platform)
    ordered = sorted((rule_of(entry, group) for group, entries in artifact["platforms"].items() if group in wanted for entry in entries), key=lambda r: r.priority)
    by_target = {target: [r for r in ordered if r.match_on == target] for target in ("kernel_name", "cpu_op")}
    return RuleSet(by_target["kernel_name"], by_target["cpu_op"], rule_of(artifact["fallback"], "common"), artifact["schema_version"], artifact["version"],
                   hashlib.sha256(text.encode("utf-8")).hexdigest(), platform, path)


def rule_of(entry: dict, group: str) -> Rule:
    """A checked entry as a rule; the category is its own candidate unless others are named."""
    own = [entry["category"]] if entry["category"] else []
    given = {f: entry[f] for f in ("category", "reason", "semantic_type", "confidence", "evidence", "notes", "priority", "patterns", "match_on") if f in entry}
    return Rule(entry["id"], group, ambiguity_reasons=entry.get("ambiguity_reasons", []), category_candidates=entry.get("category_candidates", own), **given)


def violations(text: str) -> list[tuple[str, str]]:
    """Everything in which an artifact breaks the contract, as (place, problem); empty for a sound one."""
    repeated: list[str] = []

    def object_of(pairs: list[tuple]) -> dict:
        made = dict(pairs)
        if len(made) < len(pairs):
            repeated.append(", ".join(sorted({key for key, _ in pairs if sum(k == key for k, _ in pairs) > 1})))
        return made

    try:
        artifact = json.loads(text, object_pairs_hook=object_of)
    except json.JSONDecodeError as error:
        return [("artifact", f"is no JSON: {error}")]
    found = [("artifact", f"repeats the keys {keys}") for keys in repeated]
    schema = artifact.get("schema_version") if isinstance(artifact, dict) else None
    names = CATEGORIES_BY_SCHEMA[schema] if KINDS["schema"](schema, []) else CATEGORY_ORDER
    found += broken_fields("artifact", artifact, "artifact", names)
    if any(place.startswith("artifact") for place, _ in found):
        return found
    entries = {f"platforms.{group}[{i}]": entry for group, rules in artifact["platforms"].items() for i, entry in enumerate(rules)}
    found += broken_fields("fallback", artifact["fallback"], "fallback", names)
    found += chain.from_iterable(broken_fields("rule", entry, place, names) for place, entry in entries.items())
    objects = {place: entry for place, entry in {"fallback": artifact["fallback"], **entries}.items() if isinstance(entry, dict)}
    found += chain(repeated_ids(objects), host_rules_that_do_not_promote(objects), patterns_that_do_not_compile(objects))
    return found


def broken_fields(kind: str, value, place: str, names: list[str]) -> Iterator[tuple[str, str]]:
    """The checker: fields of one object that are missing or not what the contract says."""
    if not isinstance(value, dict):
        yield place, "is no object"
        return
    for name, wanted in CONTRACT[kind].items():
        key = name.rstrip("?")
        if key not in value:
            if key == name:
                yield f"{place}.{key}", "is missing"
        elif not KINDS[wanted](value[key], names):
            yield f"{place}.{key}", f"is no valid {wanted}"


def repeated_ids(entries: dict[str, dict]) -> Iterator[tuple[str, str]]:
    seen: dict[str, str] = {}
    for place, entry in entries.items():
        first = seen.setdefault(str(entry.get("id")), place)
        if first != place:
            yield f"{place}.id", f"is that of {first}"


def host_rules_that_do_not_promote(entries: dict[str, dict]) -> Iterator[tuple[str, str]]:
    for place, entry in entries.items():
        if entry.get("match_on") == "cpu_op" and (entry.get("category"), entry.get("source_categories")) != ("group gemm", ["gemm"]):
            yield place, "a host rule may only promote gemm to group gemm"


def patterns_that_do_not_compile(entries: dict[str, dict]) -> Iterator[tuple[str, str]]:
    """Patterns tried on the regular expressions that run them: those of the session's JVM, where there is one."""
    session = SparkSession.getActiveSession()
    compile_ = session._jvm.java.util.regex.Pattern.compile if session else re.compile
    for place, entry in entries.items():
        for pattern in entry.get("patterns", []) if KINDS["patterns"](entry.get("patterns", []), []) else []:
            try:
                compile_(pattern)
            except Exception as error:  # the gateway wraps what the JVM throws
                yield f"{place}.patterns", f"{pattern!r} does not compile: {type(error).__name__}"
