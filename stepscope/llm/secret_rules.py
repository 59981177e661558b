"""Secret rules and the Boolean trigram queries that their patterns imply."""
from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as parser


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``least`` characters; shorter matches are consumed but dropped. Base kinds come first."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("code_host_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("map_key", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("payment_key", r"sk_live_[0-9A-Za-z]+", 0, 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
BASE = 3
# Alternative strings that one stretch of a pattern may stand for before the stretch is cut.
MOST_STRINGS = 64
# Trigrams asked for of each string: those with the rarest letters. Fewer trigrams give a weaker condition, never a wrong one.
GRAMS_PER_STRING = 2
COMMON_FIRST = " etaoinsrhldcumfpgwybvkxjqz"

Query = tuple  # ("all",) | ("gram", g) | ("and" | "or", [queries])
ALL: Query = ("all",)


def both(parts: list[Query]) -> Query:
    parts = [p for p in parts if p != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def either(parts: list[Query]) -> Query:
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", parts)


def of_strings(strings: set[str]) -> Query:
    """Some of the strings occurs in the text. A string that holds another one adds nothing."""
    strings = {s for s in strings if not any(o != s and o in s for o in strings)}
    return either([both([("gram", g) for g in rarest({s[i:i + 3] for i in range(len(s) - 2)})]) for s in sorted(strings)])


def rarest(found: set[str]) -> list[str]:
    return sorted(found, key=lambda g: (-sum(COMMON_FIRST.find(c) % 40 for c in g), g))[:GRAMS_PER_STRING]


def characters(items: list) -> set[str] | None:
    """The characters of a small class, in lower case."""
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def analyse(items: list) -> tuple[set[str] | None, Query]:
    """The finite set of strings a sequence stands for, or None and what any match must hold."""
    held: set[str] = {""}
    needs: list[Query] = []
    exact = True

    def cut() -> None:
        nonlocal held, exact
        needs.append(of_strings(held))
        held, exact = {""}, False

    for kind, value in items:
        strings: set[str] | None = None
        need: Query = ALL
        if kind is op.LITERAL:
            strings = {chr(value).lower()}
        elif kind is op.IN:
            strings = characters(value)
        elif kind is op.SUBPATTERN:
            strings, need = analyse(list(value[-1]))
        elif kind is op.BRANCH:
            each = [analyse(list(b)) for b in value[1]]
            if all(s is not None for s, _ in each):
                strings = set().union(*(s for s, _ in each))
            else:
                need = either([of_strings(s) if s is not None else q for s, q in each])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = value
            some, inside = analyse(list(inner))
            if (low, high) == (1, 1):
                strings, need = some, inside
            elif (low, high) == (0, 1) and some is not None:
                strings = some | {""}
            elif low:
                need = of_strings(some) if some is not None else inside
                if some is not None:  # one occurrence is certain next to what stands before
                    held = {a + b for a, b in product(held, some)} if len(held) * len(some) <= MOST_STRINGS else held
        elif kind is op.AT:
            continue
        if strings is not None and len(held) * len(strings) <= MOST_STRINGS:
            held = {a + b for a, b in product(held, strings)}
        else:
            cut()
            if strings is not None:
                held = set(strings)
            needs.append(need)
    if exact:
        return held, of_strings(held)
    needs.append(of_strings(held))
    return None, both(needs)


def trigram_query(pattern: str) -> Query:
    """Boolean query over trigrams of the lower-cased text that every match of the pattern implies."""
    return analyse(list(parser.parse(pattern)))[1]


def grams(query: Query) -> set[str]:
    if query[0] == "gram":
        return {query[1]}
    return set().union(*(grams(q) for q in query[1])) if query[0] in ("and", "or") else set()


def asked(rule: Rule) -> str:
    """Pattern that a text with a kept match holds. Only a pattern that is one run of a class can be asked for its least length at once."""
    parsed = list(parser.parse(rule.pattern))
    if rule.group == 0 and rule.least > 1 and rule.pattern.endswith("]+") and len(parsed) == 1 and [kind for kind, _ in parsed[0][1][2]] == [op.IN]:
        return rule.pattern[:-1] + f"{{{rule.least},}}"
    return rule.pattern


def check(rules: tuple[Rule, ...]) -> None:
    """Patterns must compile and not match the empty text."""
    for rule in rules:
        if re.compile(rule.pattern).match(""):
            raise ValueError(f"rule {rule.kind} matches the empty text")
