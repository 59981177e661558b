"""Plain Python versions of the operators, for small tables."""
from __future__ import annotations

from collections import defaultdict
from itertools import combinations

FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return (raw.translate(FOLD) if lower else raw).split()


def windows_removed(rows: list[tuple], window: int = 13) -> list[tuple]:
    """(doc_id, n_words, kept words) of each row; windows that start in a smaller doc_id are removed."""
    first: dict[tuple, int] = {}
    for doc, text in rows:
        own = words(text)
        for k in range(len(own) - window + 1):
            key = tuple(own[k:k + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        own = words(text)
        gone = [False] * len(own)
        for k in range(len(own) - window + 1):
            key = tuple(own[k:k + window])
            if doc is not None and first[key] < doc:
                gone[k:k + window] = [True] * window
        out.append((doc, len(own), b" ".join(w for w, g in zip(own, gone) if not g).decode()))
    return out


def shingles(text: str | None, n: int = 5) -> frozenset:
    own = words(text, lower=True)
    return frozenset(tuple(own[k:k + n]) for k in range(len(own) - n + 1)) if len(own) >= n else frozenset([tuple(own)] if own else [])


def classes(nodes, links) -> dict:
    """Smallest node reachable from each node."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_classes(rows: list[tuple]) -> dict:
    sets = {doc: shingles(text) for doc, text in rows}
    links, holders = set(), defaultdict(list)
    for doc, own in sets.items():
        for s in own:
            holders[s].append(doc)
    for docs in holders.values():
        links.update(combinations(sorted(docs), 2))
    return classes(sets, [(a, b) for a, b in links if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
