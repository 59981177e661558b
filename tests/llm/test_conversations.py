"""Conversation repair against a search over all edits."""
import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepscope.llm import conversations
from stepscope.llm.queries import QUERIES, table

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """Dijkstra over (rows done, roles' state); ties by the audit itself. Rows are (role, text, fault)."""
    steps, follows = {"": "su", "s": "u", "u": "a", "a": "u"}, {"s": "u", "": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
        if (i, state) in seen:
            continue
        seen.add((i, state))
        full = {"u": "user", "a": "assistant"}[follows[state]]
        heapq.heappush(heap, (cost + 5, audit + "I", i, follows[state], (*lines, f"{full}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, follows[state], (*lines, f"{full}:{text}")))
                if role[:1] and role[:1] in steps[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))


def expected(rows, everyone):
    out = {}
    for conv in everyone:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        faults, seen = [], set()
        for _, _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {r[1] for r in own if r[1] is not None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        cost, audit, digest = cheapest([(r[2], r[3], f) for r, f in zip(own, faults)])
        out[conv] = (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def result(frame):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in frame.collect()}


def made_up(seed, longest):
    rng, rows = np.random.default_rng(seed), []
    for conv in range(40):
        for turn in range(int(rng.integers(0, longest))):
            role = rng.choice(["system", "user", "assistant", "tool", "", "User"], p=[.1, .4, .38, .05, .04, .03])
            rows.append((conv, None if rng.random() < .05 else turn, str(role), str(rng.choice(["Yes.", "no", "", " \t", "What? ", "so!\n", f"n{rng.integers(99)}."]))))
    return rows


CASES = [(None, 3, "user", "a."), (None, None, None, None), (None, 1, "assistant", "b."), (100, 0, "system", "only."), (101, 0, "user", "x" * 300_000),
         (102, 5, "user", "same."), (102, 5, "user", "same."), (102, 9, "assistant", "é ü.\x1c"), (103, None, "s", "."), (104, 1, "", "?")]


@pytest.mark.parametrize("chunk", [1 << 12, 4, 1])
def test_repairs_equal_a_search(spark, monkeypatch, chunk):
    """Also with chunks of a few rows, which cut conversations anywhere."""
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rows = CASES + made_up(chunk, 14)
    told = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", symbols string, chunk int")
    everyone = spark.createDataFrame([(c,) for c in {r[0] for r in rows} | {999}], "conv_id bigint")
    want = expected([(c, t, r or (" " if r is None else r), " " if x is None else x) for c, t, r, x in rows], {r[0] for r in rows} | {999})
    assert result(conversations.report(told, everyone)) == want
    lines = {}
    for r in sorted(conversations.repair(told).collect(), key=lambda r: r.place):
        assert r.place == len(lines.setdefault(r.conv_id, [])) and (r.edit != "I" or (r.text == "" and r.turn is None))
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {c: w[-1] for c, w in want.items() if c in lines}
    assert conversations.report(told.limit(0), everyone.limit(0)).collect() == []


def test_query_equals_a_search(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = result(QUERIES["op12_dawg"](spark, "/root/testdata/sf0.01"))
    assert got == expected(damage(rows), {r[0] for r in rows})


def test_damage_draws_from_the_key(spark):
    rows = CASES + made_up(3, 14)
    got = conversations.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(repr, [tuple(r) for r in got])) == sorted(map(repr, damage(rows)))


def test_equal_suffixes_are_solved_once(spark):
    """The automaton has one node per distinct suffix, whatever the number of strings."""
    rng = np.random.default_rng(4)
    strings = {"".join(rng.choice(list("suaoSUA-"), rng.integers(0, 9))) for _ in range(3000)}
    frame = spark.createDataFrame([(s, list(conversations.END)) for s in strings for _ in (0, 1)], "symbols string, rest array<bigint>").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        solved = conversations.automaton(frame, (conversations.START,)).agg(F.count("*"), F.sum("made")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tuple(solved) == (len(strings), len({s[i:] for s in strings for i in range(len(s))}))
