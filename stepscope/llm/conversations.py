"""Conversation repair with a suffix-shared automaton (DAWG) of row signatures.

Rows of a conversation lie in the order of their turns (nulls first; rows of one turn by role and digest of the text, copies side by side).
The first fault of each row counts: blank, duplicate (an earlier row has its role and text) or truncated. A row becomes one symbol, of its
role's initial and what its fault asks for, and a conversation a string of symbols. The cheapest edits make the roles match
``(s?(ua)+)?``, a grammar with four states.

What the edits of the rest of a conversation cost depends on the rest and the grammar state alone. So the strings of all conversations are
put into one automaton that shares equal suffixes: distinct strings are sorted by their reverse, each string keeps the nodes of the suffix it
shares with the one before, and only its other nodes are made. A node holds, for each grammar state, the cost to go and the first edit of
the best audit from there, which goes on at the next node: so every suffix is solved once, and an audit is read off by following the edits.
Edits of a state have different letters, so the ASCII-least of equally cheap audits is the one whose edit here is least. Nodes off the current
string are dropped: the memory of a task is the longest string. (A suffix at the edge of two tasks is solved in both.)

A long conversation is cut into chunks of at most ``CHUNK`` rows, which are strings of their own: a chunk is solved for each state it may
end in, chunks are chained from the end by these 4 x 4 costs, and the audit of a chunk follows from what the rest costs after it. Insertions
belong to the row after them, so no two edits of a chunk are prefixes of one another and least audits of chunks join to the least audit.

Rows are dealt by ranges of (conversation, turn, role, digest, row) and numbered along them, so one conversation may hold any share of the
rows. Only the hash of a repaired conversation is a sequence by its nature: its lines stream through one task, a batch at a time.

Defined cases: a null role or text is one space, and so is a null id or turn in the key that damage is drawn from; a null conversation is a
conversation; a role's initial other than s, u, a (or none) matches nothing; repeated rows are duplicates; very long texts pass as they are;
an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import takewhile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

CHUNK = 1 << 12
SOLID = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*$"

# Symbols: role initial, upper case if truncated; '-' for rows that must go (blank or duplicate).
GONE = "-"
ANY = 1 << 60  # cost of what is not allowed
START, SYSTEM, USER, CLOSED = range(4)  # grammar states: nothing yet, after s, after u, after ua
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): CLOSED, (CLOSED, "u"): USER}
NEXT_ROLE = ("u", "u", "a", "u")  # the role other than system that may come next
FULL = {"u": "user", "a": "assistant"}
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
Costs = tuple[int, int, int, int]
END: Costs = (0, ANY, ANY, 0)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, as the first bits of the checksum of each row's key tell: ``conv_id, turn, role, text``."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return (conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
                                 F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), kind.alias("_kind"))
            .filter("_kind <> 0").withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .drop("_kind", "_copy"))


def ordered(rows: DataFrame) -> DataFrame:
    """Stored rows with ``at``, which counts along conversations and their turns; rows of a range are numbered without gaps."""
    keyed = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    keyed = keyed.withColumn("digest", F.sha2("text", 256)).withColumn("_row", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "digest", "_row"]
    return stored(keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row").withColumn("at", F.monotonically_increasing_id()))


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, at, initial, fault, symbol`` of :func:`ordered` rows; the first rows of repeated ones are a stored aggregate, so that
    a join on many equal rows can be split."""
    narrow = rows.select("conv_id", "turn", "role", "digest", "at", (~F.col("text").rlike(SOLID)).alias("blank"), (~F.col("text").rlike(ENDED)).alias("cut"))
    repeated = stored(narrow.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    r = repeated.select(F.col("conv_id").alias("_c"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    fault = (F.when(F.col("blank"), "blank").when(F.col("at") > F.col("_first"), "duplicate").when(F.col("cut"), "truncated"))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return (narrow.join(r, same, "left").withColumn("fault", fault)
            .select("conv_id", "turn", "at", known.alias("initial"), "fault",
                    F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known).alias("symbol")))


def chunks(marked: DataFrame) -> DataFrame:
    """Stored strings of symbols, one for each ``CHUNK`` places of a conversation, with whether it begins and ends there and its illegal
    neighbours (that of its first row and the row before it, too)."""
    parts = F.array_sort(F.collect_list(F.struct("at", "symbol", "initial")))
    rows = marked.groupBy("conv_id", F.floor(F.col("at") / F.lit(CHUNK)).alias("chunk")).agg(F.min("at").alias("first"), parts.alias("_rows"))
    roles = F.transform("_rows", lambda x: x["initial"])
    own = rows.select("conv_id", "chunk", "first", F.array_join(F.transform("_rows", lambda x: x["symbol"]), "").alias("symbols"), roles.alias("_roles"))
    line = Window.partitionBy("conv_id").orderBy("chunk")  # one row for CHUNK rows of the conversation
    before = F.lag(F.element_at("_roles", -1)).over(line)
    neighbours = F.when(before.isNull(), F.array().cast("array<string>")).otherwise(F.array(before))
    linked = own.withColumn("begins", before.isNull()).withColumn("ends", F.lead("chunk").over(line).isNull()).withColumn("_roles", F.concat(neighbours, "_roles"))
    pairs = F.zip_with(F.slice("_roles", F.lit(1), F.size("_roles") - 1), F.slice("_roles", F.lit(2), F.size("_roles") - 1), lambda x, y: F.concat(x, y))
    return stored(linked.select("conv_id", "chunk", "first", "symbols", "begins", "ends",
                                F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).alias("illegal")))


@lru_cache(maxsize=1 << 16)
def solved(symbol: str, rest: Costs) -> tuple[Costs, str]:
    """Costs to go before a row and the first edits there, by grammar state, from the costs after the row."""
    role, extra, options = symbol.lower(), TRUNCATED if symbol.isupper() else 0, []
    for state in range(4):
        edits = [(COST["D"] + rest[state], "D")]
        if symbol != GONE:
            edits.append((COST["R"] + extra + rest[STEPS[state, NEXT_ROLE[state]]], "R"))
            if (state, role) in STEPS:
                edits.append((COST["K"] + extra + rest[STEPS[state, role]], "K"))
        options.append(min(edits))
    return with_insertions(options)


@lru_cache(maxsize=1 << 10)
def ending(rest: Costs) -> tuple[Costs, str]:
    """Costs at the end of a string; '.' ends it. Where the conversation ends, messages may be inserted."""
    stop = [(cost, ".") for cost in rest]
    return with_insertions(stop) if rest == END else (rest, "....")


def with_insertions(options: list[tuple[int, str]]) -> tuple[Costs, str]:
    """The cheapest options, the ASCII-least of equal ones, if messages may be inserted first."""
    for _ in range(3):  # an insertion leads to another state; more than two are never worth it
        options = [min(options[state], (COST["I"] + options[STEPS[state, NEXT_ROLE[state]]][0], "I")) for state in range(4)]
    return tuple(min(cost, ANY) for cost, _ in options), "".join(edit for _, edit in options)


class Suffixes:
    """Nodes of the automaton along one string; ``nodes[i]`` stands for its last i symbols, with costs above ``base``."""

    def __init__(self, rest: Costs):
        self.rest, self.string = rest, ""
        costs, edits = ending(rest)
        self.nodes: list[tuple[int, Costs, str]] = [self._node(0, costs, edits)]
        self.made = 0

    @staticmethod
    def _node(base: int, costs: Costs, edits: str) -> tuple[int, Costs, str]:
        least = min(costs)
        return base + least, tuple(c - least if c < ANY else ANY for c in costs), edits

    def read(self, string: str) -> None:
        """Keep the nodes of the suffix shared with the last string and make the others."""
        shared = sum(1 for _ in takewhile(lambda pair: pair[0] == pair[1], zip(reversed(self.string), reversed(string))))
        del self.nodes[shared + 1:]
        for symbol in reversed(string[:len(string) - shared]):
            base, costs, _ = self.nodes[-1]
            self.nodes.append(self._node(base, *solved(symbol, costs)))
        self.made, self.string = len(string) - shared, string

    def cost(self, state: int) -> int:
        base, costs, _ = self.nodes[-1]
        return min(base + costs[state], ANY)

    def audit(self, state: int) -> tuple[str, int]:
        """Best edits from a state, and the state they end in."""
        edits, left = [], len(self.string)
        while (edit := self.nodes[left][2][state]) != ".":
            edits.append(edit)
            if edit == "I":
                state = STEPS[state, NEXT_ROLE[state]]
                continue
            state = after(state, edit, self.string[len(self.string) - left])
            left -= 1
        return "".join(edits), state


def after(state: int, edit: str, initial: str) -> int:
    """Grammar state after an edit of a row."""
    return state if edit == "D" else STEPS[state, initial.lower() if edit == "K" else NEXT_ROLE[state]]


def automaton(strings: DataFrame, entries: tuple[int, ...], audits: bool = True) -> DataFrame:
    """Solve distinct ``symbols, rest`` (costs after the string, by state): a row per state in ``entries`` with ``cost``, ``audit`` and the
    state it ``leaves``, and ``made``, the nodes that the string added to the automaton."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = None
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("symbols", "rest", "entry", "cost", "audit", "leaves", "made")}
            for symbols, rest in zip(batch.column("symbols").to_pylist(), batch.column("rest").to_pylist()):
                if suffixes is None or suffixes.rest != tuple(rest):
                    suffixes = Suffixes(tuple(rest))
                suffixes.read(symbols)
                for entry in entries:
                    possible = audits and suffixes.cost(entry) < ANY
                    audit, leaves = suffixes.audit(entry) if possible else ("", entry)
                    cost = suffixes.cost(entry) - (rest[leaves] if possible else 0)
                    for name, value in zip(out, (symbols, rest, entry, cost, audit, leaves, suffixes.made if entry == entries[0] else 0)):
                        out[name].append(value)
            types = (pa.string(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64())
            yield pa.record_batch({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), types)})

    order = ["rest", F.reverse("symbols")]
    return strings.distinct().repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, "symbols string, rest array<bigint>, entry int, cost bigint, audit string, leaves int, made bigint")


def costs_literal(costs: Costs) -> Column:
    return F.array(*[F.lit(c).cast("bigint") for c in costs])


def rests(long: DataFrame) -> DataFrame:
    """``conv_id, chunk, rest`` of conversations of several chunks: what is left to pay after each chunk, chained from the end."""
    units = F.array(*[costs_literal(tuple(0 if k == e else ANY for k in range(4))) for e in range(4)])
    last = long.filter("ends").select("symbols", costs_literal(END).alias("rest"))
    inner = long.filter("NOT ends").select("symbols", F.explode(units).alias("rest"))
    tables = stored(automaton(last.unionByName(inner), tuple(range(4)), audits=False).groupBy("symbols", (F.col("rest") == costs_literal(END)).alias("ends"))
                    .agg(F.collect_list(F.struct("entry", F.array_position("rest", F.lit(0).cast("bigint")).alias("exit"), "cost")).alias("table")))  # at most 16 entries
    rows = long.select("conv_id", "chunk", "ends", "symbols").join(tables, ["symbols", "ends"]).select("conv_id", "chunk", "ends", "table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = END
        for batch in batches:
            seen = []
            for ends, table in zip(batch.column("ends").to_pylist(), batch.column("table").to_pylist()):
                seen.append(list(END if ends else rest))
                costs = [ANY] * 4
                for t in table:
                    later = 0 if ends else rest[t["exit"] - 1]
                    costs[t["entry"]] = min(costs[t["entry"]], t["cost"] + later)
                rest = tuple(c - min(costs) if c < ANY else ANY for c in costs)
            yield pa.record_batch({"conv_id": batch.column("conv_id"), "chunk": batch.column("chunk"), "rest": pa.array(seen, pa.list_(pa.int64()))})

    kind = long.schema["conv_id"].dataType.simpleString()
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("chunk").desc()).mapInArrow(
        run, f"conv_id {kind}, chunk bigint, rest array<bigint>")


def audited(strings: DataFrame) -> DataFrame:
    """Stored ``conv_id, chunk, first, ends, entry, audit, cost``: the best edits of every chunk."""
    whole = F.col("begins") & F.col("ends")
    short = strings.filter(whole).withColumn("rest", costs_literal(END))
    best = automaton(short.select("symbols", "rest"), (START,)).select("symbols", "entry", "audit", "cost")
    single = short.join(stored(best), "symbols").select("conv_id", "chunk", "first", "ends", "entry", "audit", "cost")
    long = strings.filter(~whole)
    if long.isEmpty():
        return stored(single)
    after_chunk = rests(long).withColumnRenamed("conv_id", "_c").withColumnRenamed("chunk", "_k")
    with_rest = stored(long.join(after_chunk, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("chunk") == F.col("_k"))).drop("_c", "_k"))
    options = automaton(with_rest.select("symbols", "rest"), tuple(range(4))).groupBy("symbols", "rest").agg(
        F.array_sort(F.collect_list(F.struct("entry", "leaves", "audit", "cost"))).alias("options"))  # four entries
    chained = with_rest.join(stored(options), ["symbols", "rest"]).select("conv_id", "chunk", "first", "ends", "options")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = START
        for batch in batches:
            chosen = []
            for ends, options in zip(batch.column("ends").to_pylist(), batch.column("options").to_pylist()):
                chosen.append(options[state])
                state = START if ends else options[state]["leaves"]
            columns = {c: batch.column(c) for c in ("conv_id", "chunk", "first", "ends")}
            yield pa.record_batch(columns | {c: pa.array([x[c] for x in chosen], kind) for c, kind in (("entry", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()))})

    kind = strings.schema["conv_id"].dataType.simpleString()
    parts = chained.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(
        run, f"conv_id {kind}, chunk bigint, first bigint, ends boolean, entry int, audit string, cost bigint")
    return stored(single.unionByName(parts))


class Editor:
    """Applies the audits of the chunks that pass to the rows that follow each."""

    def __init__(self) -> None:
        self.state, self.audit, self.ends, self.used = START, "", True, 0

    def open(self, entry: int, audit: str, ends: bool) -> None:
        self.state, self.audit, self.ends, self.used = entry, audit, ends, 0

    def row(self, role: str) -> Iterator[tuple[str, str]]:
        """Edit and role of each message up to the row's own; a deleted row has none."""
        yield from self._insertions()
        edit, self.used = self.audit[self.used], self.used + 1
        if edit == "R":
            role = FULL[NEXT_ROLE[self.state]]
        self.state = after(self.state, edit, role[:1])
        yield edit, role
        if self.ends and set(self.audit[self.used:]) <= {"I"}:
            yield from self._insertions()

    def _insertions(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.used:self.used + 1] == "I":
            yield "I", FULL[NEXT_ROLE[self.state]]
            self.state, self.used = STEPS[self.state, NEXT_ROLE[self.state]], self.used + 1


def edited(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows and audits of chunks, dealt by conversation and in order; an audit comes before its rows. Only batches are held."""
    kind = {"conv_id": rows.schema["conv_id"].dataType.simpleString(), "turn": rows.schema["turn"].dataType.simpleString()}
    plans = audits.select("conv_id", F.lit(None).cast(kind["turn"]).alias("turn"), F.col("first").alias("at"), F.lit(0).alias("kind"), "entry", "ends",
                          F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    texts = rows.select("conv_id", "turn", "at", F.lit(1).alias("kind"), F.lit(0).alias("entry"), F.lit(False).alias("ends"), "role", "text")
    return plans.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind")


def messages(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place, turn, role, text, edit``; inserted messages have empty text and no turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, place = Editor(), 0
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("at", "place", "role", "text", "edit")}
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            for i, (step, entry, ends) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("entry").to_pylist(), batch.column("ends").to_pylist())):
                if step == 0:
                    place = 0 if editor.ends else place
                    editor.open(entry, texts[i], ends)
                    continue
                for edit, role in editor.row(roles[i]):
                    if edit != "D":
                        for name, value in zip(out, (i, place, role, "" if edit == "I" else texts[i], edit)):
                            out[name].append(value)
                        place += 1
            at = pa.array(out["at"], pa.int64())
            inserted = pa.array([e == "I" for e in out["edit"]], pa.bool_())
            turn = batch.column("turn").take(at)
            yield pa.record_batch({"conv_id": batch.column("conv_id").take(at), "place": pa.array(out["place"], pa.int64()),
                                   "turn": pc.if_else(inserted, pa.nulls(len(at), turn.type), turn),
                                   "role": pa.array(out["role"], pa.string()), "text": pa.array(out["text"], pa.string()), "edit": pa.array(out["edit"], pa.string())})

    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    return edited(rows, audits).mapInArrow(run, f"conv_id {conv}, place bigint, turn {turn}, role string, text string, edit string")


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: the hash of the repaired conversation's lines ``role:text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, digest, lines = Editor(), None, 0
        for batch in batches:
            done: list[tuple[int, str]] = []
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            for i, (step, entry, ends) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("entry").to_pylist(), batch.column("ends").to_pylist())):
                if step == 0:
                    if editor.ends:
                        digest, lines = sha256(), 0
                    editor.open(entry, texts[i], ends)
                    continue
                for edit, role in editor.row(roles[i]):
                    if edit != "D":
                        digest.update(f"{chr(10) if lines else ''}{role}:{'' if edit == 'I' else texts[i]}".encode())
                        lines += 1
                if editor.ends and editor.used == len(editor.audit):
                    done.append((i, digest.hexdigest()))
            yield pa.record_batch({"conv_id": batch.column("conv_id").take(pa.array([i for i, _ in done], pa.int64())),
                                   "repaired_sha256": pa.array([d for _, d in done], pa.string())})

    return edited(rows, audits).mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """Messages of the repaired conversations, see :func:`messages`."""
    rows = ordered(conversations)
    return messages(rows, audited(chunks(stored(faults(rows)))))


def report(conversations: DataFrame, everyone: DataFrame) -> DataFrame:
    """Per ``conv_id`` of ``everyone``: gaps, faults, illegal neighbours, the cost and audit of the cheapest repair and its hash."""
    rows = ordered(conversations)
    marked = stored(faults(rows))
    strings = chunks(marked)
    audits = audited(strings)
    counts = marked.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")])
    # The audit of a conversation is a value of the result, as long as the conversation has rows.
    edits = audits.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    pairs = strings.groupBy("conv_id").agg(F.sum("illegal").cast("long").alias("illegal"))
    result = everyone.select("conv_id").distinct()
    for part in (counts, pairs, edits, digests(rows, audits)):
        right = part.withColumnRenamed("conv_id", "_c")
        result = result.join(right, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    return result.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna(
        {"audit": "", "repaired_sha256": sha256(b"").hexdigest()}).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
