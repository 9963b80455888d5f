"""Repair of conversations: the cheapest edits that make their roles a sentence of a role grammar.

A generalised LR parser runs over the roles with a graph-structured stack. At every row each stack top may delete,
keep or rerole the row and insert roles before it; equal tops merge by the least (cost, audit), the audit being the
initials of the edits so far. The stacks of the grammar are finitely many, so rows are parsed in slices: a slice gives
the best edits from each stack to each stack, and a conversation chains those of its slices.

Two audits of one cost over the same rows never begin one another, as inserts cost something: the least audit so far
stays the least whatever follows.
"""

from __future__ import annotations

import functools
import hashlib
import os.path
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowward.llm.scratch import Scratch

#: Rules of conversations: perhaps a system turn, then user and assistant in turn.
CHAT = (
    ("chat", ()),
    ("chat", ("turns",)),
    ("chat", ("s", "turns")),
    ("turns", ("turns", "u", "a")),
    ("turns", ("u", "a")),
)
SLICE_ROWS = 1024
MAX_STACKS = 256
WHITE = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Edits:
    """Weights of edits and the roles they may set; ``insert`` has to cost something."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    keep_truncated: int = 5
    roles: tuple[str, ...] = ("user", "assistant")


class Tables:
    """SLR tables of a grammar; ``actions`` may name several for one symbol, all of them are followed."""

    def __init__(self, rules: tuple[tuple[str, tuple[str, ...]], ...]):
        self.rules = (("", (rules[0][0],)), *rules)
        names = {left for left, _ in self.rules}
        self.terminals = sorted({x for _, right in rules for x in right} - names)
        first, empty = {n: set() for n in names}, set()
        follow = {n: set() for n in names}
        follow[""].add(None)  # the end
        size = -1
        while size != (size := sum(map(len, [*first.values(), *follow.values(), empty]))):
            for left, right in self.rules:
                for x in right:
                    first[left] |= first.get(x, {x})
                    if x not in empty:
                        break
                else:
                    empty.add(left)
                after = set(follow[left])
                for x in reversed(right):
                    if x in names:
                        follow[x] |= after
                        after = after | first[x] if x in empty else set(first[x])
                    else:
                        after = {x}
        states = [self._closed({(0, 0)})]
        self.goto: list[dict[str, int]] = []
        self.reduce: list[dict[str | None, list[int]]] = []
        for state in states:  # grows on the way
            moves: dict[str, set] = {}
            reduce: dict[str | None, list[int]] = {}
            for rule, dot in sorted(state):
                left, right = self.rules[rule]
                if dot < len(right):
                    moves.setdefault(right[dot], set()).add((rule, dot + 1))
                else:
                    for x in follow[left]:
                        reduce.setdefault(x, []).append(rule)
            self.goto.append({})
            for x, items in sorted(moves.items()):
                target = self._closed(items)
                if target not in states:
                    states.append(target)
                self.goto[-1][x] = states.index(target)
            self.reduce.append(reduce)

    def _closed(self, items: set[tuple[int, int]]) -> frozenset:
        found, queue = set(items), list(items)
        while queue:
            rule, dot = queue.pop()
            for k, (left, _) in enumerate(self.rules):
                if dot < len(self.rules[rule][1]) and left == self.rules[rule][1][dot] and (k, 0) not in found:
                    found.add((k, 0))
                    queue.append((k, 0))
        return frozenset(found)


class Stacks:
    """All stacks of a grammar as one graph: a node is a state and the node below it."""

    def __init__(self, rules=CHAT):
        self.tables = Tables(rules)
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self.numbers = {(0, -1): 0}
        self._shifts: dict[tuple[int, str], tuple[int, ...]] = {}
        for node in iter(range(MAX_STACKS)):
            if node == len(self.nodes):
                break
            for x in self.tables.terminals:
                self.shift(node, x)
        else:
            raise ValueError(f"The grammar has more than {MAX_STACKS} stacks; write its repetitions left-recursively")
        self.accepting = [self._accepts(n) for n in range(len(self.nodes))]

    def _push(self, state: int, below: int) -> int:
        if (state, below) not in self.numbers:
            self.numbers[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self.numbers[state, below]

    def _reduced(self, node: int, ahead: str | None) -> list[int]:
        """``node`` and whatever reductions before ``ahead`` make of it."""
        found = [node]
        for top in found:  # grows on the way
            for rule in self.tables.reduce[self.nodes[top][0]].get(ahead, ()):
                left, right = self.tables.rules[rule]
                below = top
                for _ in right:
                    below = self.nodes[below][1]
                if left and (made := self._push(self.tables.goto[self.nodes[below][0]][left], below)) not in found:
                    found.append(made)
        return found

    def shift(self, node: int, x: str) -> tuple[int, ...]:
        """The stacks after role ``x``; none where it can't stand."""
        known = self._shifts.get((node, x))
        if known is None:
            tops = [t for t in self._reduced(node, x) if x in self.tables.goto[self.nodes[t][0]]]
            known = tuple(self._push(self.tables.goto[self.nodes[t][0]][x], t) for t in tops)
            self._shifts[node, x] = known
        return known

    def _accepts(self, node: int) -> bool:
        return any(0 in self.tables.reduce[self.nodes[t][0]].get(None, ()) for t in self._reduced(node, None))


Tops = dict[int, tuple[int, str]]


class Repair:
    """Steps of the weighted parser over the stack tops and their (cost, audit)."""

    def __init__(self, rules=CHAT, edits: Edits = Edits()):
        if edits.insert <= 0:
            raise ValueError("An insert has to cost something")
        self.edits, self.stacks = edits, Stacks(rules)
        self.set_to = {role[0]: role for role in edits.roles}

    def inserted(self, tops: Tops) -> Tops:
        """The tops after any number of inserts."""
        best, queue = dict(tops), list(tops)
        for node in queue:  # grows on the way
            cost, audit = best[node]
            for x in self.set_to:
                for to in self.stacks.shift(node, x):
                    new = (cost + self.edits.insert, audit + "I")
                    if to not in best or new < best[to]:
                        best[to] = new
                        queue.append(to)
        return best

    def row(self, tops: Tops, initial: str, truncated: bool) -> Tops:
        """The tops after a row that need not go."""
        merged: Tops = {}

        def offer(node: int, cost: int, audit: str) -> None:
            if node not in merged or (cost, audit) < merged[node]:
                merged[node] = (cost, audit)

        extra = self.edits.keep_truncated if truncated else 0
        for node, (cost, audit) in self.inserted(tops).items():
            offer(node, cost + self.edits.delete, audit + "D")
            for to in self.stacks.shift(node, initial):
                offer(to, cost + extra, audit + "K")
            for x in self.set_to:
                for to in self.stacks.shift(node, x):
                    offer(to, cost + extra + self.edits.rerole, audit + "R")
        return merged

    def deleted(self, tops: Tops, n: int) -> Tops:
        """The tops after ``n`` rows that have to go; inserts may as well come after them."""
        return {node: (cost + n * self.edits.delete, audit + "D" * n) for node, (cost, audit) in tops.items()}

    def moves(self, rows: list[tuple[str, bool, int, int]], starts: Iterable[int]) -> list[tuple[int, int, int, str]]:
        """(from, to, cost, audit) of ``rows``: (initial, truncated, whether one stays, how many have to go)."""
        out = []
        for start in starts:
            tops: Tops = {start: (0, "")}
            for initial, truncated, stays, go in rows:
                if stays:
                    tops = self.row(tops, initial, truncated)
                if go:
                    tops = self.deleted(tops, go)
            out += [(start, to, cost, audit) for to, (cost, audit) in tops.items()]
        return out


@functools.lru_cache(maxsize=4)
def _repair(rules, edits: Edits) -> Repair:
    return Repair(rules, edits)


# ---- rows and their faults --------------------------------------------------------------------------------------


def with_faults(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, role, key, n, first, blank, truncated), a written table: each distinct row, how often it stands there, and
    whether it is the conversation's first of its role and text; ``key`` is a digest of the text."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    each = turns.select(
        "conv_id", "turn", "role", F.unhex(F.md5("text")).alias("key"), "n",
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    rows = each.groupBy("conv_id", "turn", "role", "key", "blank", "truncated").agg(F.sum("n").alias("n"))
    rows = scratch.cut(rows)  # so that the join can split a conversation that repeats itself
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"))
    first = first.agg(F.min(F.struct("turn")).alias("at"))
    same = rows["conv_id"].eqNullSafe(first["c"]) & (rows["role"] == first["r"]) & (rows["key"] == first["k"])
    joined = rows.join(first, same).withColumn("first", F.col("turn").eqNullSafe(F.col("at.turn")))
    faults = scratch.cut(joined.select("conv_id", "turn", "role", "key", "n", "first", "blank", "truncated"))
    scratch.drop(rows)
    return faults


SLICES = (
    "conv_id long, at struct<turn: long, role: string, key: binary>, last long, blank long, duplicate long, "
    "truncated long, illegal long, first_role string, last_role string, low long, high long, turns long, "
    "moves array<struct<start: int, to: int, cost: long, audit: string>>"
)
LEGAL = ("su", "ua", "au")
NEVER = object()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _written(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= at_once or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _slice(repair: Repair, conv, rows: list[tuple], starts: Iterable[int]) -> tuple:
    """One row of ``SLICES`` of successive rows of a conversation."""
    blank = duplicate = truncated = illegal = turns = 0
    parsed, before = [], None
    seen = NEVER
    for turn, role, _, n, first, is_blank, is_truncated in rows:
        stays = int(first and not is_blank)
        go = n - stays
        blank += n if is_blank else 0
        duplicate += 0 if is_blank else go
        truncated += stays and is_truncated
        x = role[:1]
        illegal += (n - 1) * (x + x not in LEGAL) + (before is not None and before + x not in LEGAL)
        before = x
        turns += turn is not None and turn != seen
        seen = turn
        parsed.append((x, is_truncated, stays, go))
    known = [r[0] for r in rows if r[0] is not None]
    low, high = (known[0], known[-1]) if known else (None, None)
    moves = [dict(zip(("start", "to", "cost", "audit"), m, strict=True)) for m in repair.moves(parsed, starts)]
    at = dict(zip(("turn", "role", "key"), rows[0][:3], strict=True))
    return (
        conv, at, rows[-1][0], blank, duplicate, int(truncated), illegal, rows[0][1][:1], before, low, high, turns, moves
    )


def _sliced(rules, edits: Edits, schema: pa.Schema, slice_rows: int) -> Callable:
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        repair = _repair(rules, edits)
        everywhere = range(len(repair.stacks.nodes))
        conv, held, starts = NEVER, [], everywhere
        for row in _rows(batches):
            if conv is NEVER or row[0] != conv or len(held) >= slice_rows:
                if held:
                    yield _slice(repair, conv, held, starts)
                # the first conversation of a partition may have begun in another one
                starts = everywhere if conv is NEVER or row[0] == conv else (0,)
                conv, held = row[0], []
            held.append(row[1:])
        if held:
            yield _slice(repair, conv, held, starts)

    return lambda batches: _written(slices(batches), schema, 512)


TOTALS = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)


class _Chain:
    """The slices of one conversation, in order, put together."""

    def __init__(self, repair: Repair, conv):
        self.repair, self.conv = repair, conv
        self.counts = [0, 0, 0, 0]
        self.low = self.high = self.last = self.last_role = None
        self.turns = 0
        self.tops: Tops = {0: (0, "")}
        self.done: list[str] = []

    def add(self, last, counts, first_turn, first_role, last_role, low, high, turns, moves) -> None:
        if self.last_role is not None:
            self.counts[3] += self.last_role + first_role not in LEGAL
            turns -= first_turn is not None and first_turn == self.last
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        self.low = low if self.low is None else self.low
        self.high = self.high if high is None else high
        self.turns += turns
        self.last, self.last_role = last, last_role
        merged: Tops = {}
        for m in moves:
            if m["start"] in self.tops:
                cost, audit = self.tops[m["start"]]
                new = (cost + m["cost"], audit + m["audit"])
                if m["to"] not in merged or new < merged[m["to"]]:
                    merged[m["to"]] = new
        shared = os.path.commonprefix([audit for _, audit in merged.values()])
        self.done.append(shared)
        self.tops = {node: (cost, audit[len(shared) :]) for node, (cost, audit) in merged.items()}

    def total(self) -> tuple:
        ended = self.repair.inserted(self.tops)
        cost, audit = min(best for node, best in ended.items() if self.repair.stacks.accepting[node])
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return self.conv, gaps, *self.counts, cost, "".join([*self.done, audit])


def _chained(rules, edits: Edits, schema: pa.Schema) -> Callable:
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        repair = _repair(rules, edits)
        chain = None
        for conv, at, last, blank, duplicate, truncated, illegal, first_role, last_role, low, high, turns, moves in _rows(batches):
            if chain is None or chain.conv != conv:
                if chain is not None:
                    yield chain.total()
                chain = _Chain(repair, conv)
            counts = (blank, duplicate, truncated, illegal)
            chain.add(last, counts, at["turn"], first_role, last_role, low, high, turns, moves)
        if chain is not None:
            yield chain.total()

    return lambda batches: _written(totals(batches), schema, 512)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def repair_totals(turns: DataFrame, rules=CHAT, edits: Edits = Edits(), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation in ``turns``.

    ``turns`` is what ``ordered_turns`` gives. A conversation may lie in any number of partitions and slices.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "role_repair")
    rows = with_faults(turns, scratch)
    order = ("conv_id", "turn", "role", "key")
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    slices = sorted_rows.mapInArrow(_sliced(rules, edits, _arrow(spark, SLICES), slice_rows), SLICES)
    slices = scratch.cut(slices)
    scratch.drop(rows)
    sorted_slices = slices.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    totals = scratch.cut(sorted_slices.mapInArrow(_chained(rules, edits, _arrow(spark, TOTALS)), TOTALS))
    scratch.drop(slices)
    return totals


TURNS = "conv_id long, place long, role string, text string, edit string"


def _walked(rules, edits: Edits, schema: pa.Schema) -> Callable:
    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        repair = _repair(rules, edits)
        stacks = repair.stacks
        conv, audit, at, node, place = None, "", 0, 0, 0

        def set_role() -> tuple[int, str]:
            return next((to, repair.set_to[x]) for x in repair.set_to for to in stacks.shift(node, x))

        for row_conv, own_audit, role, text, n in _rows(batches):
            if own_audit is not None:  # comes before the conversation's rows
                for _ in audit[at:]:
                    node, made = set_role()
                    yield conv, place, made, "", "I"
                    place += 1
                conv, audit, at, node, place = row_conv, own_audit, 0, 0, 0
                continue
            for _ in range(n):
                while audit[at] == "I":
                    node, made = set_role()
                    yield conv, place, made, "", "I"
                    at, place = at + 1, place + 1
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "K":
                    node, made = stacks.shift(node, role[:1])[0], role
                else:
                    node, made = set_role()
                yield conv, place, made, text, edit
                place += 1
        for _ in audit[at:]:
            node, made = set_role()
            yield conv, place, made, "", "I"
            place += 1

    return lambda batches: _written(turns(batches), schema)


def repaired_turns(turns: DataFrame, totals: DataFrame, rules=CHAT, edits: Edits = Edits()) -> DataFrame:
    """(conv_id, place, role, text, edit): the repaired conversations by the audits of ``repair_totals``.

    Rows of one conversation come in order, one after another in one partition: they stream through its task, sorted
    by Spark; only the audit is held.
    """
    empty = F.lit(None)
    heads = totals.select("conv_id", F.lit(0).alias("tag"), empty.cast("long").alias("turn"), empty.cast("string").alias("role"),
                          empty.cast("binary").alias("key"), empty.cast("string").alias("text"), empty.cast("long").alias("n"), "audit")
    rows = turns.select("conv_id", F.lit(1).alias("tag"), "turn", "role", F.unhex(F.md5("text")).alias("key"), "text", "n",
                        empty.cast("string").alias("audit"))
    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "tag", "turn", "role", "key")
    both = both.select("conv_id", "audit", "role", "text", "n")
    return both.mapInArrow(_walked(rules, edits, _arrow(turns.sparkSession, TURNS)), TURNS)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n) of a conversations table: null roles and texts are one space, ``n`` is 1."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), *spaced, F.lit(1).cast("long").alias("n")
    )


def repair_conversations(
    conversations: DataFrame, rules=CHAT, edits: Edits = Edits(), slice_rows: int = SLICE_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(``repair_totals``, ``repaired_turns``) of a table with conv_id, turn, role and text; others are not read.

    A conversation's rows go by turn, null turns first, then by role and digest of the text. A row's first fault
    counts: blank (no character but white space), duplicate (its role and text stood earlier in the conversation),
    truncated (the last character is none of ``.!?``). Blank and duplicate rows have to go. Rows whose conv_id is null
    are one conversation; a row without a role's initial can't be kept. An empty table gives two empty tables.
    """
    turns = ordered_turns(conversations)
    totals = repair_totals(turns, rules, edits, slice_rows)
    return totals, repaired_turns(turns, totals, rules, edits)


# ---- the query --------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``ordered_turns`` after damage by a hash of conversation and turn: some rows are dropped, emptied, cut off,
    doubled or given to the user."""
    turns = ordered_turns(conversations)
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat(name[0], F.lit(":"), name[1])), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    n = F.when(kind == 3, 2).otherwise(1).cast("long")
    return turns.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), n.alias("n"))


def _digested(schema: pa.Schema) -> Callable:
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, state = NEVER, None
        for row_conv, _, role, text, _ in _rows(batches):
            if conv is NEVER or row_conv != conv:
                if state is not None:
                    yield conv, state.hexdigest()
                conv, state = row_conv, hashlib.sha256(f"{role}:{text}".encode())
            else:
                state.update(f"\n{role}:{text}".encode())
        if state is not None:
            yield conv, state.hexdigest()

    return lambda batches: _written(digests(batches), schema)


def repair_digests(conversations: DataFrame) -> DataFrame:
    """One row per conv_id, those left without rows by the damage among them: the totals and ``repaired_sha256``.

    The digest is one over a conversation's whole repaired text, so its rows pass through one task, one by one.
    """
    spark = conversations.sparkSession
    turns = damaged(conversations)
    totals = repair_totals(turns)
    schema = "conv_id long, repaired_sha256 string"
    digests = repaired_turns(turns, totals).mapInArrow(_digested(_arrow(spark, schema)), schema)
    convs = conversations.select(F.col("conv_id").cast("long")).distinct()
    whole = convs.join(totals, convs["conv_id"].eqNullSafe(totals["conv_id"]), "left")
    whole = whole.join(digests, convs["conv_id"].eqNullSafe(digests["conv_id"]), "left")
    numbers = [F.coalesce(totals[c], F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select(
        convs["conv_id"],
        *numbers,
        F.coalesce(totals["audit"], F.lit("")).alias("audit"),
        F.coalesce(digests["repaired_sha256"], F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
