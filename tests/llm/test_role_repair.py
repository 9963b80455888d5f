"""Repair of conversations against a search over all edits in the order of (cost, audit)."""

import hashlib
import heapq
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowward.llm import role_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FULL = {"u": "user", "a": "assistant"}


def in_order(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest())
    return sorted(rows, key=key)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired lines): the first end that a search by (cost, audit) reaches."""
    kinds = faults(rows)
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, made = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, made
        for x, name in FULL.items():
            if (state, x) in NEXT:
                heapq.heappush(heap, (cost + 5, audit + "I", i, NEXT[state, x], (*made, name + ":")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, made))
        if kinds[i] in ("blank", "duplicate"):
            continue
        extra = 5 if kinds[i] else 0
        if (state, role[:1]) in NEXT:
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, NEXT[state, role[:1]], (*made, f"{role}:{text}")))
        for x, name in FULL.items():
            if (state, x) in NEXT:
                heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, NEXT[state, x], (*made, f"{name}:{text}")))


def expected(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in convs.items():
        own = in_order(own)
        kinds, turns = faults(own), [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, made = cheapest(own)
        out[conv] = (gaps, *map(kinds.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, list(made))
    return out


def repaired(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("edit", F.lit("mine")).withColumn("n", F.lit("mine"))
    totals, turns = R.repair_conversations(table, **options)
    lines = defaultdict(list)
    for r in turns.orderBy("place").collect():
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    return {r["conv_id"]: (*tuple(r)[1:], lines[r["conv_id"]]) for r in totals.collect()}


def mixed(n, convs):
    rnd = random.Random(n)
    texts = [None, "", " \n", "Hi.", "What?", "cut off", "well! ", "b.\n"]
    roles = [None, "user", "assistant", "system", "tool", "", "unknown"]
    rows = []
    for _ in range(n):
        text = rnd.choice(texts) if rnd.random() < 0.4 else f"{rnd.randrange(40)}{rnd.choice('.!?,')}"
        rows.append((rnd.choice(convs), rnd.choice([None, *range(n)]), rnd.choice(roles), text))
    return rows + rows[:5]


@pytest.mark.parametrize("slice_rows", [1024, 5, 1])
def test_repairs_are_the_cheapest(spark, slice_rows):
    rows = mixed(400, [None, 1, 1, 1, 1, *range(2, 60)])  # one conversation has more than half of all rows
    assert repaired(spark, rows, slice_rows=slice_rows) == expected(rows)


def test_clean_conversations_stay(spark):
    rows = [(1, k, ("system", "user", "assistant", "user", "assistant")[k], f"turn {k}.") for k in range(5)]
    assert repaired(spark, rows)[1][5:7] == (0, "KKKKK")
    totals, turns = R.repair_conversations(spark.createDataFrame([], SCHEMA))
    assert totals.count() == 0 and turns.count() == 0


def test_long_texts_and_many_copies(spark):
    long = "x" * 1_000_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", "yes."), *[(1, 1, "assistant", "yes.")] * 500]
    found = repaired(spark, rows)[1]
    assert found[2] == 500 and found[5] == 1000 and found[6] == "KK" + "D" * 500
    assert found[7] == [f"user:{long}", "assistant:yes."]


def test_damage_leaves_every_conversation_in_the_answer(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"text {t}.") for c in [None, *range(150)] for t in range((c or 3) % 40)]
    rows += [(c, 1, "user", "alone.") for c in range(200, 260)]  # some of them lose their only row
    table = spark.createDataFrame(rows, SCHEMA)
    left = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in R.damaged(table).collect() for _ in range(r["n"])]
    wanted = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows}
    for conv, (*numbers, lines) in expected(left).items():
        wanted[conv] = (*numbers, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    assert {r["conv_id"]: tuple(r)[1:] for r in R.repair_digests(table).collect()} == wanted
    assert any(c not in {r[0] for r in left} for c in wanted)


def test_the_grammar_decides(spark):
    stacks = R.Stacks((("list", ()), ("list", ("list", "q", "r")), ("list", ("list", "q"))))
    tops = {0}
    for x in "qrq":
        tops = {to for t in tops for to in stacks.shift(t, x)}
    assert any(stacks.accepting[t] for t in tops) and not any(stacks.shift(t, "r") for t in stacks.shift(0, "r"))
    with pytest.raises(ValueError):  # right recursion piles up
        R.Stacks((("list", ()), ("list", ("q", "list"))))
    with pytest.raises(ValueError):
        R.Repair(edits=R.Edits(insert=0))
