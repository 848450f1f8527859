"""Conversation repair: the search against all edits, segments against none, the query against a plain loop."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from tagmill.llm import conversation_repair as cr
from tagmill.llm import queries

D = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, edits string, at int"
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_GOOD = re.compile(r"(s?(ua)+)?\Z")


def kinds_of(rows: list[tuple]) -> list[tuple[str, str | None]]:
    """(role, first fault) of rows (role, text)."""
    seen, found = set(), []
    for role, text in rows:
        letters = _WORD.findall(text)
        fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None
        seen.add((role, text))
        found.append((role, fault))
    return found


def cheapest_by_enumeration(rows: list[tuple[str, str | None]], most_inserts: int = 2) -> tuple[int, str]:
    """(cost, audit) among all edits, with up to ``most_inserts`` rows inserted at each place."""
    choices = [[("D", "", 2)] + ([] if fault in ("blank", "duplicate") else [(e, r, c + (5 if fault == "truncated" else 0)) for e, r, c in (("K", role[:1], 0), ("R", "u", 1), ("R", "a", 1))]) for role, fault in rows]
    inserts = [i for k in range(most_inserts + 1) for i in product("ua", repeat=k)]
    best = None
    for edits in product(*choices):
        for put in product(inserts, repeat=len(rows) + 1):
            roles, audit, cost = "".join(put[0]), "I" * len(put[0]), 5 * len(put[0])
            for (e, r, c), more in zip(edits, put[1:], strict=True):
                roles, audit, cost = roles + r + "".join(more), audit + e + "I" * len(more), cost + c + 5 * len(more)
            if (best is None or (cost, audit) < best) and _GOOD.match(roles):
                best = (cost, audit)
    return best


def cheapest_by_strings(rows: list[tuple[str, str | None]]) -> tuple[int, str]:
    """(cost, audit) by a table of whole strings for each state; inserts are relaxed at every place."""
    step = {(s, ""): s for s in ("", "s", "u", "a")} | {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def relaxed(table: dict) -> dict:
        table = dict(table)
        for _ in range(4):
            for (state, r), to in step.items():
                if r in ("u", "a") and state in table:
                    told = (table[state][0] + 5, table[state][1] + "I")
                    if to not in table or told < table[to]:
                        table[to] = told
        return table

    table = {"": (0, "")}
    for role, fault in rows:
        new: dict = {}
        for state, (cost, audit) in relaxed(table).items():
            options = [(state, 2, "D")]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                options += [(step[state, r], c + extra, e) for r, c, e in ((role[:1], 0, "K"), ("u", 1, "R"), ("a", 1, "R")) if (state, r) in step]
            for to, c, e in options:
                told = (cost + c, audit + e)
                if to not in new or told < new[to]:
                    new[to] = told
        table = new
    return min(v for s, v in relaxed(table).items() if s in ("", "a"))


def searched(rows: list[tuple[str, str | None]]) -> tuple[int, str]:
    told: list[str] = []
    search = cr.Repair(cr.START, lambda row, edits: told.append(edits))
    cost = 0
    for role, fault in rows:
        before = search.front
        search.row({}, (role[:1], fault == "truncated", fault in ("blank", "duplicate")))
        cost += before.after((role[:1], fault == "truncated", fault in ("blank", "duplicate")))[1]
    state, tail = search.front.end()
    cost += search.front.costs[state] + 5 * len(tail)
    assert search.end(None) == tail
    return cost, "".join(told) + tail


ROLES, FAULTS = ["user", "assistant", "system", " ", "", "ua"], [None, None, "truncated", "blank"]


def test_search_equals_all_edits():
    cases = [list(c) for n in range(3) for c in product(product(["user", "assistant", "system", "tool"], [None, "truncated", "blank"]), repeat=n)]
    for rows in cases:
        assert searched(rows) == cheapest_by_enumeration(rows) == cheapest_by_strings(rows), rows
    rng = random.Random(5)
    for _ in range(40):
        rows = [(rng.choice(ROLES), rng.choice(FAULTS)) for _ in range(3)]
        assert searched(rows) == cheapest_by_enumeration(rows, 1 if len(rows) > 3 else 2), rows


def test_search_equals_whole_strings_on_long_conversations():
    rng = random.Random(6)
    for n in [5, 8, 13, 40, 200]:
        for _ in range(60 if n < 100 else 5):
            roles = rng.choice([ROLES, ["user", "assistant"], ["user", "user", "assistant"], ["assistant", "tool"]])
            rows = [(rng.choice(roles), rng.choice(FAULTS)) for _ in range(n)]
            assert searched(rows) == cheapest_by_strings(rows), rows


def test_settled_edits_leave_memory():
    """Fronts are few, and a long alternating conversation holds few rows at a time."""
    given: list[int] = []
    search, most = cr.Repair(cr.START, lambda row, edits: given.append(row["i"])), 0
    rng = random.Random(1)
    for i in range(50_000):
        search.row({"i": i}, (rng.choice("uaauu s"[: 5 + i % 3]), rng.random() < 0.2, rng.random() < 0.1))
        most = max(most, i + 1 - len(given))
    search.end(None)
    assert given == list(range(50_000)) and most < 200 and len(cr.Front._known) < 5000


def plain_report(rows: list[tuple]) -> tuple:
    """The query's columns of one conversation's rows (turn, role, text) in order."""
    kinds = kinds_of([(r, t) for _, r, t in rows])
    cost, audit = cheapest_by_strings(kinds)
    count = lambda f: sum(k[1] == f for k in kinds)
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    turns = {t for t, _, _ in rows if t is not None}
    said, left, state = [], list(rows), ""
    for e in audit:
        role = "user" if state in ("", "s", "a") else "assistant"
        _, own, text = ("", role, "") if e == "I" else left.pop(0)
        if e != "D":
            role = own if e == "K" else role
            said.append(f"{role}:{text}")
            state = role[:1] or state
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def plain_damage(rows: list[tuple]) -> dict:
    """conv_id to rows after damage, in order."""
    found: dict = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine = found.setdefault(conv, [])
        if kind:
            mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()[:16])
    return {c: sorted(r, key=key) for c, r in found.items()}


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("bits", [16, 1])
def test_query_equals_plain_loop(spark, monkeypatch, bits):
    """With segments of two rows, nearly every conversation is put together from several."""
    monkeypatch.setattr(cr, "SEGMENT_BITS", bits)
    out = queries.op11_conversation_repair(spark, D)
    assert out.dtypes == [("conv_id", "bigint"), *((c, "bigint") for c in NAMES[1:7]), ("audit", "string"), ("repaired_sha256", "string")]
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: plain_report(r) for c, r in plain_damage(rows).items()}
    assert {r.conv_id: tuple(r)[1:] for r in out.collect()} == want


@pytest.mark.parametrize("bits", [16, 2])
def test_odd_rows(spark, monkeypatch, tmp_path, bits):
    monkeypatch.setattr(cr, "SEGMENT_BITS", bits)
    rng = random.Random(bits)
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "A."), (1, None, "assistant", "B."), (1, 3, "user", "A."), (1, 3, "user", "A."), (2, 1, "", ""), (2, 9, "usher", "odd role.\n"), (3, 5, "system", " \x0b ")]
    rows += [(4, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", "", f"{i}!", "long " * 50_000])) for i in range(60)]
    rows += [(5, 7, "user", "copied")] * 50 + [(6, t, "user", "same.") for t in range(40)] + [(7, -(2**62), "user", "low"), (7, 2**62, "assistant", "high.")]
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    want = {c: plain_report(r) for c, r in plain_damage(rows).items()}
    assert got == {c: (min(w[0], 2**63 - 1), *w[1:]) for c, w in want.items()}


def test_repaired_rows_alternate(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    out: dict = {}
    for r in cr.repaired_rows(cr.repair(rows), rows).orderBy("conv_id", "at", "part").collect():
        out.setdefault(r.conv_id, []).append(r)
    assert out and all(_GOOD.match("".join(r.role[0] for r in mine)) for mine in out.values())
    assert cr.repair(rows.limit(0)).count() == 0
