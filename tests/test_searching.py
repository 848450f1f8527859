"""Decoding by search: against enumeration, with many candidates, with a spent budget and where rules can't all be kept."""

from __future__ import annotations

import random
from itertools import product

import pytest

from tagmill.operators.searching import STEP, Problem, Rule, beam, decode_by_search, search, solved

TASKS = {"a": (1, 1), "b": (0, 2), "c": (1, 3)}


def some(rng: random.Random, per: int) -> tuple[list, list]:
    cands = [(t, f"{t}{i}", round(rng.uniform(-1, 1), 2)) for t in TASKS for i in range(rng.randint(1, per))]
    names = [f"{t}:{x}" for t, x, _ in cands] + ["a:unknown"]
    rules = []
    for n in range(rng.randint(0, 5)):
        labels = tuple(rng.choice(["", "!"]) + x for x in rng.sample(names, min(len(names), rng.randint(2, 4))))
        least = rng.randint(0, 2)
        rules.append(Rule(f"r{n}", labels, least, rng.randint(least, 3)))
    return cands, rules


def enumerated(cands: list, rules: list[Rule]) -> tuple:
    """(number of broken rules, -worth, labels) of the best of all assignments."""
    best = None
    for bits in product([False, True], repeat=len(cands)):
        chosen = {(t, x) for (t, x, _), b in zip(cands, bits, strict=True) if b}
        if all(low <= sum(t == task for t, _ in chosen) <= high for task, (low, high) in TASKS.items()):
            holds = lambda name: (tuple(name.lstrip("!").split(":")) in chosen) != name.startswith("!")  # noqa: E731, B023
            broken = sum(not r.least <= sum(map(holds, r.labels)) <= r.most for r in rules)
            worth = sum(round(u * STEP) for (t, x, u) in cands if (t, x) in chosen)
            told = (broken, -worth, tuple(tuple(sorted(x for t, x in chosen if t == task)) for task in TASKS))
            best = min(best, told) if best else told
    return best


def test_search_equals_enumeration():
    rng = random.Random(1)
    for _ in range(150):
        cands, rules = some(rng, 4)
        found = search(Problem(cands, TASKS, rules), 10**6)
        assert (len(found.broken), -found.worth, found.labels) == enumerated(cands, rules) and found.how == "exact"
        wide = beam(Problem(cands, TASKS, rules), 10**6, False)
        assert (len(wide.broken), -wide.worth, wide.labels) == enumerated(cands, rules)
        narrow = beam(Problem(cands, TASKS, rules), 2, True)
        assert narrow is None or (not narrow.broken and narrow.worth <= -enumerated(cands, rules)[1])


def test_forty_candidates_and_a_spent_budget():
    rng = random.Random(2)
    cands = [("a", f"a{i}", rng.uniform(-1, 1)) for i in range(10)] + [("b", f"b{i}", rng.uniform(-1, 1)) for i in range(15)] + [("c", f"c{i}", rng.uniform(-1, 1)) for i in range(15)]
    rules = [Rule(f"r{i}", (f"b:b{i}", f"c:c{i}"), most=1) for i in range(15)] + [Rule("s", ("!a:a1", "c:c2"), least=1)]
    found = solved(Problem(cands, TASKS, rules), 200_000, 16, "raise")
    assert found.how == "exact" and not found.broken and 0 < found.nodes < 200_000
    short = solved(Problem(cands, TASKS, rules), 5, 16, "raise")
    assert short.how == "beam" and not short.broken and short.worth <= found.worth


def test_where_rules_cannot_all_be_kept(spark):
    rows = [(1, "a", "x", 0.9), (1, "a", "y", 0.1), (1, "c", "z", 0.5), (2, "a", "x", 0.2), (2, "c", "z", None), (3, "a", "x", 0.3), (4, "c", None, 0.1), (1, "other", "w", 9.0), (1, "a", "y", 0.4)]
    table = spark.createDataFrame([(*r, "kept?") for r in rows], "id int, task string, label string, utility double, how string")
    tasks = {"a": (1, 1), "c": (1, 2)}
    rules = [Rule("no x", ("!a:x",), least=1), Rule("no y", ("!a:y",), least=1), Rule("z", ("c:z",), least=1)]
    out = {r.id: r for r in decode_by_search(table, ["id"], tasks, rules).collect()}
    assert (out[1].a, out[1].c, out[1].broken, out[1].how, round(out[1].utility, 6)) == (["x"], ["z"], ["no x"], "exact", 1.4)
    assert (out[2].broken, out[2].utility) == (["no x"], 0.2) and out[3].how == out[4].how == "none" and out[3].a is None
    relaxed = {r.id: r for r in decode_by_search(table.filter("id < 3"), ["id"], tasks, [Rule("no x", ("!a:x",), least=1), Rule("no y", ("!a:y",), least=1), Rule("no z", ("!c:z",), least=1)], infeasible="relax").collect()}
    assert relaxed[1].a == ["x"] and relaxed[1].broken == ["no x", "no z"] and relaxed[1].how == "relaxed"
    with pytest.raises(Exception, match="no assignment keeps all rules"):
        decode_by_search(table.filter("id < 3"), ["id"], tasks, rules, infeasible="raise").collect()
    with pytest.raises(ValueError, match="unknown policy"):
        decode_by_search(table, ["id"], tasks, rules, infeasible="hope")
    assert decode_by_search(table.limit(0), ["id"], tasks, rules).count() == 0
