"""Constrained decoding by search: best-first branch and bound with a budget, a beam beside it, and what to do where no assignment keeps all rules."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Utilities are compared in steps of one billionth, so that equal sums are equal.
STEP = 10**9


class Rule(NamedTuple):
    """From ``least`` to ``most`` of ``labels`` hold: "task:label" if it is chosen, "!task:label" if it is not.

    "a implies b" is at least one of !a, b; "a excludes b" at most one of a, b. A label that is no candidate is not chosen.
    """

    name: str
    labels: tuple[str, ...]
    least: int = 0
    most: int = 1 << 30


class Problem:
    """One row's candidates: labels are decided one after another, those of largest absolute utility first."""

    def __init__(self, candidates: list[tuple[str, str, float]], tasks: dict[str, tuple[int, int]], rules: list[Rule]):
        best: dict[tuple[str, str], int] = {}
        for task, label, utility in candidates:
            value = round((utility or 0.0) * STEP)
            best[task, label] = max(value, best.get((task, label), value))
        self.order = sorted(best, key=lambda c: (-abs(best[c]), c))
        self.worth = [best[c] for c in self.order]
        place = {f"{t}:{x}": i for i, (t, x) in enumerate(self.order)}
        self.tasks, self.rules = tasks, rules
        own = [Rule(f"{t} takes {low} to {high}", tuple(f"{t}:{x}" for s, x in self.order if s == t), low, high) for t, (low, high) in tasks.items()]
        self.hard = len(own)
        self.limits, self.seen_in, self.open = [], [[] for _ in self.order], []
        for n, rule in enumerate([*own, *rules]):
            fixed, left = 0, 0
            for name in rule.labels:
                positive, i = not name.startswith("!"), place.get(name.lstrip("!"))
                if i is None:
                    fixed += not positive
                else:
                    self.seen_in[i].append((n, positive))
                    left += 1
            self.limits.append((rule.least, rule.most))
            self.open.append((fixed, left))
        self.names = [r.name for r in rules]
        # for each task its labels in order of worth with their places, for the bound
        self.by_task = {t: sorted(((self.worth[i], i) for i, (s, _) in enumerate(self.order) if s == t), reverse=True) for t in tasks}

    def start(self) -> tuple:
        """The state before any decision: (true, undecided) of each rule."""
        return tuple(self.open)

    def decide(self, state: tuple, at: int, chosen: bool) -> tuple:
        new = list(state)
        for n, positive in self.seen_in[at]:
            true, left = new[n]
            new[n] = (true + (chosen == positive), left - 1)
        return tuple(new)

    def broken(self, state: tuple) -> tuple[bool, int]:
        """(whether a task's own number can't be met any more, how many rules can't be kept any more)."""
        bad = [true > most or true + left < least for (true, left), (least, most) in zip(state, self.limits, strict=True)]
        return any(bad[: self.hard]), sum(bad[self.hard :])

    def bound(self, state: tuple, at: int, so_far: int) -> int:
        """No completion is worth more: each task takes its best undecided labels as its own number allows, whatever the rules say."""
        total = so_far
        for n, task in enumerate(self.tasks):
            (true, _), (least, most) = state[n], self.limits[n]
            taken = true
            for worth, i in self.by_task[task]:
                if i >= at and taken < most and (worth > 0 or taken < least):
                    total += worth
                    taken += 1
        return total

    def labels(self, bits: tuple[bool, ...]) -> tuple:
        """The sorted labels of each task."""
        return tuple(tuple(sorted(x for (s, x), b in zip(self.order, bits, strict=True) if b and s == t)) for t in self.tasks)


class Found(NamedTuple):
    """An assignment: its labels by task, its worth in steps, the names of the rules it breaks, how it was found and after how many nodes."""

    labels: tuple
    worth: int
    broken: list[str]
    how: str
    nodes: int


def _told(problem: Problem, bits: tuple, state: tuple, worth: int, how: str, nodes: int) -> Found:
    bad = [n for n, ((true, _), (least, most)) in zip(problem.names, list(zip(state, problem.limits, strict=True))[problem.hard :], strict=True) if not least <= true <= most]
    return Found(problem.labels(bits), worth, bad, how, nodes)


def search(problem: Problem, budget: int) -> Found | None:
    """The assignment that breaks the fewest rules and then is worth most, ties to the labels earlier in order; None if ``budget`` nodes don't do.

    Nodes are taken by the rules surely broken and the bound, so the first complete one is best; those as good are looked at too.
    """
    count, best = len(problem.order), None
    state = problem.start()
    heap = [(problem.broken(state)[1], -problem.bound(state, 0, 0), 0, (), state, 0)] if not problem.broken(state)[0] else []
    nodes = made = 0
    while heap:
        bad, below, _, bits, state, worth = heapq.heappop(heap)
        if best and (bad, below) > best[0]:
            break
        nodes += 1
        if nodes > budget:
            return None
        if len(bits) == count:
            told = ((bad, below), problem.labels(bits), bits, state, worth)
            best = min(best, told) if best else told
            continue
        for chosen in (True, False):
            after = problem.decide(state, len(bits), chosen)
            impossible, bad = problem.broken(after)
            if not impossible:
                gained = worth + (problem.worth[len(bits)] if chosen else 0)
                made += 1
                heapq.heappush(heap, (bad, -problem.bound(after, len(bits) + 1, gained), made, (*bits, chosen), after, gained))
    return _told(problem, best[2], best[3], best[4], "exact", nodes) if best else Found((), 0, list(problem.names), "none", nodes)


def beam(problem: Problem, width: int, strict: bool) -> Found | None:
    """As ``search`` with the ``width`` best nodes of each level only; ``strict`` leaves out nodes that break a rule. None if no node is left."""
    state = problem.start()
    level, nodes = [(0, -problem.bound(state, 0, 0), (), state, 0)], 0
    for at in range(len(problem.order)):
        grown = []
        for _, _, bits, state, worth in level:
            for chosen in (True, False):
                nodes += 1
                after = problem.decide(state, at, chosen)
                impossible, bad = problem.broken(after)
                if not impossible and not (strict and bad):
                    gained = worth + (problem.worth[at] if chosen else 0)
                    grown.append((bad, -problem.bound(after, at + 1, gained), (*bits, chosen), after, gained))
        level = sorted(grown)[:width]
    if not level:
        return None
    _, _, bits, state, worth = min(level, key=lambda x: (x[0], x[1], problem.labels(x[2])))
    return _told(problem, bits, state, worth, "beam", nodes)


def solved(problem: Problem, budget: int, width: int, infeasible: str) -> Found:
    """The ladder: exact search; with its budget spent a beam that keeps all rules, then one that need not; and ``infeasible`` for the rest.

    Where no assignment that keeps all rules is found, "raise" fails, "relax" takes the best assignment regardless of rules and
    "min_violations" the one that breaks the fewest.
    """
    found = search(problem, budget) or beam(problem, width, True)
    if found and found.how == "none":
        return found
    if found is None or found.broken:
        if infeasible == "raise":
            raise ValueError(f"no assignment keeps all rules; the least broken ones are {', '.join(found.broken) if found else 'unknown, as the budget was spent'}")
        if infeasible == "relax":
            free = search(Problem([(t, x, w / STEP) for (t, x), w in zip(problem.order, problem.worth, strict=True)], problem.tasks, [r._replace(least=0, most=1 << 30) for r in problem.rules]), 1 << 30)
            state = problem.start()
            chosen = {(t, x) for t, xs in zip(problem.tasks, free.labels, strict=True) for x in xs}
            for i, c in enumerate(problem.order):
                state = problem.decide(state, i, c in chosen)
            return _told(problem, tuple(c in chosen for c in problem.order), state, free.worth, "relaxed", free.nodes)
        found = found or beam(problem, width, False)
    return found or Found((), 0, list(problem.names), "none", 0)


def decode_by_search(candidates: DataFrame, keys: list[str], tasks: dict[str, tuple[int, int]], rules: list[Rule], budget: int = 200_000, width: int = 16, infeasible: str = "min_violations") -> DataFrame:
    """(keys, a column of labels for each task, utility, broken, how, nodes) of ``candidates`` (keys, task, label, utility).

    ``tasks`` gives the least and most labels of each. ``how`` is "exact", "beam" where ``budget`` nodes did not do, "relaxed", or "none"
    where a task has too few candidates, whose labels are then null. A key's candidates, of all tasks, meet in one row;
    keys are searched apart. Null labels and unknown tasks don't count; a label told twice counts with its best
    utility, a null one with 0. A key with no candidate at all stands if one of its labels is null; no row gives no row.
    """
    if infeasible not in ("raise", "relax", "min_violations"):
        raise ValueError(f"unknown policy {infeasible}")
    told = F.filter(F.collect_list(F.struct("task", "label", "utility")), lambda c: c["label"].isNotNull() & c["task"].isin(*tasks))
    rows = candidates.withColumn("utility", F.col("utility").cast("double")).groupBy(*keys).agg(told.alias("_c"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [solved(Problem([(c["task"], c["label"], c["utility"]) for c in row], tasks, rules), budget, width, infeasible) for row in batch.column(len(keys)).to_pylist()]
            chosen = [pa.array([list(f.labels[i]) if f.labels else None for f in found], pa.list_(pa.string())) for i in range(len(tasks))]
            rest = [pa.array([f.worth / STEP for f in found], pa.float64()), pa.array([f.broken for f in found], pa.list_(pa.string())), pa.array([f.how for f in found], pa.string()), pa.array([f.nodes for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), *chosen, *rest], [*keys, *tasks, "utility", "broken", "how", "nodes"])

    schema = ", ".join([*kinds, *(f"`{t}` array<string>" for t in tasks), "utility double, broken array<string>, how string, nodes long"])
    return rows.mapInArrow(run, schema)
