"""Cycles: against a plain search, and in how many written tables."""

from __future__ import annotations

import random

from tagmill.operators import graph


def plain(edges: list[tuple[int, int]]) -> set[int]:
    after: dict[int, set[int]] = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    found = set()
    for start in after:
        seen, todo = set(), list(after[start])
        while todo:
            here = todo.pop()
            if here not in seen:
                seen.add(here)
                todo += after.get(here, ())
        if start in seen:
            found.add(start)
    return found


def test_cycles_equal_a_plain_search(spark):
    rng = random.Random(4)
    parts = [[(10, 11), (11, 10), (11, 1), (1, 20), (20, 21), (21, 20)]]  # 1 is least both ways and on no cycle
    for n in (6, 15, 40):
        parts.append([(rng.randrange(n) + 100 * n, rng.randrange(n) + 100 * n) for _ in range(int(n * 1.3))])
    edges = [e for p in parts for e in p] + [(7, 7)]
    rows = [*edges, (None, 3), (3, None), edges[0]]
    got = {r.id for r in graph.cyclic_nodes(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == plain(edges)
    assert graph.cyclic_nodes(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_long_ring_takes_few_tables(spark, monkeypatch):
    n, written = 10_000, []
    names = list(range(n))
    random.Random(9).shuffle(names)
    ring = [(names[i], names[(i + 1) % n]) for i in range(n)] + [(names[0], n + 1)] + [(n + i, n + i + 1) for i in range(1, 500)]
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda frame, label="table": written.append(label) or real(frame, label))
    assert graph.cyclic_nodes(spark.createDataFrame(ring, "a long, b long")).count() == n
    assert len(written) < 40, written
