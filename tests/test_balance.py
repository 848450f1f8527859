"""Least-used choices against one-by-one checks."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

from tagmill.operators.balance import least_used, levelled, poured


def test_pouring_levels():
    rng = random.Random(1)
    for _ in range(3000):
        loads, amount = [rng.randint(0, 6) for _ in range(rng.randint(1, 6))], rng.randint(0, 12)
        got = poured(loads, amount)
        full = [a + b for a, b in zip(loads, got, strict=True)]
        assert sum(got) == amount and min(got) >= 0
        assert max([f for f, g in zip(full, got, strict=True) if g], default=0) - min(full) <= 1


def test_no_option_leads_by_two():
    """The most used option carries no more than any way of dealing must: the rows that have nothing outside some set, shared by that set."""
    rng = random.Random(2)
    for _ in range(200):
        names = "abcde"[: rng.randint(1, 5)]
        sets = sorted({tuple(sorted(rng.sample(names, rng.randint(1, len(names))))) for _ in range(rng.randint(1, 8))})
        counts = [rng.randint(1, 40) for _ in sets]
        dealt = levelled([list(s) for s in sets], counts)
        uses = Counter()
        for s, row, n in zip(sets, dealt, counts, strict=True):
            assert sum(row) == n and min(row) >= 0
            uses.update(dict(zip(s, row, strict=True)))
        for s, row in zip(sets, dealt, strict=True):
            assert all(uses[o] - min(uses[x] for x in s) <= 1 for o, n in zip(s, row, strict=True) if n)
        must = max(-(-sum(n for s, n in zip(sets, counts, strict=True) if set(s) <= set(t)) // k) for k in range(1, len(names) + 1) for t in combinations(names, k))
        assert max(uses.values()) == must


def test_rows_are_dealt_inside_groups(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["g", "h", None]), [o for o in ["p", "q", None, "r"] if rng.random() < 0.6], "x") for i in range(400)] + [(900, "g", None, "x"), (901, "g", [], "x"), (902, "g", ["p"], "x"), (902, "g", ["p"], "x")]
    out = least_used(spark.createDataFrame(rows, "id long, team string, options array<string>, chosen_by string"), "options", "id", ["team"]).collect()
    assert len(out) == len(rows)
    uses: dict = defaultdict(Counter)
    for r in out:
        own = [o for o in r.options or [] if o]
        assert (r.chosen in own) if own else r.chosen is None
        uses[r.team][r.chosen] += 1
    for r in out:
        own = [o for o in r.options or [] if o]
        assert not own or uses[r.team][r.chosen] - min(uses[r.team][o] for o in own) <= 1
    assert least_used(spark.createDataFrame([], "id long, options array<string>"), "options", "id").count() == 0
