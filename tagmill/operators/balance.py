"""Least-used choices: rows with option sets of their own are dealt so that options are used as evenly as the sets allow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_order
from tagmill.operators.corpus import beside
from tagmill.operators.ranking import ranked


def poured(loads: list[int], amount: int) -> list[int]:
    """How much each of ``loads`` gets of ``amount``, so that what gets any ends level; what can't be shared evenly goes to the first."""
    order = sorted(range(len(loads)), key=lambda i: (loads[i], i))
    filled, under = len(order), sum(loads)
    while filled > 1 and loads[order[filled - 1]] * filled >= amount + under:  # the fullest cup stands at the level or above
        filled -= 1
        under -= loads[order[filled]]
    level, more = divmod(amount + under, filled)
    got = [0] * len(loads)
    for n, i in enumerate(sorted(order[:filled])):
        got[i] = level + (n < more) - loads[i]
    return got


def levelled(sets: list[list[str]], counts: list[int]) -> list[list[int]]:
    """For each set of options the number of its rows that each option gets.

    Sets are poured one after another, each over what the others use, and again as long as one of them uses an option
    that leads another of the same set by two or more. Rows are then passed on along chains of sets, one by one. Each such step
    lowers the sum of squared uses, so it ends; then no other dealing has a smaller largest or a larger smallest use.
    """
    used: dict[str, int] = {o: 0 for s in sets for o in s}
    dealt: list[list[int]] = [[0] * len(s) for s in sets]
    first, uneven = True, True
    while uneven:
        uneven = False
        for i, (options, count) in enumerate(zip(sets, counts, strict=True)):
            if not first:
                taken = [used[o] for o, n in zip(options, dealt[i], strict=True) if n]
                if not taken or max(taken) - min(used[o] for o in options) <= 1:
                    continue
            for o, n in zip(options, dealt[i], strict=True):
                used[o] -= n
            dealt[i] = poured([used[o] for o in options], count)
            for o, n in zip(options, dealt[i], strict=True):
                used[o] += n
            uneven = True
        first = False
    while _passed_on(sets, dealt, used):
        pass
    return dealt


def _passed_on(sets: list[list[str]], dealt: list[list[int]], used: dict[str, int]) -> bool:
    """Move one row along a chain of sets from an option to one that is used two times less; False if there is no such chain.

    A chain goes from option to option of a set that has a row on the first; the fullest options are tried first.
    """
    ways: dict[str, list[tuple[int, int]]] = {o: [] for o in used}
    for i, options in enumerate(sets):
        for k, o in enumerate(options):
            if dealt[i][k]:
                ways[o].append((i, k))
    tried: set[str] = set()
    for start in sorted(used, key=lambda o: (-used[o], o)):
        came: dict[str, tuple[int, int, int] | None] = {start: None}
        queue = [start]
        for here in queue:
            if used[here] <= used[start] - 2:
                used[start] -= 1
                used[here] += 1
                while came[here]:
                    i, k, to = came[here]
                    dealt[i][k] -= 1
                    dealt[i][to] += 1
                    here = sets[i][k]
                return True
            for i, k in ways[here]:
                for to, o in enumerate(sets[i]):
                    if o not in came and o not in tried:
                        came[o] = (i, k, to)
                        queue.append(o)
        tried |= came.keys()  # whatever these reach is used as much as the start, which was fuller
    return False


def least_used(rows: DataFrame, options: str, key: str, group: list[str] | None = None, seed: int = 42) -> DataFrame:
    """``rows`` with ``chosen``, one of the array of strings ``options``, options being used as evenly as can be inside each ``group``.

    Equal option sets are counted together; a group's sets, not its rows, meet in one task and are levelled there. Rows of a set
    are then ranked by hash over range partitions and dealt by place. The greatest lead of an option over another that
    the same rows could have taken is one. Null options don't count; without an option ``chosen`` is null; null groups
    are groups.
    """
    group = group or []
    marked = rows.withColumn("_set", F.array_sort(F.array_distinct(F.filter(options, lambda o: o.isNotNull()))))
    counted = marked.filter(F.size("_set") > 0).groupBy(*group, "_set").agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1))

    def level(sets: pd.DataFrame) -> pd.DataFrame:
        lists = [list(s) for s in sets["_set"]]
        order = sorted(range(len(lists)), key=lambda i: lists[i])
        found = levelled([lists[i] for i in order], [int(sets["_n"].iloc[i]) for i in order])
        out = sets[[*group, "_set"]].iloc[order].copy()
        out["_upto"] = [pd.Series(f).cumsum().tolist() for f in found]
        return out

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in group]
    shares = counted.groupBy(*group, "_one").applyInPandas(level, ", ".join([*own, "_set array<string>", "_upto array<long>"]))
    placed = ranked(marked, [*group, "_set"], [hash_order(seed, F.col(key)), key], "_r")
    at = F.size(F.filter("_upto", lambda n: n < F.col("_r"))) + 1
    return beside(placed, shares, [*group, "_set"], "left").select(*rows.columns, F.try_element_at("_set", at.cast("int")).alias("chosen"))
