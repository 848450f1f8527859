"""Constraints as nullable boolean columns: SQL's three-valued logic is Kleene's, null is unknown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def implies(a: Column, b: Column) -> Column:
    return ~a | b


def iff(a: Column, b: Column) -> Column:
    """Unknown if either side is."""
    return a == b


def excludes(a: Column, b: Column) -> Column:
    return ~(a & b)


def cardinality(choices: list[Column], least: int, most: int) -> Column:
    """Whether the number of true ones lies in [least, most]; unknown while unknown ones could decide it."""
    total = lambda unknown: reduce(lambda s, c: s + F.coalesce(c, F.lit(unknown)).cast("int"), choices, F.lit(0))
    low, high = total(False), total(True)
    return F.when((low > most) | (high < least), False).when((low >= least) & (high <= most), True)


def exactly_one(choices: list[Column]) -> Column:
    return cardinality(choices, 1, 1)


def at_least_level(value: Column, levels: list[str], floor: str) -> Column:
    """Whether an ordinal value stands at ``floor`` or higher in ``levels``; unknown for other values."""
    place = F.array_position(F.array(*(F.lit(x) for x in levels)), value)
    return F.when(place > 0, place > levels.index(floor))


def violations(constraints: dict[str, Column]) -> Column:
    """Names of the constraints that are false, in their order; unknown ones are not violated."""
    return F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(True)), n) for n, c in constraints.items())), lambda x: x.isNotNull())


def any_selected(choices: list[Column]) -> Column:
    """Whether one of ``choices`` is true; unknown while none is and one is unknown."""
    return reduce(lambda a, b: a | b, choices, F.lit(False))


def any_other_selected(choices: dict[str, Column], label: str) -> Column:
    """Whether a choice besides ``label`` is true."""
    return any_selected([c for n, c in choices.items() if n != label])


def at_most_level(value: Column, levels: list[str], ceiling: str) -> Column:
    """Whether an ordinal value stands at ``ceiling`` or lower in ``levels``; unknown for other values."""
    place = F.array_position(F.array(*(F.lit(x) for x in levels)), value)
    return F.when(place > 0, place <= levels.index(ceiling) + 1)


def at_level(value: Column, levels: list[str], level: str) -> Column:
    """Whether an ordinal value is exactly ``level``; unknown for values outside ``levels``."""
    return F.when(F.array_contains(F.array(*(F.lit(x) for x in levels)), value), value == level)
