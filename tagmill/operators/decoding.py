"""Constrained decoding as joins: candidates kept, local assignments enumerated, the best joint one chosen."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of one task and row, at most: assignments are enumerated, two to that power.
MOST = 12


def retain(candidates: DataFrame, keys: list[str], cap: int, rescued: Column | None = None) -> DataFrame:
    """At most ``cap`` ``candidates`` (keys, label, utility) of each key: the rescued first, then by utility, ties by label."""
    first = F.coalesce(rescued, F.lit(False)) if rescued is not None else F.lit(False)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(first.cast("int")), F.desc("utility"), "label"))
    return candidates.withColumn("_n", place).filter(F.col("_n") <= cap).drop("_n")


def assignments(candidates: DataFrame, keys: list[str], least: int = 0, most: int = MOST) -> DataFrame:
    """(keys, labels, utility): every set of ``least`` to ``most`` labels of each key's ``candidates`` (keys, label, utility).

    Labels are sorted; a key with over MOST candidates fails the job, as nothing may be left out: ``retain`` comes before.
    An exclusive task has least = most = 1. Null labels don't count; a label told twice counts with its best utility.
    """
    one = candidates.filter("label is not null").groupBy(*keys, "label").agg(F.max("utility").alias("utility"))
    per = one.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("label", "utility"))).alias("c"))
    bounded = F.when(F.size("c") > MOST, F.raise_error(F.lit("too many candidates"))).otherwise(F.size("c"))
    masks = F.sequence(F.lit(0), (F.pow(F.lit(2), bounded) - 1).cast("int"))
    fits = F.filter(masks, lambda m: F.bit_count(m).between(least, most))
    chosen = F.filter("c", lambda x, i: F.getbit("mask", i) == 1)
    return per.select(*keys, "c", F.explode(fits).alias("mask")).select(*keys, F.transform(chosen, lambda x: x["label"]).alias("labels"), F.aggregate(chosen, F.lit(0.0).cast("double"), lambda a, x: a + x["utility"]).alias("utility"))


def decode(tasks: dict[str, DataFrame], keys: list[str], rules: dict[str, Callable[[dict[str, Column]], Column]]) -> DataFrame:
    """(keys, a column of labels for each task, utility, broken): the assignment of all tasks that breaks the fewest ``rules``, then is worth most.

    A key that lacks an assignment in some task has no labels there, worth 0. Beyond a dozen candidates see ``searching``.

    ``tasks`` holds the tables of ``assignments``; a rule sees each task's labels and is broken where it is false. The search
    is exact: a row's assignments are joined on its keys, so its size is the product of its tasks' choices, which ``retain``
    bounds. ``broken`` are the names of the rules that even the best one breaks. Ties go to the labels earlier in order.
    """
    joined: DataFrame | None = None
    for name, table in tasks.items():
        own = table.select(*keys, F.col("labels").alias(name), F.col("utility").alias(f"_u_{name}"))
        joined = own if joined is None else joined.join(own, keys, "full_outer")
    none = F.array().cast("array<string>")
    joined = joined.select(*keys, *(F.coalesce(n, none).alias(n) for n in tasks), *(F.coalesce(f"_u_{n}", F.lit(0.0)).alias(f"_u_{n}") for n in tasks))
    chosen = {n: F.col(n) for n in tasks}
    broken = F.filter(F.array(*(F.when(~F.coalesce(rule(chosen), F.lit(True)), n) for n, rule in rules.items())), lambda x: x.isNotNull())
    total = F.round(reduce(lambda a, b: a + b, (F.col(f"_u_{n}") for n in tasks)), 9)
    scored = joined.select(*keys, *tasks, total.alias("utility"), broken.alias("broken"))
    order = F.struct(F.size("broken").alias("b"), (-F.col("utility")).alias("u"), *tasks)
    best = scored.groupBy(*keys).agg(F.min_by(F.struct(*tasks, "utility", "broken"), order).alias("s"))
    return best.select(*keys, "s.*")
