"""Record building: label grids, tagged text, pages, gates, assembly of relation instances, exact decoding of small label sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions.text import with_starts


def first_wins(dimension: DataFrame, name: str, order: str) -> DataFrame:
    """One row for each ``name``, the first by ``order``; a null name is a name, null orders come first, of equal ones any stays."""
    return dimension.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(order))).filter("_n = 1").drop("_n")


def closed_grid(mentions: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """(key, label, surfaces) for every label of the declared space, empty where a record has none: a map lookup, no grid join.

    The order of the surfaces is that of their first start; repeated ones count once; labels that are not declared are
    left out; records without a mention give no row.
    """
    per_label = mentions.groupBy(key, "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("start", "surface"))), lambda x: x["surface"]).alias("surfaces"))
    maps = per_label.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("label", F.array_distinct("surfaces")))).alias("m"))
    label = F.explode(F.array(*(F.lit(x) for x in labels))).alias("label")
    return maps.select(key, "m", label).select(key, "label", F.coalesce(F.try_element_at("m", F.col("label")), F.expr("cast(array() as array<string>)")).alias("surfaces"))


def parse_tags(text: Column) -> Column:
    """array<struct<start,end,label,value>> of ``[value]label`` tags; offsets count in the text without tags; a null text has none."""
    pattern = r"\[([^\[\]]+)\]([a-z_]+)"
    values, labels = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    return F.zip_with(with_starts(values, gaps), labels, lambda m, label: F.struct(m["start"].alias("start"), m["end"].alias("end"), label.alias("label"), m["text"].alias("value")))


def strip_tags(text: Column) -> Column:
    """The text that ``parse_tags`` counts in."""
    return F.regexp_replace(text, r"\[([^\[\]]+)\]([a-z_]+)", "$1")


def page_slices(offsets: DataFrame, key: str, length: str) -> DataFrame:
    """(key, page, start, end) of page starts (key, start): 0 is always one, repeated starts count once; a page ends where the next begins."""
    starts = offsets.select(key, length, "start").union(offsets.select(key, length, F.lit(0))).distinct()
    by = Window.partitionBy(key).orderBy("start")
    return starts.select(key, (F.row_number().over(by) - 1).alias("page"), "start", F.coalesce(F.lead("start").over(by), F.col(length)).cast("int").alias("end"))


def writer_gate(value: Column, label: Column, formats: dict[str, str], offered: Column, name: str, names_allowed: tuple[str, ...] = (), slur: str = "", slur_label: str = "") -> Column:
    """Why a writer's value is refused, the first reason that holds, or null.

    ``formats`` has a pattern for each known label, ``offered`` is the array of values the writer was given, ``name``
    a person's name as a pattern, which only labels in ``names_allowed`` may hold; ``slur`` is looked for under
    ``slur_label``. A value collides if it is an offered one, or longer than three characters and part of one, in any case.
    """
    v = F.trim(F.coalesce(value, F.lit("")))
    low = F.lower(v)
    collides = F.exists(F.coalesce(offered, F.array().cast("array<string>")), lambda k: (F.lower(k) == low) | ((F.length(v) > 3) & F.contains(F.lower(k), low)))
    wrong_format = reduce(lambda c, f: c.when(label == f[0], ~v.rlike(f[1])), formats.items(), F.when(F.lit(False), F.lit(False))).otherwise(F.lit(False))
    tests = (
        ("unknown label", ~F.coalesce(label.isin(list(formats)), F.lit(False))),
        ("length", ~F.length(v).between(1, 160)),
        ("placeholder", v.rlike(r"\{[^}]*\}|<[^>]*>|\.\.\.")),
        ("digits only", v.rlike(r"\A[0-9]+\z")),
        ("slur", (label == slur_label) & v.rlike(slur) if slur else F.lit(False)),
        ("offered", collides),
        ("person name", ~label.isin(list(names_allowed)) & v.rlike(name)),
        ("format", wrong_format),
    )
    return F.coalesce(*(F.when(holds, why) for why, holds in tests))


def assemble_relations(scores: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """One row for each instance slot of (keys, slot, side, surface, p) whose best head and best tail both pass: confidence is their geometric mean.

    Ties go to the larger surface; a null p never passes; null keys are keys; no score gives no row.
    """
    passed = scores.filter(F.col("p") >= threshold)
    best = passed.groupBy(*keys, "slot", "side").agg(F.max(F.struct("p", "surface")).alias("b"))
    sides = best.groupBy(*keys, "slot").agg(F.max(F.when(F.col("side") == "head", F.col("b"))).alias("h"), F.max(F.when(F.col("side") == "tail", F.col("b"))).alias("t"))
    whole = sides.filter(F.col("h").isNotNull() & F.col("t").isNotNull())
    return whole.select(*keys, "slot", F.col("h.surface").alias("head"), F.col("t.surface").alias("tail"), F.exp((F.log("h.p") + F.log("t.p")) / 2).alias("confidence"))


def best_assignment(utilities: dict[str, Column], allowed) -> tuple[Column, Column]:
    """(labels, score) of the subset of largest summed utility among those that ``allowed`` admits; ties go to the earlier subset.

    ``allowed`` gets a dict of label to bool and says at planning time whether the constraints hold, so only feasible
    subsets become expressions: exact, and meant for the few labels of one task. No feasible subset gives nulls.
    """
    names = list(utilities)
    feasible = [s for n in range(1 << len(names)) if allowed({k: bool(n >> i & 1) for i, k in enumerate(names)}) for s in [[k for i, k in enumerate(names) if n >> i & 1]]]
    if not feasible:
        return F.lit(None).cast("array<string>"), F.lit(None).cast("double")
    option = lambda i, s: F.struct(reduce(lambda a, k: a + utilities[k], s, F.lit(0.0)).alias("score"), F.lit(-i).alias("order"), F.array(*(F.lit(k) for k in s)).cast("array<string>").alias("labels"))
    best = F.array_max(F.array(*(option(i, s) for i, s in enumerate(feasible))))
    return best["labels"], best["score"]
