"""Training records as one nested value, cleaned level by level: what the text does not hold goes, and no more than that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The type of a record. A field with ``choices`` must take its values from these, any other from the text.
RECORD = (
    "struct<entities: array<struct<type: string, mentions: array<string>>>, classes: array<struct<task: string, labels: array<string>, chosen: array<string>>>, "
    "structures: array<struct<name: string, fields: array<struct<name: string, values: array<string>, choices: array<string>>>>>, relations: array<struct<name: string, fields: array<struct<name: string, value: string>>>>>"
)


def _named(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _said(low: Column, value: Column) -> Column:
    """Whether the text, in lower case, holds ``value`` in any case; an empty or null value is no claim."""
    return ~_named(value) | F.contains(low, F.lower(value))


def sanitized(text: Column, record: Column) -> Column:
    """``record`` less its invalid parts, by one expression over all levels.

    An entity type goes with any mention that the text lacks; a class task with a choice outside its labels or without labels;
    a field with a value that the text lacks, or outside its choices; a structure without a valid field; a relation with any
    field that the text lacks. Names must not be empty. Null levels are empty ones; a null or blank text leaves nothing.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    blank = F.trim(low) == ""
    every = lambda values, test: F.coalesce(F.forall(values, lambda v: F.coalesce(test(v), F.lit(True))), F.lit(True))
    within = lambda values, choices: F.size(F.array_except(values, choices)) == 0
    nothing = lambda kind: F.array().cast(kind)
    kinds = dict(zip(("entities", "classes", "structures", "relations"), (p.split(": ", 1)[1] for p in _parts()), strict=True))
    level = lambda name: F.when(blank, nothing(kinds[name])).otherwise(F.coalesce(record[name], nothing(kinds[name])))
    entities = F.filter(level("entities"), lambda e: _named(e["type"]) & every(e["mentions"], lambda m: _said(low, m)))
    classes = F.filter(level("classes"), lambda c: _named(c["task"]) & (F.size(F.coalesce(c["labels"], nothing("array<string>"))) > 0) & F.coalesce(within(c["chosen"], c["labels"]), F.lit(True)))
    field = lambda f: _named(f["name"]) & F.when(f["choices"].isNotNull(), F.coalesce(within(f["values"], f["choices"]), F.lit(True))).otherwise(every(f["values"], lambda v: _said(low, v)))
    trimmed = F.transform(level("structures"), lambda s: F.struct(s["name"].alias("name"), F.filter(s["fields"], field).alias("fields")))
    structures = F.filter(trimmed, lambda s: _named(s["name"]) & (F.size(F.coalesce(s["fields"], nothing("array<struct<name: string, values: array<string>, choices: array<string>>>"))) > 0))
    relations = F.filter(level("relations"), lambda r: _named(r["name"]) & (F.size(F.coalesce(r["fields"], nothing("array<struct<name: string, value: string>>"))) > 0) & every(r["fields"], lambda f: _said(low, f["value"])))
    return F.struct(entities.alias("entities"), classes.alias("classes"), structures.alias("structures"), relations.alias("relations"))


def _parts() -> list[str]:
    """The four levels of RECORD, each as "name: type"."""
    found, depth, start, body = [], 0, 0, RECORD[len("struct<") : -1]
    for i, c in enumerate(body):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            found.append(body[start:i].strip())
            start = i + 1
    return [*found, body[start:].strip()]


def sanitize(rows: DataFrame, text: str, record: str) -> DataFrame:
    """``rows`` with ``record`` sanitized and ``valid``: whether anything is left in it."""
    clean = rows.withColumn(record, sanitized(F.col(text), F.col(record)))
    left = F.size(f"{record}.entities") + F.size(f"{record}.classes") + F.size(f"{record}.structures") + F.size(f"{record}.relations")
    return clean.withColumn("valid", left > 0)
