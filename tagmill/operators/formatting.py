"""Results of an extraction as one row a document: entities, relations and classes apart, and what was asked for and not found filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _filled(found: Column, asked: list[str], kind: str) -> Column:
    """The map ``found`` with an empty array for each name of ``asked`` that it lacks."""
    have = F.coalesce(found, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{kind}>")))
    lacking = F.array_except(F.array(*(F.lit(a) for a in asked)).cast("array<string>"), F.map_keys(have))
    return F.map_concat(have, F.map_from_arrays(lacking, F.transform(lacking, lambda _: F.array().cast(kind))))


def _grouped(rows: DataFrame, key: str, name: str, order: Column, item: Column, as_name: str) -> DataFrame:
    """(key, as_name): a map from ``name`` to its items in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), item.alias("i")))), lambda x: x["i"])
    per = rows.filter(F.col(name).isNotNull()).groupBy(key, name).agg(ordered.alias("_items"))
    return per.groupBy(F.col(key).alias(f"_k_{as_name}")).agg(F.map_from_entries(F.collect_list(F.struct(name, "_items"))).alias(as_name))


def format_results(docs: DataFrame, entities: DataFrame, relations: DataFrame, classes: DataFrame, key: str, asked: dict[str, list[str]], confidence: bool = False) -> DataFrame:
    """(key, entities, relations, classes): one row for each of ``docs`` (key), each column a map from a name to its items.

    ``entities`` has (key, label, text, start, end, confidence): by place; of those of one text, in any case, and place the most confident
    stands; blank texts are left out. ``relations`` has (key, relation, head, tail, confidence) and ``classes`` (key, task,
    label, confidence), the most confident first. ``asked`` names the "entities", "relations" and "classes" that are there in
    any case, with no items if nothing was found; what was found and not asked for stands too. With ``confidence`` items are
    structs with it, else texts, (head, tail) and labels. Rows of other documents and null names are left out.
    """
    with_c = lambda *names: F.struct(*names, *(["confidence"] if confidence else []))
    once = entities.filter(F.trim("text") != "").groupBy(key, "label", F.lower("text").alias("_low"), "start", "end").agg(F.max_by("text", F.struct("confidence", "text")).alias("text"), F.max("confidence").alias("confidence"))
    spans = _grouped(once, key, "label", F.struct("start", "end", "_low"), with_c("text") if confidence else F.col("text"), "entities")
    pairs = _grouped(relations.groupBy(key, "relation", "head", "tail").agg(F.max("confidence").alias("confidence")), key, "relation", F.struct((-F.col("confidence")).alias("c"), "head", "tail"), with_c("head", "tail"), "relations")
    chosen = _grouped(classes.filter("label is not null").groupBy(key, "task", "label").agg(F.max("confidence").alias("confidence")), key, "task", F.struct((-F.col("confidence")).alias("c"), "label"), with_c("label") if confidence else F.col("label"), "classes")
    out = docs.select(key).distinct()
    for part in (spans, pairs, chosen):
        out = out.join(part, F.col(key).eqNullSafe(F.col(part.columns[0])), "left").drop(part.columns[0])
    kind = lambda frame, name: frame.schema[name].dataType.valueType.simpleString()
    return out.select(key, *(_filled(F.col(n), asked.get(n, []), kind(f, n)).alias(n) for f, n in ((spans, "entities"), (pairs, "relations"), (chosen, "classes"))))
