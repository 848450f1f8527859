"""What reviewers and later steps see of results: rows for review, stripped spans, rules that outlive a smaller schema, sentences from templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a span that are not its own payload.
SPAN_PARTS = ("text", "confidence", "start", "end")


def stripped(spans: DataFrame, column: str, confidence: bool = False, places: bool = False) -> Column:
    """The array of structs ``column`` with only what was asked for: texts alone, or structs with confidence, start and end.

    What a span carries besides SPAN_PARTS stays in any case, and then spans stay structs. A null array stays null.
    """
    parts = [f.name for f in spans.schema[column].dataType.elementType.fields]
    extras = [p for p in parts if p not in SPAN_PARTS]
    wanted = ["text", *(["confidence"] if confidence and "confidence" in parts else []), *([p for p in ("start", "end") if p in parts] if places else []), *extras]
    if wanted == ["text"]:
        return F.transform(column, lambda s: s["text"])
    return F.transform(column, lambda s: F.struct(*(s[p].alias(p) for p in wanted)))


def surviving_rules(rules: DataFrame, active: list[str]) -> DataFrame:
    """``rules`` (rule, tasks) with ``fate`` under the tasks ``active``: "keep" if all of a rule's tasks are there, "drop" if none is, else "mixed".

    A mixed rule must not be half applied: who cuts the schema has to decide. Null and empty tasks are kept.
    """
    own = F.coalesce("tasks", F.array().cast("array<string>"))
    there = F.array_intersect(own, F.array(*(F.lit(a) for a in active)).cast("array<string>"))
    fate = F.when(F.size(there) == F.size(F.array_distinct(own)), "keep").when(F.size(there) == 0, "drop").otherwise("mixed")
    return rules.withColumn("fate", fate)


def review_rows(records: DataFrame, bundles: DataFrame, verdicts: DataFrame, key: str, sensitive: str) -> DataFrame:
    """(key, review): one struct for each of ``records`` (key, text) with its bundle's entities, the judge's verdicts and whether it is sensitive.

    ``bundles`` has (key, label, value, sensitivity), ``verdicts`` (key, claim, verdict). A document is sensitive if one of its entities' sensitivity
    holds the phrase ``sensitive``. Lists are sorted; a document without a bundle or a verdict has empty ones.
    """
    flag = F.coalesce(F.max(F.contains("sensitivity", F.lit(sensitive))), F.lit(False))
    per = bundles.groupBy(F.col(key).alias("_b")).agg(F.sort_array(F.collect_list(F.struct("label", "value"))).alias("entities"), F.count_distinct("label").alias("labels"), flag.alias("sensitive"))
    said = verdicts.groupBy(F.col(key).alias("_v")).agg(F.sort_array(F.collect_list(F.struct("claim", "verdict"))).alias("verdicts"), F.count_if(F.col("verdict") == "no").alias("refused"))
    joined = records.join(per, F.col(key).eqNullSafe(F.col("_b")), "left").join(said, F.col(key).eqNullSafe(F.col("_v")), "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    review = F.struct(
        F.length(F.coalesce("text", F.lit(""))).alias("chars"), none("entities", per.schema["entities"].dataType.simpleString()).alias("entities"), F.coalesce("labels", F.lit(0)).alias("labels"),
        F.coalesce("sensitive", F.lit(False)).alias("sensitive"), none("verdicts", said.schema["verdicts"].dataType.simpleString()).alias("verdicts"), F.coalesce("refused", F.lit(0)).alias("refused"),
    )
    return joined.select(key, review.alias("review"))


def told_by_template(rows: DataFrame, templates: DataFrame, on: list[str], slots: dict[str, str]) -> DataFrame:
    """``rows`` with ``sentence``: the template (on, template) of its values of ``on``, each ``{slot}`` replaced by a column; null without a template.

    Of several templates for the same values the first by text is taken; a null value leaves its slot empty.
    """
    one = templates.groupBy(*(F.col(c).alias(f"_t_{c}") for c in on)).agg(F.min("template").alias("_template"))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    said = F.col("_template")
    for slot, column in slots.items():
        said = F.replace(said, F.lit("{" + slot + "}"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return rows.join(one, same, "left").select(*rows.columns, said.alias("sentence"))
