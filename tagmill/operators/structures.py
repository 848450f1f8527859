"""Extraction results put together from scores: spans by label, attributes, structure instances, classification results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.operators.corpus import equal_or_null
from tagmill.operators.spans import allow, best_total, greedy, nested, outermost

#: Names under which a policy may be asked for.
POLICIES = {"allow": allow, "overlap": allow, "nested": nested, "longest": outermost, "outermost": outermost, "flat": best_total, "disallow": best_total, "none": best_total, "greedy": greedy, "confidence": greedy}


def policy(name: str):
    """The overlap policy of a name, in any case, hyphens and spaces aside."""
    found = POLICIES.get(name.strip().lower().replace("-", "_").replace(" ", "_"))
    if found is None:
        raise ValueError(f"unknown overlap policy {name!r}")
    return found


def decode_candidates(scores: DataFrame, keys: list[str], thresholds: dict[str, float], default: float = 0.5, overlap: str = "greedy", scalar: tuple[str, ...] = (), gates: DataFrame | None = None, valid: dict[str, Column] | None = None) -> DataFrame:
    """Spans (keys, label, start, end, confidence, …) of ``scores`` (…, logit) that reach their label's threshold, resolved per label.

    ``gates`` (keys, label, open) shuts labels of some keys: where ``open`` is false there is no span; where it is null or there is
    no gate, there may be. ``valid`` gives labels a condition on the candidate's columns, which holds before overlaps are
    resolved, so an invalid span suppresses nothing. Labels in ``scalar`` give their best span alone. Place in the document's order, by confidence, start, end and label, is ``rank``.
    """
    limit = F.lit(default)
    for name, t in thresholds.items():
        limit = F.when(F.col("label") == name, F.lit(t)).otherwise(limit)
    live = scores
    if gates is not None:
        shut = gates.filter("not open").select(*keys, "label").distinct()
        live = live.join(shut, equal_or_null(live, shut, [*keys, "label"]), "left_anti")
    for name, holds in (valid or {}).items():
        live = live.filter((F.col("label") != name) | F.coalesce(holds, F.lit(False)))
    passed = live.withColumn("confidence", F.round(1 / (1 + F.exp(-F.col("logit"))), 9)).filter(F.col("confidence") >= limit).drop("logit")
    kept = policy(overlap)(passed, [*keys, "label"])
    order = [F.desc("confidence"), "start", "end"]
    first = F.row_number().over(Window.partitionBy(*keys, "label").orderBy(*order))
    kept = kept.withColumn("_n", first).filter(~F.col("label").isin(list(scalar)) | (F.col("_n") == 1)).drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "label")))


def cells_to_spans(cells: DataFrame, tokens: DataFrame, docs: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, label, start, end, surface, p) of score ``cells`` (key, label, first token, width, p) from ``threshold`` inside the text.

    ``tokens`` has (key, pos, start, end). Surfaces are stripped, offsets are not moved; blank ones are left out.
    """
    live = cells.filter((F.col("p") >= threshold) & (F.col("width") > 0)).withColumn("_last", F.col("first") + F.col("width") - 1)
    a = tokens.select(key, F.col("pos").alias("first"), "start")
    b = tokens.select(key, F.col("pos").alias("_last"), "end")
    placed = live.join(a, [key, "first"]).join(b, [key, "_last"]).join(docs.select(key, "text"), key)
    surface = F.trim(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    return placed.withColumn("surface", surface).filter("surface <> ''").select(key, "label", "start", "end", "surface", "p")


def attributes(scores: DataFrame, keys: list[str], single: dict[str, bool], applies_to: dict[str, list[str]], threshold: float = 0.5) -> DataFrame:
    """(keys, attribute, choice, p) of ``scores`` (keys, label, attribute, choice, logit) of spans.

    A single attribute takes the choice of largest softmax, a multiple one every choice whose sigmoid reaches ``threshold``; an
    attribute is asked only of the labels it applies to. Ties go to the choice first by name.
    """
    asked = F.lit(False)
    for name, labels in applies_to.items():
        asked = asked | ((F.col("attribute") == name) & F.col("label").isin(labels))
    one = F.col("attribute").isin([n for n, s in single.items() if s])
    own = Window.partitionBy(*keys, "attribute")
    top = F.max("logit").over(own)
    ranked = scores.filter(asked).withColumn("_top", top)
    share = F.when(one, F.exp(F.col("logit") - F.col("_top")) / F.sum(F.exp(F.col("logit") - F.col("_top"))).over(own)).otherwise(1 / (1 + F.exp(-F.col("logit"))))
    ranked = ranked.withColumn("p", F.round(share, 9)).withColumn("_n", F.row_number().over(own.orderBy(F.desc("logit"), "choice")))
    return ranked.filter((one & (F.col("_n") == 1)) | (~one & (F.col("p") >= threshold))).select(*keys, "attribute", "choice", "p")


def structures(fields: DataFrame, keys: list[str], choices: dict[str, bool], threshold: float = 0.5, told: list[str] | None = None) -> DataFrame:
    """(keys, instance, values: map of field to array) of ``fields`` (keys, instance, field, value, p), given scores of every value.

    A field named in ``choices`` takes its best value from ``threshold`` on, or all of them if its entry is true, none twice;
    others are extractive: all values from the threshold, in order of p. Equal ones go by value; where one is chosen and the
    columns ``told`` say in which order the values were told, the first told is. A null value is chosen where there is no other.
    Instances all of whose fields are empty are dropped.
    """
    one = F.col("field").isin([n for n, many in choices.items() if not many])
    best = F.min(F.when(one, F.struct((-F.col("p")).alias("less"), *(told or []))))
    passed = fields.filter(F.col("p") >= threshold).groupBy(*keys, "instance", "field", "value").agg(F.max("p").alias("p"), best.alias("_best"))
    entry = F.struct("field", F.col("value").isNull().alias("none"), (-F.col("p")).alias("less"), F.col("_best").alias("best"), "value", one.alias("one"))
    rows = passed.groupBy(*keys, "instance").agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    told_of = lambda name: F.filter("_all", lambda x: x["field"] == name)
    values = lambda kept: F.transform(F.when(kept[0]["one"], F.slice(kept, 1, 1)).otherwise(kept), lambda x: x["value"])
    named = F.transform(F.array_distinct(F.transform("_all", lambda x: x["field"])), lambda name: F.struct(name.alias("field"), values(told_of(name)).alias("v")))
    return rows.select(*keys, "instance", F.map_from_entries(named).alias("values"))


def classification(scores: DataFrame, keys: list[str], single: bool, threshold: float = 0.5, violated: Column | None = None) -> DataFrame:
    """(keys, selected, confidence, utility, violations): the labels of ``scores`` (keys, label, logit) that a task selects.

    One of softmax argmax, or all from ``threshold`` and the best if there is none; confidence is the selected labels' least
    probability, utility their summed distance of logits from the threshold's; ``violated`` names a broken rule from ``selected``.
    """
    own = Window.partitionBy(*keys)
    s = scores.withColumn("_top", F.max("logit").over(own)).withColumn("_n", F.row_number().over(own.orderBy(F.desc("logit"), "label")))
    if single:
        s = s.withColumn("p", F.exp(F.col("logit") - F.col("_top")) / F.sum(F.exp(F.col("logit") - F.col("_top"))).over(own)).filter("_n = 1")
    else:
        s = s.withColumn("p", 1 / (1 + F.exp(-F.col("logit")))).withColumn("_best", F.max("p").over(own)).filter((F.col("p") >= threshold) | ((F.col("_best") < threshold) & (F.col("_n") == 1)))
    offset = F.log(F.lit(threshold) / (1 - threshold))
    out = s.groupBy(*keys).agg(F.sort_array(F.collect_list("label")).alias("selected"), F.round(F.min("p"), 9).alias("confidence"), F.round(F.sum(F.col("logit") - offset), 9).alias("utility"))
    return out.withColumn("violations", violated if violated is not None else F.lit(None).cast("string"))
