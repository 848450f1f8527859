"""Verdicts joined to claims, tags bound to entities, and what is kept, flagged or dropped for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict_gate(claims: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """``claims`` with ``outcome`` and ``evidence`` by ``verdicts`` (keys, verdict, evidence).

    A claim stays (kept) on a "yes", is dropped on any other verdict and where there is none; a null verdict is a judge
    that failed: flagged. Of several verdicts on a claim the best holds.
    """
    rank = F.when(F.col("verdict") == "yes", 2).when(F.col("verdict").isNull(), 1).otherwise(0)
    best = verdicts.groupBy(*keys).agg(F.max(rank).alias("_v"), F.max_by(F.coalesce("evidence", F.lit("")), rank).alias("evidence"))
    outcome = F.when(F.col("_v") == 2, "kept").when(F.col("_v") == 1, "flagged").otherwise("dropped")
    return claims.join(best, keys, "left").withColumn("outcome", outcome).drop("_v")


def parse_verdict(answer: Column, fields: list[str], low: int = 1, high: int = 5) -> Column:
    """struct of integer ``fields`` from the first JSON object in ``answer``; null if there is none, a field lacks or one is out of range."""
    body = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0)
    said = F.from_json(body, ", ".join(f"{f} int" for f in fields))
    ok = F.lit(True)
    for f in fields:
        ok = ok & F.coalesce(said[f].between(low, high), F.lit(False))
    return F.when(ok, said)


def bind_tags(tags: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """``tags`` (key, value, label) with ``id`` and ``problem`` by ``entities`` (key, id, value, label), values compared in lower case.

    A tag binds to the entity of its value and label. A value of other labels only is a label mismatch; of no entity,
    unknown; several entities of one value and label give the least id. Entities that no tag names come besides, as missing.
    """
    low = F.lower(F.trim("value"))
    e = entities.groupBy(key, low.alias("_v"), "label").agg(F.min("id").alias("id"))
    t = tags.withColumn("_v", low)
    exact = t.join(e, [key, "_v", "label"], "left")
    values = e.select(key, "_v").distinct().withColumn("_known", F.lit(True))
    bound = exact.join(values, [key, "_v"], "left")
    problem = F.when(F.col("id").isNotNull(), None).when(F.col("_known"), "label mismatch").otherwise("unknown value")
    out = bound.select(key, "value", "label", "id", problem.alias("problem"))
    named = out.filter("id is not null").select(key, "id").distinct()
    missing = entities.join(named, [key, "id"], "left_anti").select(key, "value", "label", "id", F.lit("missing").alias("problem"))
    return out.unionByName(missing)


def unfixable_left_out(problems: DataFrame, key: str, unfixable: list[str]) -> DataFrame:
    """(key, problems) of the documents all of whose ``problems`` (key, problem) may be repaired; sorted, flags told apart by their prefix."""
    kind = F.split_part("problem", F.lit(":"), F.lit(1))
    per = problems.groupBy(key).agg(F.sort_array(F.collect_set("problem")).alias("problems"), F.max(kind.isin(unfixable)).alias("_bad"))
    return per.filter("not _bad").drop("_bad")


def outside_entities(findings: DataFrame, docs: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """``findings`` (key, quote) whose quote stands in the text of ``docs`` (key, text), with ``start``, and whose first place no span (key, start, end) holds."""
    at = findings.filter("quote <> ''").join(docs.select(key, "text"), key).withColumn("start", F.expr("locate(quote, text) - 1")).filter("start >= 0")
    held = at.withColumn("_end", F.col("start") + F.length("quote")).join(spans.select(key, F.col("start").alias("_s"), F.col("end").alias("_e")), key).filter("_s <= start and _end <= _e").select(key, "quote").distinct()
    return at.join(held, [key, "quote"], "left_anti").select(*findings.columns, "start")


def copied_hints(docs: DataFrame, hints: DataFrame, values: DataFrame, key: str, n: int = 5) -> DataFrame:
    """(key, hint) of the ``hints`` (key, hint) of which ``n`` words in a row stand in the text of ``docs`` (key, text).

    ``values`` (key, value) are taken out of both sides first, the longer before the shorter, as a long value would count
    as copying. Words are compared in lower case; hints with fewer words are never copies; null texts hold nothing. A text's words
    are made once, whatever its hints are.
    """
    longest = F.transform(F.array_sort(F.collect_set(F.struct((-F.length("value")).alias("n"), "value"))), lambda v: v["value"])
    taken = values.filter("value <> ''").groupBy(key).agg(longest.alias("_v"))
    asked = hints.filter("hint is not null").groupBy(key).agg(F.collect_set("hint").alias("_hints"))
    bare = lambda c: F.aggregate(F.coalesce("_v", F.array().cast("array<string>")), F.coalesce(c, F.lit("")), lambda t, v: F.replace(t, v, F.lit(" ")))
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+", -1), lambda w: w != "")
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: spaced(F.slice(w, i, n)))
    # arrays of one hold what is used more than once: a column named in a lambda would be worked out at each use
    copied = lambda text, hint: F.exists(F.array(words(bare(hint))), lambda w: (F.size(w) >= n) & F.exists(runs(w), lambda r: F.contains(text, r)))
    both = docs.select(key, "text").join(asked, key).join(taken, key, "left")
    found = F.flatten(F.transform(F.array(spaced(words(bare(F.col("text"))))), lambda text: F.filter("_hints", lambda hint: copied(text, hint))))
    return both.select(key, F.explode(found).alias("hint")).distinct()


def lines_missing(part: DataFrame, whole: DataFrame) -> DataFrame:
    """The distinct lines of ``part`` (text) that stand in no text of ``whole`` (text) as a line; none means ``part`` is made of it. Null texts have no lines."""
    lines = lambda f: f.select(F.explode(F.split("text", "\n", -1)).alias("line")).distinct()
    return lines(part).join(lines(whole), "line", "left_anti")
