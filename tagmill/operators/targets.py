"""Surfaces in texts: token runs, boundaries between characters and tokens, occurrence and truncation policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions.text import find_all
from tagmill.operators.spans import longest_first, priority_merge

#: What stands between tokens when a token list is one text; it occurs in no token.
SEP = "\x1f"


def joined(tokens: Column) -> Column:
    """A token list as one text in which every token has the separator on both sides."""
    return F.concat(F.lit(SEP), F.array_join(tokens, SEP * 2), F.lit(SEP))


def run_count(tokens: Column, run: Column) -> Column:
    """How often the token list ``run`` stands in ``tokens`` as a contiguous run, overlapping ones included; an empty run never.

    Whole tokens are compared at each place the run could begin; null lists are empty.
    """
    tokens, run = (F.coalesce(x, F.array().cast("array<string>")) for x in (tokens, run))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens) - F.size(run) + 1, F.lit(1))), lambda i: F.slice(tokens, i, F.size(run)) == run)
    return F.when((F.size(run) > 0) & (F.size(run) <= F.size(tokens)), F.size(at)).otherwise(F.lit(0))


def has_run(tokens: Column, run: Column) -> Column:
    """Whether ``run`` stands in ``tokens``: one search in the joined text, linear in it."""
    return F.coalesce((F.size(run) > 0) & F.contains(joined(tokens), joined(run)), F.lit(False))


def whole_words(text: Column, surface: str) -> Column:
    """array<struct<start,end,text>> of the places where the literal ``surface`` stands with no word character beside it."""
    quoted = r"\Q" + surface.replace(r"\E", r"\E\\E\Q") + r"\E"
    return find_all(text, rf"(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])")


def by_policy(places: Column, policy: str) -> Column:
    """``places`` (an array) under the policy ``all``, ``first`` or ``error_on_ambiguous``; the last fails the job on a second place."""
    if policy == "all":
        return places
    if policy == "first":
        return F.slice(places, 1, 1)
    if policy == "error_on_ambiguous":
        return F.when(F.size(places) > 1, F.raise_error(F.lit("ambiguous surface"))).otherwise(places)
    raise ValueError(f"unknown occurrence policy {policy!r}")


def char_to_token(spans: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``spans`` (keys, start, end in code points) with token_start and token_end, half-open places in ``tokens`` (keys, pos, start, end).

    The first token that ends after the span's start, and the last one that starts before its end. A span that is empty or
    meets no token has null places. Tokens of a document must not overlap: both places are then counts of tokens before
    a point, found by one sort of points and tokens instead of a range join.
    """
    s = spans.withColumn("_id", F.monotonically_increasing_id())
    point = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"))
    # tokens that end at or before start lie wholly before the span; tokens that start before end begin before its end
    points = s.select(*keys, "_id", F.inline(F.array(point(F.col("start"), 1), point(F.col("end"), 2))))
    ends = tokens.select(*keys, F.lit(None).cast("long").alias("_id"), F.inline(F.array(point(F.col("end"), 0), point(F.col("start") + 1, 3))))
    # order at one place: token ends (0) count before starts of spans (1); starts of tokens + 1 (3) count before ends of spans (2) one further
    both = points.unionByName(ends).withColumn("_rank", F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 1).otherwise(2))
    by = Window.partitionBy(*keys).orderBy("at", "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("ended", F.sum((F.col("kind") == 0).cast("int")).over(by)).withColumn("begun", F.sum((F.col("kind") == 3).cast("int")).over(by))
    found = counted.filter("_id is not null").groupBy("_id").agg(F.max(F.when(F.col("kind") == 1, F.col("ended"))).alias("token_start"), F.max(F.when(F.col("kind") == 2, F.col("begun"))).alias("token_end"))
    real = (F.col("start") < F.col("end")) & (F.col("token_start") < F.col("token_end"))
    return s.join(found, "_id").select(*spans.columns, *(F.when(real, F.col(c)).cast("int").alias(c) for c in ("token_start", "token_end")))


def token_to_char(spans: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``spans`` (keys, token_start, token_end) with start and end: those of the first and of the last token; outside the document no row."""
    first = tokens.select(*keys, F.col("pos").alias("token_start"), "start")
    last = tokens.select(*keys, (F.col("pos") + 1).alias("token_end"), "end")
    return spans.filter("token_start < token_end").join(first, [*keys, "token_start"]).join(last, [*keys, "token_end"])


def truncate(mentions: DataFrame, keys: list[str], most: int, policy: str) -> DataFrame:
    """``mentions`` (keys, token_start, token_end) of documents cut after ``most`` tokens.

    ``drop_target`` leaves out the mentions that cross the cut, ``drop_example`` all mentions of a document that has one,
    ``error`` fails the job where there is one.
    """
    crosses = F.col("token_end") > most
    if policy == "drop_target":
        return mentions.filter(~crosses)
    if policy == "drop_example":
        return mentions.join(mentions.filter(crosses).select(*keys).distinct(), keys, "left_anti")
    if policy == "error":
        return mentions.filter(F.when(crosses, F.raise_error(F.lit("a mention crosses the cut"))).otherwise(F.lit(True)))
    raise ValueError(f"unknown truncation policy {policy!r}")


def repair_untagged(docs: DataFrame, spans: DataFrame, values: DataFrame, key: str, most: int = 4, never: tuple[str, ...] = ()) -> DataFrame:
    """(key, start, end, label, surface): where ``values`` (key, label, value) stand untagged in ``docs`` (key, text) beside ``spans`` (key, start, end).

    Values of under four characters, of under six digits, or offered under two labels are left alone, as are places that
    overlap a span; among places that overlap each other the longer value wins, then the earlier. Documents that would get
    more than ``most`` repairs, or one of a label in ``never``, get none: they are for review.
    """
    v = values.filter("value is not null").select(key, "label", "value").distinct()
    sole = v.groupBy(key, F.lower("value").alias("_v")).agg(F.count_distinct("label").alias("_n")).filter("_n = 1").select(key, "_v")
    fit = v.withColumn("_v", F.lower("value")).join(sole, [key, "_v"]).filter((F.length("value") >= 4) & ~(F.col("value").rlike(r"\A[0-9]{1,5}\z")))
    pieces = F.split(F.lower("text"), F.concat(F.lit(r"\Q"), F.replace(F.col("_v"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    by = Window.partitionBy(key, "label", "value").orderBy("n")
    size = F.length("value")
    at = docs.select(key, "text").join(fit, key).filter(F.contains(F.lower("text"), F.col("_v"))).select(key, "text", "label", "value", F.posexplode(F.slice(pieces, 1, F.size(pieces) - 1)).alias("n", "piece"))
    at = at.withColumn("start", (F.sum(F.length("piece") + size).over(by) - size).cast("int")).withColumn("end", (F.col("start") + size).cast("int"))
    word = r"[\p{L}\p{N}_]"
    alone = ~F.coalesce(F.substring("text", F.col("start"), F.lit(1)).rlike(word) & (F.col("start") > 0), F.lit(False)) & ~F.substring("text", F.col("end") + 1, F.lit(1)).rlike(word)
    at = at.filter(alone).select(key, "start", "end", "label", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("surface"))
    taken = spans.select(key, "start", "end", F.lit("").alias("label"), F.lit("").alias("surface"))
    kept = priority_merge(taken, longest_first(at, [key]), [key]).filter("label <> ''")
    busy = kept.groupBy(key).agg(F.count("*").alias("_n"), F.max(F.col("label").isin(list(never))).alias("_never")).filter((F.col("_n") > most) | F.col("_never"))
    return kept.join(busy.select(key), key, "left_anti")
