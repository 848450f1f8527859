"""Statistics and reports over records, reviews and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.operators.matching import ratio


def schema_groups(rows: DataFrame, labels: str, order: str) -> DataFrame:
    """(labels as one text, n, first, nth): rows grouped by their declared label list, numbered as first seen."""
    groups = rows.groupBy(F.array_join(labels, ",").alias("labels")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return groups.withColumn("nth", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first")).cast("bigint"))  # a row for each label list


def review_summary(reviews: DataFrame, item: str) -> DataFrame:
    """One row over ``reviews`` (item, reviewer, score, quote, text): items, reviews, the mean of the items' mean scores, the share of items whose scores lie within one point, quotes, and those that stand in the text.

    Null scores are left out; an item without any doesn't count for the means; empty quotes are none.
    """
    real = F.coalesce(F.col("quote"), F.lit("")) != ""
    per = reviews.groupBy(item).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), (F.max("score") - F.min("score")).alias("spread"), F.count_if(real).alias("q"), F.count_if(real & F.contains("text", F.col("quote"))).alias("f"))
    return per.agg(
        F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("reviews"), F.round(F.avg("mean"), 9).alias("mean_score"), F.round(F.avg((F.col("spread") <= 1).cast("double")), 9).alias("within_one"),
        F.coalesce(F.sum("q"), F.lit(0)).alias("quotes"), F.coalesce(F.sum("f"), F.lit(0)).alias("quotes_found"),
    )


def boundary_recall(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct gold and predicted spans (keys, start, end), those in both, and the shares of gold whose span, start or end is predicted."""
    g, p = (f.select(*keys, "start", "end").distinct() for f in (gold, pred))
    mark = lambda cols, name: p.select(*keys, *cols).distinct().withColumn(name, F.lit(1))
    both = g.join(mark(["start", "end"], "b"), [*keys, "start", "end"], "left").join(mark(["start"], "s"), [*keys, "start"], "left").join(mark(["end"], "e"), [*keys, "end"], "left")
    counts = both.agg(F.count("*").alias("gold"), F.count("b").alias("both"), F.count("s").alias("_s"), F.count("e").alias("_e")).join(p.agg(F.count("*").alias("pred")))
    share = lambda c: ratio(F.col(c), F.col("gold"))
    return counts.select("gold", "pred", "both", share("both").alias("span_recall"), share("_s").alias("start_recall"), share("_e").alias("end_recall"))


def leaderboard(rows: DataFrame, model: str, group: str, groups: list[str], value: str) -> DataFrame:
    """(model, a column for each of ``groups``, overall, place): means of ``value``, 0 where there is none, best overall first."""
    per = rows.groupBy(model).agg(*(F.coalesce(F.round(F.avg(F.when(F.col(group) == g, F.col(value))), 4), F.lit(0.0)).alias(g) for g in groups), F.round(F.avg(value), 4).alias("overall"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("overall"), model)))  # a row for each model


def pick_examples(rows: DataFrame, titles: dict[str, Column], key: str) -> DataFrame:
    """(title, key): for each title the first row by its order that no title before it has taken, ties to the smaller key.

    As many candidates as there are titles are enough for each, so these few are ranked and no loop over the table is needed.
    """
    n = len(titles)
    names = list(titles)
    best = None
    for i, (name, order) in enumerate(titles.items()):
        top = rows.orderBy(order, key).limit(n).select(F.lit(i).alias("t"), F.lit(name).alias("title"), key, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, key)).alias("r"))
        best = top if best is None else best.unionByName(top)
    taken: dict = {}
    for row in sorted(best.collect(), key=lambda x: (x.t, x.r)):  # titles squared rows
        if row.title not in taken and row[key] not in taken.values():
            taken[row.title] = row[key]
    kind = dict(rows.dtypes)[key]
    return rows.sparkSession.createDataFrame([(t, taken[t]) for t in names if t in taken], f"title string, {key} {kind}")
