"""Sparse score tables: what is told of a few labels, with the rest implied and never written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.operators.corpus import beside


def checked_scores(scores: DataFrame, vocabulary: DataFrame, keys: list[str], low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """(good rows of ``scores``, (keys, task, label, problem)): ``scores`` has (keys, task, label, logit), ``vocabulary`` (task, label).

    A label told more than once is a duplicate, whatever its scores; one that the task has not is unknown; a logit that is null, not
    finite or outside ``low`` to ``high`` is out of range. Each problem is told once; a row with one is not good.
    """
    counted = scores.groupBy(*keys, "task", "label").agg(F.count("*").alias("_n"), F.min("logit").alias("logit"), F.max(F.when(F.col("logit").between(low, high) & ~F.isnan("logit"), 0).otherwise(1)).alias("_bad"))
    known = vocabulary.filter("label is not null").select("task", "label").distinct().withColumn("_known", F.lit(True))
    told = counted.join(known, ["task", "label"], "left")
    problem = F.filter(F.array(F.when(F.col("_n") > 1, "duplicate"), F.when(F.col("_known").isNull(), "unknown label"), F.when(F.col("_bad") == 1, "out of range")), lambda p: p.isNotNull())
    marked = told.withColumn("_problems", problem)
    good = marked.filter(F.size("_problems") == 0).select(*keys, "task", "label", "logit")
    return good, marked.select(*keys, "task", "label", F.explode("_problems").alias("problem"))


def implied_softmax(scores: DataFrame, vocabulary: DataFrame, keys: list[str], implied: float) -> DataFrame:
    """``scores`` (keys, task, label, logit) with ``p``, its probability among all labels of the task, and ``implied_p``, that of each label not told.

    Labels that are not told have the logit ``implied``: their number, not their rows, enters the sum, so no grid of keys
    and labels is made. The largest logit is taken off first. Rows must be checked before.
    """
    sizes = vocabulary.filter("label is not null").select("task", "label").distinct().groupBy("task").agg(F.count("*").alias("_all"))
    top = scores.groupBy(*keys, "task").agg(F.greatest(F.max("logit"), F.lit(implied)).alias("_top"), F.count("*").alias("_told"))
    shifted = beside(scores, top, [*keys, "task"]).withColumn("_e", F.exp(F.col("logit") - F.col("_top")))
    sums = shifted.groupBy(*keys, "task").agg(F.sum("_e").alias("_sum"))
    full = beside(shifted, sums, [*keys, "task"]).join(sizes, "task")
    rest = F.exp(F.lit(implied) - F.col("_top"))
    total = F.col("_sum") + (F.col("_all") - F.col("_told")) * rest
    return full.select(*keys, "task", "label", "logit", (F.col("_e") / total).alias("p"), F.when(F.col("_all") > F.col("_told"), rest / total).alias("implied_p"))
