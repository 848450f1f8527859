"""Gold against predictions: surface sets, offsets with statuses, relations, calibration."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.operators.spans import SMALL, clustered
from tagmill.written import cut


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def prf(frame: DataFrame) -> DataFrame:
    """``frame`` (tp, fp, fn) with precision, recall and f1."""
    with_pr = frame.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return with_pr.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def surface_counts(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """label, tp, fp, fn, support of distinct (document, label, surface) sets."""
    g = gold.select(*keys, "label", "surface").distinct().withColumn("g", F.lit(1))
    p = pred.select(*keys, "label", "surface").distinct().withColumn("p", F.lit(1))
    both = g.join(p, [*keys, "label", "surface"], "full_outer")
    one = lambda c: F.count(F.when(c, 1))
    g1, p1 = F.col("g").isNotNull(), F.col("p").isNotNull()
    return both.groupBy("label").agg(one(g1 & p1).alias("tp"), one(p1 & ~g1).alias("fp"), one(g1 & ~p1).alias("fn"), one(g1).alias("support"))


def micro_macro(counts: DataFrame) -> DataFrame:
    """One row: pooled precision, recall, f1; and their means over the labels with support, with the number of these."""
    per_label = prf(counts)
    supported = lambda c: F.coalesce(F.avg(F.when(F.col("support") > 0, F.col(c))), F.lit(0.0))
    pooled = per_label.agg(
        F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"), F.coalesce(F.sum("fn"), F.lit(0)).alias("fn"),
        supported("precision").alias("macro_precision"), supported("recall").alias("macro_recall"), supported("f1").alias("macro_f1"),
        F.count(F.when(F.col("support") > 0, 1)).alias("n_labels"),
    )
    return prf(pooled).withColumnsRenamed({"precision": "micro_precision", "recall": "micro_recall", "f1": "micro_f1"})


def _pair_up(gold: DataFrame, pred: DataFrame, on: list[str]) -> DataFrame:
    """One-to-one pairs of equal rows: the n-th of the gold with the n-th of the predictions; equal keys are interchangeable."""
    nth = lambda i: F.row_number().over(Window.partitionBy(*on).orderBy(i))
    g = gold.select(*on, "g").withColumn("_n", nth("g"))
    p = pred.select(*on, "p").withColumn("_n", nth("p"))
    return g.join(p, [*on, "_n"]).select("g", "p")


def _taken_in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row's pairs (o, gi, pi), in order, those neither of whose sides is taken."""
    for batch in batches:
        for n in range(len(batch)):
            key, pairs = batch.column(0).slice(n, 1), batch.column(1).slice(n, 1).flatten().to_pylist()
            golds, preds, found = set(), set(), []
            for pair in pairs:
                if pair["gi"] not in golds and pair["pi"] not in preds:
                    golds.add(pair["gi"])
                    preds.add(pair["pi"])
                    found.append(pair)
            own = key.take(pa.array([0] * len(found), pa.int64()))
            yield pa.RecordBatch.from_arrays([own, pa.array([f["gi"] for f in found], pa.int32()), pa.array([f["pi"] for f in found], pa.int32())], [batch.schema.names[0], "gi", "pi"])


def offset_statuses(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """(key, status, gold_label, pred_label, same_label) of spans (key, start, end, label).

    First equal spans of equal label match, then equal spans of other labels mismatch, then of what is left the pairs of
    largest overlap, one to one, ties to the later spans; the rest are misses. Overlaps are found inside clusters of touching
    spans, by neighbouring buckets of positions; only overlapping pairs are ranked, a cluster's at a time.
    """
    numbered = lambda f, name: f.select(key, "start", "end", "label", F.struct(F.col(key), F.row_number().over(Window.partitionBy(key).orderBy("start", "end", "label")).alias("i")).alias(name))
    g, p = cut(numbered(gold, "g"), "gold"), cut(numbered(pred, "p"), "pred")  # each step below reads them again
    match = _pair_up(g, p, [key, "start", "end", "label"]).withColumn("status", F.lit("match"))
    g1, p1 = g.join(match, "g", "left_anti"), p.join(match, "p", "left_anti")
    label = _pair_up(g1, p1, [key, "start", "end"]).withColumn("status", F.lit("label_mismatch"))
    g2, p2 = g1.join(label, "g", "left_anti"), p1.join(label, "p", "left_anti")
    # overlaps lie inside clusters of what is left on both sides; in a long cluster, in neighbouring buckets of positions
    left = clustered(g2.select(key, "start", "end", F.lit(0).alias("side"), F.col("g.i").alias("i")).unionByName(p2.select(key, "start", "end", F.lit(1).alias("side"), F.col("p.i").alias("i"))), [key])
    width = 64
    bucket = F.explode(F.sequence((F.col("start") / width).cast("int"), (F.greatest(F.col("end") - 1, F.col("start")) / width).cast("int")))
    placed = left.withColumn("b", bucket)
    a = placed.filter("side = 0").select(key, "_cluster", "b", F.col("i").alias("gi"), F.col("start").alias("gs"), F.col("end").alias("ge"))
    c = placed.filter("side = 1").select(key, "_cluster", "b", F.col("i").alias("pi"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    size = F.least("ge", "pe") - F.greatest("gs", "ps")
    pairs = a.join(c, [key, "_cluster", "b"]).withColumn("o", size).filter("o > 0").select(key, "_cluster", F.struct("o", "gi", "pi").alias("pair")).distinct()
    ranked = pairs.groupBy(key, "_cluster").agg(F.sort_array(F.collect_list("pair"), asc=False).alias("all"))
    clash = lambda x, y: (x["gi"] == y["gi"]) | (x["pi"] == y["pi"])
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: clash(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    few = ranked.filter(F.size("all") <= SMALL).select(key, F.explode(kept).alias("m")).select(key, "m.gi", "m.pi")
    kind = gold.schema[key].dataType.simpleString()
    many = ranked.filter(F.size("all") > SMALL).select(key, "all").mapInArrow(_taken_in_turn, f"`{key}` {kind}, gi int, pi int")
    both = few.unionByName(many)
    boundary = both.select(F.struct(F.col(key), F.col("gi").alias("i")).alias("g"), F.struct(F.col(key), F.col("pi").alias("i")).alias("p"), F.lit("boundary_mismatch").alias("status"))
    paired = cut(match.unionByName(label).unionByName(boundary), "paired")
    gl, pl = g.select("g", F.col("label").alias("gold_label")), p.select("p", F.col("label").alias("pred_label"))
    found = paired.join(gl, "g").join(pl, "p").select(F.col(f"g.{key}").alias(key), "status", "gold_label", "pred_label")
    fn = g.join(paired, "g", "left_anti").select(key, F.lit("fn").alias("status"), F.col("label").alias("gold_label"), F.lit(None).cast("string").alias("pred_label"))
    fp = p.join(paired, "p", "left_anti").select(key, F.lit("fp").alias("status"), F.lit(None).cast("string").alias("gold_label"), F.col("label").alias("pred_label"))
    return found.unionByName(fn).unionByName(fp).withColumn("same_label", F.coalesce(F.col("gold_label") == F.col("pred_label"), F.lit(False)))


def offset_scores(statuses: DataFrame) -> DataFrame:
    """label, n_gold, n_pred, strict_tp, lenient_tp: a mismatch is charged to both its labels."""
    strict = F.col("status") == "match"
    lenient = strict | ((F.col("status") == "boundary_mismatch") & F.col("same_label"))
    side = F.explode(F.array(F.struct(F.col("gold_label").alias("label"), F.lit(1).alias("gold")), F.struct(F.col("pred_label").alias("label"), F.lit(0).alias("gold"))))
    sides = statuses.select(side.alias("s"), strict.alias("strict"), lenient.alias("lenient")).select("s.*", "strict", "lenient").filter("label is not null")
    of_gold = F.col("gold") == 1
    return sides.groupBy("label").agg(
        F.count(F.when(of_gold, 1)).alias("n_gold"), F.count(F.when(~of_gold, 1)).alias("n_pred"),
        F.count(F.when(of_gold & F.col("strict"), 1)).alias("strict_tp"), F.count(F.when(of_gold & F.col("lenient"), 1)).alias("lenient_tp"),
    )


def calibration_error(scored: DataFrame, bins: int = 15) -> DataFrame:
    """One row with ece of (p, y): the weighted mean over equal bins of |mean p - mean y|; the last bin is closed."""
    binned = scored.withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))
    per = binned.groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    return per.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))
