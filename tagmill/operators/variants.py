"""Evaluation variants of records: label names from pools that training knows, or never saw, and the proof that these are apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_uniform


def name_problems(names: DataFrame) -> DataFrame:
    """(problem, name) of the name pools ``names`` (pool, label, name): pool "training" has the labels' own names and aliases, any other held-out ones.

    A held-out name must not be a training name or stand in another held-out pool, or twice in its own; each held-out pool must
    name every label that training has. Names are compared in lower case; null names are no names.
    """
    low = names.filter("name is not null").select("pool", "label", F.lower("name").alias("name"))
    per = low.groupBy("name").agg(F.max((F.col("pool") == "training").cast("int")).alias("seen"), F.count_distinct(F.when(F.col("pool") != "training", F.col("pool"))).alias("pools"), F.count_if(F.col("pool") != "training").alias("times"))
    clash = F.filter(F.array(F.when((F.col("seen") == 1) & (F.col("pools") > 0), "in training"), F.when(F.col("pools") > 1, "in two pools"), F.when(F.col("times") > F.col("pools"), "twice in a pool")), lambda p: p.isNotNull())
    labels = low.filter("pool = 'training'").select("label").distinct()
    pools = low.filter("pool <> 'training'").groupBy("label").agg(F.collect_set("pool").alias("have"))
    every = low.filter("pool <> 'training'").select("pool").distinct()
    counted = every.groupBy().agg(F.count("*").alias("pools"))
    missing = labels.join(pools, "label", "left").withColumn("n", F.coalesce(F.size("have"), F.lit(0)))
    short = missing.join(counted, F.col("n") < F.col("pools")).select(F.lit("label without a held-out name").alias("problem"), F.col("label").alias("name"))
    return per.select(F.explode(clash).alias("problem"), "name").unionByName(short)


def variants(records: DataFrame, names: DataFrame, key: str, seed: int = 7, canonical: float = 0.0) -> DataFrame:
    """(key, variant, label, name): each record label of ``records`` (key, label) under each variant of ``names`` (pool, label, name).

    A held-out pool gives its one name for the label (the first by order, if there are several). The variant "training" keeps the label with the
    probability ``canonical`` and else draws one of its training names but the label itself, by a hash of record and label; a label
    without others keeps its name. Each (record, label) counts once; null labels are left out.
    """
    each = records.select(key, "label").filter("label is not null").distinct()
    fixed = names.filter("pool <> 'training' and name is not null").groupBy("label", "pool").agg(F.min("name").alias("name"))
    held = each.join(fixed, "label").select(key, F.col("pool").alias("variant"), "label", "name")
    pool = names.filter("pool = 'training' and name is not null and name <> label").groupBy("label").agg(F.sort_array(F.collect_set("name")).alias("_names"))
    drawn = each.join(pool, "label", "left")
    u, at = hash_uniform(seed, F.col(key), F.col("label")), hash_uniform(seed + 1, F.col(key), F.col("label"))
    keep = (u < canonical) | F.col("_names").isNull()
    name = F.when(keep, F.col("label")).otherwise(F.element_at("_names", (F.floor(at * F.size("_names")) + 1).cast("int")))
    return held.unionByName(drawn.select(key, F.lit("training").alias("variant"), "label", name.alias("name")))
