"""Checks of entity graphs and records before they are used, and work that is done once or in blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_uniform
from tagmill.operators.graph import reached_within
from tagmill.operators.ranking import running_total
from tagmill.written import complete, cut


def bundle_problems(entities: DataFrame, relations: DataFrame, kinds: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """(key, problem, detail) of graphs of ``entities`` (key, id, label) and ``relations`` (key, relation, head, tail).

    ``kinds`` (relation, side, label) says which labels an end may have, ``subjects`` (key, id) where each graph starts.
    Told are ids that stand twice, relations with a missing end, to themselves, or with an end of another label, and
    entities that no path of relations, in either direction, leads to from the subject.
    """
    said = lambda f, p, d: f.select(key, F.lit(p).alias("problem"), d.cast("string").alias("detail"))
    twice = said(entities.groupBy(key, "id").agg(F.count("*").alias("n")).filter("n > 1"), "duplicate id", F.col("id"))
    label = cut(entities.groupBy(key, "id").agg(F.min("label").alias("label")), "labels")
    end = lambda s: label.select(key, F.col("id").alias(s), F.col("label").alias(f"{s}_label"))
    relations = cut(relations.select(key, "relation", "head", "tail"), "relations")
    r = relations.join(end("head"), [key, "head"], "left").join(end("tail"), [key, "tail"], "left")
    tests = {"missing end": (F.col("head_label").isNull() | F.col("tail_label").isNull(), F.col("relation")), "self-relation": (F.col("head") == F.col("tail"), F.col("relation"))}
    for side in ("head", "tail"):
        may = kinds.filter(F.col("side") == side).select("relation", F.col("label").alias(f"{side}_label"), F.lit(True).alias(f"{side}_may")).distinct()
        r = r.join(may, ["relation", f"{side}_label"], "left")
        tests[f"{side} label"] = (F.col(f"{side}_label").isNotNull() & F.col(f"{side}_may").isNull(), F.concat_ws("/", "relation", f"{side}_label"))
    problems = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(p).alias("problem"), d.cast("string").alias("detail"))) for p, (c, d) in tests.items())))
    broken = r.select(key, F.inline(problems)).distinct()
    met = reached_within(relations.select(key, F.col("head").alias("a"), F.col("tail").alias("b")), subjects, key)
    lost = said(label.join(met, [key, "id"], "left_anti"), "not connected", F.col("id"))
    return twice.unionByName(broken).unionByName(lost)


def field_inconsistencies(relations: DataFrame, order: str) -> DataFrame:
    """(relation, first, fields, other, other_fields): relation names whose records (relation, fields, order) don't all have the fields of the first."""
    said = relations.select("relation", order, F.array_join(F.array_sort("fields"), ",").alias("f"))
    first = said.groupBy("relation").agg(F.min(F.struct(order, "f")).alias("a"))
    other = said.join(first, "relation").filter(F.col("f") != F.col("a.f")).groupBy("relation", "a").agg(F.min(F.struct(order, "f")).alias("b"))
    return other.select("relation", F.col(f"a.{order}").alias("first"), F.col("a.f").alias("fields"), F.col(f"b.{order}").alias("other"), F.col("b.f").alias("other_fields"))


def late_flags(records: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """``records`` (with an array ``flags`` and a ``bucket``) with the names of the ``tests`` that hold added to flags; accepted ones with any become flagged."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in tests.items())))
    flags = F.array_distinct(F.concat(F.coalesce("flags", F.array().cast("array<string>")), found))
    return records.withColumn("flags", flags).withColumn("bucket", F.when((F.col("bucket") == "accepted") & (F.size("flags") > 0), "flagged").otherwise(F.col("bucket")))


def once_each(rows: DataFrame, column: str, compute: Callable[[Column], Column], name: str) -> DataFrame:
    """``rows`` with ``name``: ``compute`` of ``column``, done once for each distinct value; null values stay null."""
    known = rows.select(column).filter(F.col(column).isNotNull()).distinct().withColumn(name, compute(F.col(column)))
    return rows.join(known, column, "left").select(*rows.columns, name)


def cached_each(rows: DataFrame, column: str, compute: Callable[[Column], Column], name: str, path: str) -> tuple[DataFrame, int]:
    """(``rows`` with ``name``, how many values were computed): as ``once_each``, with what was computed before kept at ``path``.

    The table there has (key, value, result), the key being the SHA-256 of the value. Values whose key is not in it are computed and
    appended as one more run of files, once; a second run over the same rows computes none. Null values stay null. New values meet
    the known keys in one shuffle, in which equal values are one before it; keys are moved as bytes.
    """
    spark = rows.sparkSession
    keyed = lambda f: f.withColumn("_key", F.unhex(F.sha2(F.col(column).cast("string"), 256)))
    stored = lambda: spark.read.parquet(path)
    asked = keyed(rows.select(column).filter(F.col(column).isNotNull())).withColumn("_known", F.lit(False))
    before = 0
    if complete(spark, path):
        before = stored().count()
        asked = asked.unionByName(stored().select(F.unhex("key").alias("_key"), F.lit(True).alias("_known")), allowMissingColumns=True)
    fresh = asked.groupBy("_key").agg(F.first(column, ignorenulls=True).alias(column), F.max("_known").alias("_known")).filter("not _known")
    fresh.select(F.lower(F.hex("_key")).alias("key"), F.col(column).alias("value"), compute(F.col(column)).alias("result")).write.mode("append").option("compression", "zstd").parquet(path)
    there = stored()
    found = keyed(rows).join(there.select(F.unhex("key").alias("_key"), F.col("result").alias(name)), "_key", "left")
    return found.select(*rows.columns, name), there.count() - before


def staged(spark, path: str, stages: list[tuple[str, Callable[[DataFrame | None], DataFrame]]], start: str | None = None) -> tuple[DataFrame, list[str]]:
    """(the last stage's table, the names of the stages that ran): each stage's result is written under ``path`` and read as the next one's input.

    A stage whose table is complete is not run again, unless ``start`` names it or one before it; a stage after one that ran
    runs too. A table without its success mark, left by a run that failed, counts as not there.
    """
    if start is not None and start not in dict(stages):
        raise ValueError(f"no stage is called {start}")
    ran: list[str] = []
    table: DataFrame | None = None
    for name, run in stages:
        folder = f"{path}/{name}"
        if ran or name == start or not complete(spark, folder):
            run(table).write.mode("overwrite").parquet(folder)
            ran.append(name)
        table = spark.read.parquet(folder)
    return table, ran


def gated(rows: DataFrame, order: list, size: int, passes: Callable[[DataFrame], bool]) -> tuple[DataFrame, DataFrame | None]:
    """(first ``size`` rows by ``order``, the rest): the rest is given only if the first block ``passes``; else there is none."""
    first = rows.orderBy(*order).limit(size)
    if not passes(first):
        return first, None
    edge = first.select(*order).orderBy(*(F.desc(c) for c in order)).limit(1)
    bound = edge.select(F.struct(*order).alias("_edge"))
    return first, rows.join(F.broadcast(bound)).filter(F.struct(*order) > F.col("_edge")).drop("_edge")


def star_pick(levels: list[tuple[DataFrame, str, str]], start: DataFrame, seed_columns: list[str], seed: int = 42) -> DataFrame:
    """``start`` with a place of each level, drawn by weight among those of the place above: ``levels`` are (table, its key, the column of the place above), each with ``weight``.

    One random number a row and level, hashed from its ``seed_columns`` and the level's key, times the weights' sum is looked
    up in the running sums of the place above. These are cut into as many buckets as it has places, and a row meets
    the places of its bucket only: two on average, however many the place above has. Places above without any below leave the row
    out; places without a positive weight are never drawn.
    """
    out = start
    for table, own, above in levels:
        there = table.filter("weight > 0").select(F.col(above).alias("_above"), F.col(own).alias(own), F.col("weight").cast("double").alias("_weight"))
        summed = running_total(there, ["_above"], [own], "_weight", "_upto")
        counts = summed.groupBy("_above").agg(F.count("*").alias("_n"), F.max("_upto_all").alias("_all"))
        low = F.col("_upto") - F.col("_weight")
        at = lambda c: F.least(F.floor(c / F.col("_all") * F.col("_n")), F.col("_n") - 1)
        sized = cut(counts, "counts")
        bucketed = summed.join(sized, "_above").select("_above", own, low.alias("_low"), F.col("_upto").alias("_high"), F.explode(F.sequence(at(low), at(F.col("_upto")))).alias("_bucket"))
        asked = out.join(sized, F.col(above) == F.col("_above")).withColumn("_t", hash_uniform(seed, *(F.col(c) for c in seed_columns), F.lit(own)) * F.col("_all"))
        asked = asked.withColumn("_bucket", at(F.col("_t"))).drop("_n", "_all")
        out = asked.join(bucketed, ["_above", "_bucket"]).filter("_low <= _t and _t < _high").select(*out.columns, own)
    return out
