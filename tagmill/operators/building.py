"""Records for training built from documents, entities and relations, with what could not be used told besides."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_order
from tagmill.functions.text import closed, low_words
from tagmill.operators.corpus import with_row
from tagmill.operators.targets import has_run
from tagmill.written import cut


class Built(NamedTuple):
    """Entities (key, label, surface, nth), relation instances (key, relation, head, tail, negative) and warnings (key, kind, detail)."""

    entities: DataFrame
    relations: DataFrame
    warnings: DataFrame


def with_matches(surfaces: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """``surfaces`` (key, surface) with ``matchable``: whether its tokens stand in the text of ``docs`` (key, text) as a run of whole tokens."""
    tokens = docs.select(key, low_words(F.col("text")).alias("_w"))
    return surfaces.join(tokens, key, "left").withColumn("matchable", F.coalesce(has_run(F.col("_w"), low_words(F.col("surface"))), F.lit(False))).drop("_w")


def build_records(docs: DataFrame, entities: DataFrame, relations: DataFrame, key: str, types: DataFrame, negatives: int = 4, seed: int = 42) -> Built:
    """Training records of ``docs`` (key, text).

    ``entities`` has (key, id, label, start, end, span): the surface is what the text holds there; another span than that is
    warned of, a blank one left out, a repeated one of a label counted once, and one that no run of whole tokens matches is
    dropped with a warning. ``relations`` has (key, i, relation, head, tail) with entity ids: each becomes an instance for
    every pair of matchable surfaces of its ends' mentions, each (relation, head, tail) once in a document; without a pair
    it is warned of. ``negatives`` relation names of ``types`` (relation) that a document lacks are declared besides, with
    empty ends, chosen by hash.
    """
    cut_out = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    sliced = cut(with_matches(entities.join(docs.select(key, "text"), key).withColumn("surface", cut_out).drop("text"), docs, key), "sliced")
    blank = F.trim("surface") == ""
    differs = sliced.filter(F.col("surface") != F.col("span")).select(key, F.lit("span_slice_mismatch").alias("kind"), F.concat_ws("/", "span", "surface").alias("detail"))
    once = sliced.filter(~blank).groupBy(key, "label", "surface", "matchable").agg(F.min("start").alias("_at"))
    lost = once.filter("not matchable").select(key, F.lit("entity_surface_unmatchable").alias("kind"), F.concat_ws("/", "label", "surface").alias("detail"))
    nth = F.row_number().over(Window.partitionBy(key, "label").orderBy("_at", "surface")) - 1
    kept = once.filter("matchable").withColumn("nth", nth).select(key, "label", "surface", "nth")
    clusters = sliced.filter(~blank & F.col("matchable")).select(key, "id", "surface").distinct()
    end = lambda c: clusters.select(key, F.col("id").alias(c), F.col("surface").alias(f"_{c}"))
    paired = relations.join(end("head"), [key, "head"]).join(end("tail"), [key, "tail"])
    instances = paired.select(key, "relation", F.col("_head").alias("head"), F.col("_tail").alias("tail")).distinct().withColumn("negative", F.lit(False))
    unpaired = relations.join(paired.select(key, "i").distinct(), [key, "i"], "left_anti").select(key, F.lit("triple_unmatchable").alias("kind"), F.concat_ws("/", "relation", "head", "tail").alias("detail"))
    return Built(kept, instances.unionByName(absent_types(docs, relations, key, types, negatives, seed)), differs.unionByName(lost).unionByName(unpaired))


def absent_types(docs: DataFrame, relations: DataFrame, key: str, types: DataFrame, most: int, seed: int) -> DataFrame:
    """(key, relation, head, tail, negative): up to ``most`` relation names of ``types`` that a document lacks, by hash, with empty ends.

    The names are one small array, aggregated once, that goes beside each document; no grid of documents and names is joined.
    """
    names = types.agg(F.sort_array(F.collect_set("relation")).alias("_all"))
    have = docs.select(key).distinct().join(relations.groupBy(key).agg(F.collect_set("relation").alias("_have")), key, "left")
    lacking = F.array_except("_all", F.coalesce("_have", F.array().cast("array<string>")))
    ordered = F.array_sort(F.transform(lacking, lambda r: F.struct(hash_order(seed, F.col(key), r).alias("h"), r.alias("r"))))
    chosen = with_row(have, names).select(key, F.explode(F.slice(ordered, 1, most)).alias("s"))
    return chosen.select(key, F.col("s.r").alias("relation"), F.lit("").alias("head"), F.lit("").alias("tail"), F.lit(True).alias("negative"))


def gold_triples(built: Built, key: str) -> DataFrame:
    """(key, relation, head, head_label, tail, tail_label) of the instances that are no negatives; a surface's label is the first it has in any case."""
    low = lambda c: F.lower(F.col(c))
    first = built.entities.groupBy(key, low("surface").alias("_s")).agg(F.min_by("label", F.struct("label", "nth")).alias("_label"))
    out = built.relations.filter("not negative")
    for side in ("head", "tail"):
        out = out.withColumn("_s", low(side)).join(first.withColumnRenamed("_label", f"{side}_label"), [key, "_s"], "left").drop("_s")
    return out.select(key, "relation", "head", "head_label", "tail", "tail_label")


def preflight(docs: DataFrame, surfaces: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(documents all of whose ``surfaces`` (key, surface) match as whole tokens, (key, unmatched) of the others).

    As in training, a text without a closing mark gets a full stop first.
    """
    checked = with_matches(surfaces.select(key, "surface").distinct(), docs.withColumn("text", closed(F.coalesce("text", F.lit("")))), key)
    bad = checked.filter("not matchable").groupBy(key).agg(F.count("*").alias("unmatched"))
    return docs.join(bad, key, "left_anti"), bad


def token_spans(spans: Column, tokens: Column) -> Column:
    """Spans (start, end, label) as [first token, last token, label] over ``tokens`` (start, end): both arrays of one row, for short texts."""
    place = lambda ts, test: F.filter(F.transform(ts, lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull())
    ends = lambda ts, s: F.struct(F.array_min(place(ts, lambda t: t["end"] > s["start"])).alias("first"), F.array_max(place(ts, lambda t: t["start"] < s["end"])).alias("last"), s["label"].alias("label"))
    # the tokens are made once a row and held: an expression inside a lambda is worked out again for each span
    return F.element_at(F.transform(F.array(tokens), lambda ts: F.transform(spans, lambda s: ends(ts, s))), 1)
