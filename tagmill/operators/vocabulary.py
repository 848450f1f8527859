"""Names of labels and relations: renaming, checks, unique and canonical names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.operators.ranking import ranked


def bridge(rows: DataFrame, names: DataFrame, column: str, strict: bool = True) -> DataFrame:
    """``rows`` with ``column`` renamed by ``names`` (old, new); a name that is not there fails the job, or leaves the row out if not ``strict``.

    Null stays null. ``names`` must have one row for each old name.
    """
    joined = rows.join(names.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left")
    known = F.col("_new").isNotNull() | F.col(column).isNull()
    if strict:
        new = F.when(known, F.col("_new")).otherwise(F.raise_error(F.concat(F.lit("unknown name "), F.col(column))))
        return joined.withColumn(column, new).select(*rows.columns)
    return joined.filter(known).withColumn(column, F.col("_new")).select(*rows.columns)


def merge_vocabularies(first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, name_a, name_b) of two vocabularies (id, name), and the collisions (name, ids): one name, in any case, under several ids of either."""
    both = first.select("id", F.col("name").alias("name_a")).join(second.select("id", F.col("name").alias("name_b")), "id", "full_outer")
    every = first.select("id", "name").unionByName(second.select("id", "name")).filter("name is not null")
    clash = every.groupBy(F.lower("name").alias("name")).agg(F.sort_array(F.collect_set("id")).alias("ids")).filter(F.size("ids") > 1)
    return both, clash


def unique_names(nodes: DataFrame, id_col: str, name: str) -> DataFrame:
    """``nodes`` with ``unique_name``: the name, and after a name that came before, in any case, a number from 2; ids say what comes first.

    A name's nodes are counted over range partitions, so that one name may have any number of them.
    """
    placed = ranked(nodes.withColumn("_low", F.lower(name)), ["_low"], [id_col], "_n")
    return placed.withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat_ws(" ", F.col(name), F.col("_n").cast("string")))).drop("_n", "_low")


def canonical_relations(offers: DataFrame) -> DataFrame:
    """(label, relation) of ``offers`` (label, relation, priority, n): of each label the relation of least priority, then most uses, then first by name."""
    order = F.struct(F.col("priority"), (-F.col("n")).alias("n"), F.col("relation"))
    return offers.groupBy("label").agg(F.min_by("relation", order).alias("relation"))


def taxonomy_problems(labels: DataFrame, aliases: DataFrame, relations: DataFrame) -> DataFrame:
    """(problem, name) of a taxonomy: ``labels`` (label), ``aliases`` (alias, label), ``relations`` (relation, head, tail, template).

    Told are labels that are no lower-case names, aliases of several labels or of a label's name, relations and aliases that
    name no label, relations without a template, and labels in no relation.
    """
    label = labels.select("label").distinct()
    bad = label.filter(~F.col("label").rlike(r"\A[a-z][a-z0-9_]*\z")).select(F.lit("label format").alias("problem"), F.col("label").alias("name"))
    many = aliases.groupBy(F.lower("alias").alias("name")).agg(F.count_distinct("label").alias("n")).filter("n > 1").select(F.lit("alias of several").alias("problem"), "name")
    taken = aliases.join(label.select(F.col("label").alias("alias")), "alias", "left_semi").filter("alias <> label").select(F.lit("alias is a label").alias("problem"), F.col("alias").alias("name"))
    ends = relations.select("relation", F.explode(F.array("head", "tail")).alias("label"))
    broken = ends.join(label, "label", "left_anti").select(F.lit("broken reference").alias("problem"), F.concat_ws(":", "relation", "label").alias("name"))
    stray = aliases.join(label, "label", "left_anti").select(F.lit("broken reference").alias("problem"), F.concat_ws(":", "alias", "label").alias("name"))
    silent = relations.filter(F.trim(F.coalesce("template", F.lit(""))) == "").select(F.lit("no template").alias("problem"), F.col("relation").alias("name"))
    alone = label.join(ends.select("label").distinct(), "label", "left_anti").select(F.lit("uncovered").alias("problem"), F.col("label").alias("name"))
    out = bad
    for part in (many, taken, broken, stray, silent, alone):
        out = out.unionByName(part)
    return out.distinct()
