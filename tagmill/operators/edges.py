"""Constraints on relation edges and rendering of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def constrain_edges(edges: DataFrame, keys: list[str], per_head: int | None = None, per_tail: int | None = None, directed: bool = True) -> DataFrame:
    """Edges (keys, head, tail, relation, p) without self loops, one for each pair and relation, at most so many a head and a tail.

    The most probable stay; undirected pairs count both ways as one; ties by head and tail. Edges with a null end go as
    self loops do; repeated edges are one; a null p comes last; extra columns are kept; no edge gives no edge.
    """
    order = [F.desc("p"), "head", "tail"]
    a, b = ("head", "tail") if directed else (F.least("head", "tail"), F.greatest("head", "tail"))
    kept = edges.filter("head <> tail").withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "relation", a, b).orderBy(*order))).filter("_n = 1")
    for limit, side in ((per_head, "head"), (per_tail, "tail")):
        if limit is not None:
            kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "relation", side).orderBy(*order))).filter(F.col("_n") <= limit)
    return kept.drop("_n")


def cap_mentions(mentions: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """``mentions`` with ``kept``: whether they are among the first ``cap`` of their keys by position; of mentions at one place any may be."""
    return mentions.withColumn("kept", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end")) <= cap)


def fill_template(template: Column, head: Column, tail: Column) -> Column:
    """struct<text,head_start,tail_start> of a template with one ``{head}`` and one ``{tail}``; a null template or value gives nulls."""
    first = F.replace(template, F.lit("{head}"), head)
    text = F.replace(first, F.lit("{tail}"), tail)
    at_head, at_tail = F.instr(template, "{head}") - 1, F.instr(template, "{tail}") - 1
    shift = lambda here, there, word: here + F.when(there < here, F.length(word) - 6).otherwise(0)
    return F.struct(text.alias("text"), shift(at_head, at_tail, tail).alias("head_start"), shift(at_tail, at_head, head).alias("tail_start"))


def render_marks(docs: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """(key, rendered): the text of ``docs`` with every mark (start, end, label) as ``[surface](label)``.

    Marks must not overlap; documents without a mark or with a null text give no row. The text between marks is cut by the end of the mark before, so a document's marks are
    sorted once and its pieces joined once.
    """
    by = Window.partitionBy(key).orderBy("start")
    m = marks.join(docs.select(key, "text"), key).withColumn("_from", F.coalesce(F.lag("end").over(by), F.lit(0))).withColumn("_last", F.lead("start").over(by).isNull())
    cut = lambda a, b: F.substring("text", (a + 1).cast("int"), (b - a).cast("int"))
    tail = F.when(F.col("_last"), F.substring("text", (F.col("end") + 1).cast("int"), F.length("text"))).otherwise(F.lit(""))
    piece = F.concat(cut(F.col("_from"), F.col("start")), F.lit("["), cut(F.col("start"), F.col("end")), F.lit("]("), F.col("label"), F.lit(")"), tail)
    return m.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", piece.alias("piece")))), lambda x: x["piece"]), "").alias("rendered"))
