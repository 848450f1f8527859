"""Results of chunks put together for the whole document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def remap(items: DataFrame, chunks: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """``items`` (key, chunk, start, end in the chunk) with offsets of the document, and the surface cut anew from its text.

    ``chunks`` has (key, chunk, start_char), ``texts`` (key, text). Offsets outside the text keep the item's own surface.
    """
    moved = items.join(chunks.select(key, "chunk", "start_char"), [key, "chunk"]).join(texts.select(key, "text"), key)
    start, end = (F.col(c) + F.col("start_char") for c in ("start", "end"))
    inside = (start >= 0) & (start <= end) & (end <= F.length("text"))
    surface = F.when(inside, F.substring("text", (start + 1).cast("int"), (end - start).cast("int"))).otherwise(F.col("surface"))
    return moved.withColumns({"surface": surface, "start": start.cast("int"), "end": end.cast("int")}).select(*items.columns)


def merge_choices(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, choice, confidence): the most confident of the chunks' choices (keys, chunk, choice, confidence), ties to the earlier chunk.

    Null choices don't count; null confidences are 0.
    """
    order = F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("chunk")).alias("o"))
    best = F.max_by(F.struct("choice", F.coalesce("confidence", F.lit(0.0)).alias("confidence")), order)
    return values.filter("choice is not null").groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def merge_strings(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, votes): the most frequent of the chunks' strings (keys, chunk, value), ties to the one that came first; null and empty don't count."""
    counted = values.filter("value <> ''").groupBy(*keys, "value").agg(F.count("*").alias("votes"), F.min("chunk").alias("_first"))
    best = counted.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), "_first", "value")))
    return best.filter("_n = 1").select(*keys, "value", "votes")


def merge_graph(entities: DataFrame, relations: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of the chunks as those of the document, renumbered e1, e2, … in text order.

    ``entities`` has (key, chunk, id, type, start, end, confidence) in document offsets, ``relations`` (key, chunk, type, head,
    tail, confidence) with ids of the same chunk: no edge crosses chunks. Entities of one type and place are one, with the
    largest confidence; so are relations of one type between the same two entities.
    """
    place = ["type", "start", "end"]
    one = entities.groupBy(key, *place).agg(F.max("confidence").alias("confidence"))
    one = one.withColumn("id", F.concat(F.lit("e"), F.row_number().over(Window.partitionBy(key).orderBy("start", "end", "type"))))
    old = entities.select(key, "chunk", F.col("id").alias("_old"), *place).join(one.select(key, *place, "id"), [key, *place]).select(key, "chunk", "_old", "id").distinct()
    end = lambda side: old.select(key, "chunk", F.col("_old").alias(side), F.col("id").alias(f"_{side}"))
    edges = relations.join(end("head"), [key, "chunk", "head"]).join(end("tail"), [key, "chunk", "tail"])
    merged = edges.groupBy(key, "type", F.col("_head").alias("head"), F.col("_tail").alias("tail")).agg(F.max("confidence").alias("confidence"))
    return one.select(key, "id", *place, "confidence"), merged
