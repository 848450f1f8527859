"""Token sequences back to text, and tagged rows cut into pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a token can be, as patterns a whole token must match.
TRAITS = {
    "closer": r"[.,;:!?)\]}”»’']",
    "opener": r"[(\[{“«‘]",
    "apostrophe": r"['’]",
    "quote": '"',
    "dot": r"\.",
    "colon": ":",
    "slash": "/",
    "percent": "%",
    "word": r"[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*",
    "low word": r"\p{Ll}[\p{L}\p{N}_]*(?:[-_][\p{L}\p{N}_]+)*",
    "number": "[0-9]+",
    "clock": "[0-9]{1,2}",
    "capital": r"\p{Lu}",
    "digits first": "[0-9].*",
}
#: Which neighbours leave no space before a token: traits of the second and first token before, the token, the next.
GLUED = (
    (None, None, "closer", None),
    (None, "opener", None, None),
    (None, "apostrophe", "low word", None),
    (None, "percent", "digits first", None),
    ("number", "dot", "number", None),
    ("clock", "colon", "clock", None),
    ("capital", "dot", "capital", "dot"),
    (None, "word", "slash", "word"),
    ("word", "slash", "word", None),
)

#: Lists of tokens that are joined at a time.
LISTS = 1_000


def collapse_dots(tokens: DataFrame, key: str, member: str | None = None) -> DataFrame:
    """``tokens`` (key, pos, token) with runs of three dots or more as one token ``...`` at the first dot's pos.

    With ``member``, a column that says which span a token is in, a run ends where that changes. Windows are over one document.
    """
    of = [key, "_dot", *([member] if member else [])]
    t = tokens.withColumn("_dot", F.col("token") == ".")
    island = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - F.row_number().over(Window.partitionBy(*of).orderBy("pos"))
    run = Window.partitionBy(*of, "_run")
    t = t.withColumn("_run", island)
    t = t.withColumn("_long", F.col("_dot") & (F.count("*").over(run) >= 3)).withColumn("_first", F.min("pos").over(run) == F.col("pos"))
    return t.filter("_first or not _long").withColumn("token", F.when(F.col("_long"), "...").otherwise(F.col("token"))).drop("_dot", "_run", "_long", "_first")


def _joined(batches: Iterator[pa.RecordBatch], dots: bool, rows: int) -> Iterator[pa.RecordBatch]:
    """The tokens of each row's list with sep, start and end, ``rows`` lists at a time; different tokens are classified once."""
    for batch in (b.slice(i, rows) for b in batches for i in range(0, len(b), rows)):
        lists = batch.column(1)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        items, row = lists.flatten(), np.repeat(np.arange(len(batch)), sizes)
        coded = items.field("token").dictionary_encode()
        code, known = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        went = lambda by: np.concatenate([[False], (row[1:] == row[:-1]) & (by[1:] == by[:-1])])[: len(row)]
        at = np.arange(len(row))
        if dots:
            place = known.index(".").as_py()
            dot = (code == place) & (place >= 0)
            begins = ~went(dot)
            run = np.cumsum(begins) - 1
            long = dot & (np.bincount(run, minlength=1)[run] >= 3)
            known = pa.concat_arrays([known, pa.array(["..."], known.type)])
            code = np.where(long, len(known) - 1, code)
            at = at[begins | ~long]
            row, code = row[at], code[at]
        # the last place stands for null, whose code is -1
        has = {n: np.append(pc.match_substring_regex(known, rf"\A(?:{p})\z").to_numpy(zero_copy_only=False).astype(bool), False)[code] for n, p in TRAITS.items()}
        length = np.append(pc.utf8_length(known).to_numpy(zero_copy_only=False).astype(np.int64), 0)[code]

        def beside(of: np.ndarray, step: int) -> np.ndarray:
            """``of`` the token ``step`` places on in the same row; false where there is none."""
            out = np.zeros(len(of), bool)
            n = abs(step)
            here, there = (slice(n, None), slice(None, -n)) if step < 0 else (slice(None, -n), slice(n, None))
            out[here] = of[there] & (row[here] == row[there])
            return out

        first = ~went(np.zeros(len(row), bool))
        before = lambda of: np.cumsum(of) - of
        since = lambda sums: sums - np.maximum.accumulate(np.where(first, sums, 0))
        opened = since(before(has["quote"].astype(np.int64))) % 2 == 1
        glued = first | (opened & (has["quote"] | beside(has["quote"], -1)))
        for rule in GLUED:
            fits = np.ones(len(row), bool)
            for step, trait in zip((-2, -1, 0, 1), rule, strict=True):
                if trait:
                    fits &= beside(has[trait], step) if step else has[trait]
            glued |= fits
        null = code == -1
        taken = np.where(null, 0, length + ~glued)
        end = since(before(taken)) + taken
        places = pa.array(at)
        own = [pa.DictionaryArray.from_arrays(pa.array(code, mask=null), known).cast(known.type) if f.name == "token" else items.field(f.name).take(places) for f in items.type]
        more = [pa.array(end), pa.array(end - length, mask=null), pa.array(np.where(glued, "", " "), pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *own, *more], [batch.schema.names[0], *(f.name for f in items.type), "end", "start", "sep"])


def detokenise_rows(rows: DataFrame, key: str, dots: bool = False) -> DataFrame:
    """As ``detokenise``, for ``rows`` (key, tokens), one a document: its tokens in order as structs with pos and token; nothing is shuffled.

    With ``dots`` runs of three dots or more become one token first, as by ``collapse_dots``.
    """
    item = rows.schema["tokens"].dataType.elementType
    schema = ", ".join(f"`{n}` {t}" for n, t in [(key, rows.schema[key].dataType.simpleString()), *((f.name, f.dataType.simpleString()) for f in item), ("end", "bigint"), ("start", "bigint"), ("sep", "string")])
    return rows.select(key, "tokens").mapInArrow(lambda batches: _joined(batches, dots, LISTS), schema)


def detokenise(tokens: DataFrame, key: str) -> DataFrame:
    """``tokens`` (key, pos, token) with start, end and sep: offsets of every token in the joined text, by a running sum, and what stands before it.

    A document's tokens meet in one row. Each different token is classified once; GLUED says which classes side by side leave no
    space. Straight quotes open and close in turn: no space stands inside. A null token is none of the classes and takes no place.
    """
    rest = [c for c in tokens.columns if c not in (key, "pos")]
    lists = tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *rest)), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)).alias("tokens"))
    return detokenise_rows(lists, key).select(*tokens.columns, "sep", "end", "start")


def space_join(tokens: DataFrame, key: str) -> DataFrame:
    """``tokens`` (key, pos, token) with start and end in their join by single spaces."""
    end = (F.sum(F.length("token") + 1).over(Window.partitionBy(key).orderBy("pos")) - 1).cast("int")
    return tokens.withColumn("end", end).withColumn("start", F.col("end") - F.length("token"))


def pack_sentences(sentences: DataFrame, key: str, most: int) -> DataFrame:
    """``sentences`` (key, pos, size) with ``piece``: greedily filled up to ``most``; a longer sentence is a piece of its own.

    Greedy filling is sequential inside a document, so it folds over the document's sentence sizes only.
    """
    sizes = F.sort_array(F.collect_list(F.struct("pos", "size")))
    start = F.struct(F.lit(-1).alias("piece"), F.lit(0).cast("bigint").alias("held"), F.expr("cast(array() as array<struct<pos:int,piece:int>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["piece"] >= 0) & (acc["held"] + x["size"] <= most)
        piece = F.when(fits, acc["piece"]).otherwise(acc["piece"] + 1)
        held = F.when(fits, acc["held"] + x["size"]).otherwise(x["size"].cast("bigint"))
        return F.struct(piece.alias("piece"), held.alias("held"), F.concat(acc["out"], F.array(F.struct(x["pos"].cast("int").alias("pos"), piece.alias("piece")))).alias("out"))

    placed = sentences.groupBy(key).agg(F.aggregate(sizes, start, step)["out"].alias("out"))
    return sentences.join(placed.select(key, F.inline("out")), [key, "pos"])
