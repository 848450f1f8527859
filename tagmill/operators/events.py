"""Event structures: anchors with fields of given numbers, each mention bound to the anchor it fits best."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Field(NamedTuple):
    """From ``least`` to ``most`` mentions of an anchor; an ``exclusive`` field's mention is bound to one anchor only."""

    name: str
    least: int = 0
    most: int = 1
    exclusive: bool = True


def _matched(batches: Iterator[pa.RecordBatch], fields: list[Field], keys: int) -> Iterator[pa.RecordBatch]:
    """A row for each anchor of each row's list, with a list a field of the offers it got; a batch's lists are made at once."""
    for batch in batches:
        lists, offers = batch.column(keys), batch.column(keys + 1)
        own, told = lists.flatten(), offers.flatten()
        anchors, sizes = own.to_pylist(), zip(lists.value_lengths().to_pylist(), offers.value_lengths().to_pylist(), strict=True)
        stream = zip(*(told.field(c).to_pylist() for c in ("field", "anchor", "mention")), strict=True)
        rows, slots, got = [], [], [[] for _ in fields]
        begin = at = 0
        for n, (known, size) in enumerate(sizes):
            place: dict = {}
            for i in range(begin, begin + known):
                if anchors[i] not in place:
                    place[anchors[i]] = len(slots)
                    rows.append(n)
                    slots.append(i)
                    for each in got:
                        each.append([])
            begin += known
            taken: set = set()
            for i in range(at, at + size):
                field, anchor, mention = next(stream)
                slot = place.get(anchor)
                what = (field, mention) if fields[field].exclusive else (field, mention, slot)
                if slot is not None and len(got[field][slot]) < fields[field].most and what not in taken:
                    taken.add(what)
                    got[field][slot].append(i)
            at += size
        items = []
        for each in got:
            ends = pa.array([0, *accumulate(map(len, each))], pa.int32())
            chosen = told.take(pa.array(list(chain.from_iterable(each)), pa.int64()))
            items.append(pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([chosen.field(c) for c in ("mention", "score")], ["mention", "score"])))
        at_rows = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at_rows) for i in range(keys)), own.take(pa.array(slots, pa.int64())), *items], [*batch.schema.names[:keys], "anchor", *(f"_f{i}" for i in range(len(fields)))])


def bind_rows(rows: DataFrame, keys: list[str], fields: list[Field]) -> DataFrame:
    """As ``bind_fields``, for ``rows`` (keys, anchors, offers), one a key: a list of anchors and one of structs (anchor, field, mention, score); nothing is shuffled."""
    number = lambda x: F.coalesce(*(F.when(x["field"] == f.name, F.lit(i)) for i, f in enumerate(fields)), F.lit(None).cast("int"))
    told = F.filter("offers", lambda x: x["score"].isNotNull() & x["mention"].isNotNull() & number(x).isNotNull())
    listed = F.sort_array(F.transform(told, lambda x: F.struct((-x["score"]).alias("less"), x["anchor"].alias("anchor"), x["mention"].alias("mention"), number(x).alias("field"), x["score"].alias("score"))))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    lists = rows.select(*keys, "anchors", listed.alias("offers"))
    types = {f.name: f.dataType for f in lists.schema}
    lists = lists.select(*keys, *(none(c, types[c]).alias(c) for c in ("anchors", "offers")))
    offer = types["offers"].elementType
    item = f"array<struct<mention: {offer['mention'].dataType.simpleString()}, score: {offer['score'].dataType.simpleString()}>>"
    schema = ", ".join([*(f"`{k}` {types[k].simpleString()}" for k in keys), f"anchor {types['anchors'].elementType.simpleString()}", *(f"_f{i} {item}" for i in range(len(fields)))])
    n_keys = len(keys)
    out = lists.mapInArrow(lambda batches: _matched(batches, fields, n_keys), schema)
    held = F.filter(F.array(*(F.struct(F.lit(f.name).alias("field"), F.col(f"_f{i}").alias("items")) for i, f in enumerate(fields))), lambda x: F.size(x["items"]) > 0)
    lacking = F.filter(F.array(*(F.when(F.size(f"_f{i}") < f.least, f.name) for i, f in enumerate(fields))), lambda x: x.isNotNull())
    return out.select(*keys, "anchor", F.when(F.size(held) > 0, F.map_from_entries(held)).alias("fields"), lacking.alias("missing"), (F.size(lacking) == 0).alias("complete"))


def bind_fields(anchors: DataFrame, offers: DataFrame, keys: list[str], fields: list[Field]) -> DataFrame:
    """(keys, anchor, fields, missing, complete) for each of ``anchors`` (keys, anchor): fields as a map from name to (mention, score), best first.

    ``offers`` (keys, anchor, field, mention, score) say how well a mention fits an anchor's field. In an exclusive field
    mentions and anchors are matched stably: no mention and anchor would both rather have each other than what they
    got. As both sides go by one score, that is to take offers from the best down, ties to the lesser anchor and mention,
    each if its mention is free and its anchor has room. In other fields each anchor takes its best. ``missing`` are the fields
    with fewer than ``least``. Offers of unknown fields, with null scores or mentions or to unknown anchors don't count; an offer
    made twice counts with its best score; a null key is a key. A key's anchors and offers meet in one row, by one shuffle.
    """
    known = anchors.select(*keys, "anchor", F.lit(False).alias("_offer"), F.lit(None).cast("string").alias("field"))
    told = offers.select(*keys, "anchor", F.lit(True).alias("_offer"), "field", "mention", "score")
    both = known.unionByName(told, allowMissingColumns=True)
    rows = both.groupBy(*keys).agg(F.collect_set(F.when(~F.col("_offer"), F.struct("anchor")))["anchor"].alias("anchors"), F.collect_list(F.when(F.col("_offer"), F.struct("anchor", "field", "mention", "score"))).alias("offers"))
    own = {f.name: f.dataType for f in anchors.schema}
    return bind_rows(rows, keys, fields).withColumns({c: F.col(c).cast(own[c]) for c in (*keys, "anchor")})
