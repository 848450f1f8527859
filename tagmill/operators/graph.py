"""Graph operators on edge tables: components, reachability, cycles, neighbourhoods, canonical edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagmill.written import cut, forget

#: Edges of a graph up to which it is labelled in one row; larger graphs go through rounds of joins.
GATHERED = 10_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a is not null and b is not null").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that edges (a, b) reach; a node with an edge to itself alone is its own.

    Labels go to the least label among the neighbours, then follow the label's own label; rounds are about the logarithm
    of the longest path. Each round is written and the one before deleted, so plans stay short and a lost executor costs
    nothing. Edges with a null end are left out; repeated edges count once; no edge gives an empty result.
    """
    both = cut(_both_ways(edges), "links")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.select("id", F.col("component").alias("old")).join(near, "id").select("id", "old", F.least("old", "near").alias("new"))
        up = labels.select(F.col("id").alias("new"), F.col("component").alias("up"))
        found = cut(step.join(up, "new", "left").select("id", "old", F.least("new", F.coalesce("up", "new")).alias("component")), "labels")
        forget(labels)
        if found.filter("component != old").isEmpty():
            forget(both)
            return found.drop("old")
        labels = found


def _labelled(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """(key, id, component) of rows (key, edges): all graphs of a batch at once, each node taking the least place it hears of."""
    for batch in batches:
        lists = batch.column(1)
        ends, graph = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        if not len(ends):
            continue
        names = pa.chunked_array([ends.field("a"), ends.field("b")]).combine_chunks().dictionary_encode()
        order = np.asarray(pc.sort_indices(names.dictionary))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        both = np.concatenate([graph, graph]) * len(order) + place[np.asarray(names.indices)]  # nodes by graph, then by name
        nodes, at = np.unique(both, return_inverse=True)
        a, b = at[: len(ends)], at[len(ends) :]
        label = np.arange(len(nodes))
        while True:
            least = np.minimum(label[a], label[b])
            found = label.copy()
            np.minimum.at(found, label[a], least)
            np.minimum.at(found, label[b], least)
            found = found[found[label]]
            if (found == label).all():
                break
            label = found
        name = lambda x: names.dictionary.take(pa.array(order[x % len(order)]))  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(nodes // len(order))), name(nodes), name(nodes[label])], [key, "id", "component"])


def components_within(edges: DataFrame, key: str) -> DataFrame:
    """(key, id, component) of many graphs' edges (key, a, b): the smallest id of the same graph that edges reach, in either direction.

    Graphs of up to GATHERED edges are labelled in a row each, by one shuffle; larger ones in rounds, as ``components``. Edges
    with a null key or end are left out.
    """
    real = edges.select(key, "a", "b").filter(F.col(key).isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull())
    sized = cut(real.withColumn("_n", F.count("*").over(Window.partitionBy(key))), "sized")
    kinds = dict(edges.dtypes)
    small = sized.filter(F.col("_n") <= GATHERED).groupBy(key).agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    out = small.mapInArrow(lambda batches: _labelled(batches, key), f"`{key}` {kinds[key]}, id {kinds['a']}, component {kinds['a']}")
    large = sized.filter(F.col("_n") > GATHERED)
    if large.isEmpty():
        return out
    node = lambda c: F.struct(F.col(key).alias("k"), F.col(c).alias("v"))
    rounds = components(large.select(node("a").alias("a"), node("b").alias("b")))
    return out.unionByName(rounds.select(F.col("id.k").alias(key), F.col("id.v").alias("id"), F.col("component.v").alias("component")))


def reached_within(edges: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """(key, id) of the nodes of many graphs' edges (key, a, b) that lead to or from an anchor (key, id) of the same graph, in either direction, and the anchors."""
    classes = cut(components_within(edges, key), "classes")
    start = anchors.select(key, "id").filter(F.col(key).isNotNull() & F.col("id").isNotNull()).distinct()
    near = classes.join(start, [key, "id"], "left_semi").select(key, "component").distinct()
    return classes.join(near, [key, "component"], "left_semi").select(key, "id").unionByName(start).distinct()


def reachable(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id) of all nodes that directed edges (a, b) reach from ``anchors`` (id), these included; one join a level.

    Each level writes its front alone. Null ends and anchors are left out; no anchor gives an empty result.
    """
    fronts = [cut(anchors.select("id").filter("id is not null").distinct(), "front")]
    while not fronts[-1].isEmpty():
        step = edges.join(fronts[-1], edges["a"] == fronts[-1]["id"], "left_semi").select(F.col("b").alias("id")).filter("id is not null").distinct()
        for front in fronts:
            step = step.join(front, "id", "left_anti")
        fronts.append(cut(step, "front"))
        if len(fronts) > 4:  # a long chain: the fronts so far become one table, so that a level joins few
            merged = cut(_union(fronts[:-1]), "front")
            forget(*fronts[:-1])
            fronts = [merged, fronts[-1]]
    return _union(fronts)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(id) of the nodes that lie on a directed cycle, edges to oneself included; empty: acyclic.

    Each node learns the least node that reaches it and the least that it reaches, itself included. Where both are one and
    the same other node, both lie on a cycle with it; a node that is its own least both ways lies on a cycle only with such
    others, as they would have learnt it. Edges between other pairs of labels belong to no common cycle and go, and the rest
    starts anew with what is still undecided. Null ends are left out; no edge gives an empty result.
    """
    left = cut(edges.select("a", "b").filter("a is not null and b is not null").distinct(), "edges")
    found = [cut(left.filter("a = b").select(F.col("a").alias("id")).distinct(), "cyclic")]
    left, before = cut(left.filter("a <> b"), "edges"), left
    forget(before)
    while not left.isEmpty():
        labels = cut(_least_both_ways(left), "labels")
        mates = labels.filter("down = up and id <> down")
        found.append(cut(mates.select(F.explode(F.array("id", "down")).alias("id")).distinct(), "cyclic"))
        open_ = labels.filter("down <> up")
        ends = lambda c: open_.select(F.col("id").alias(c), F.col("down").alias(f"d{c}"), F.col("up").alias(f"u{c}"))  # noqa: E731, B023
        rest = left.join(ends("a"), "a").join(ends("b"), "b").filter("da = db and ua = ub").select("a", "b")
        # a node that no edge enters, or none leaves, is on no cycle
        rest = rest.join(rest.select(F.col("b").alias("a")), "a", "left_semi").join(rest.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b")
        rest = cut(rest, "edges")
        forget(left, labels)
        left = rest
    return _union(found).distinct()


def _least_both_ways(edges: DataFrame) -> DataFrame:
    """(id, down, up): the least node that reaches ``id`` and the least that it reaches, itself included.

    The search goes by the least node that reaches a node over one edge or more. What reaches that label reaches its bearer
    too, and stands before it, so a label is never stuck at itself: each round takes labels one edge on and follows labels
    of labels twice. They come from about twice as far in each round, and a ring of n nodes takes about log n rounds, a table each.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    first = lambda own, other, name: edges.groupBy(F.col(own).alias("id")).agg(F.min(other).alias(name))
    labels = cut(nodes.join(first("b", "a", "down"), "id", "left").join(first("a", "b", "up"), "id", "left"), "least")
    while True:
        sent = lambda source, target, name: edges.join(labels.select(F.col("id").alias(source), name), source).groupBy(F.col(target).alias("id")).agg(F.min(name).alias(f"{name}0"))  # noqa: E731, B023
        told = labels.join(sent("a", "b", "down"), "id", "left").join(sent("b", "a", "up"), "id", "left")
        for name in ("down", "up"):
            own = labels.select(F.col("id").alias("_of"), F.col(name).alias("_next"))
            for i, at in ((1, name), (2, f"{name}1")):
                told = told.join(own.withColumnsRenamed({"_of": f"_of{name}{i}", "_next": f"{name}{i}"}), F.col(at) == F.col(f"_of{name}{i}"), "left")
        least = lambda name: F.least(*(f"{name}{i}" for i in ("", 0, 1, 2)))
        moved = F.coalesce(least("down") < F.col("down"), F.lit(False)) | F.coalesce(least("up") < F.col("up"), F.lit(False))
        found = cut(told.select("id", least("down").alias("down"), least("up").alias("up"), moved.alias("_moved")), "least")
        forget(labels)
        if found.filter("_moved").isEmpty():
            return found.select("id", F.least("id", "down").alias("down"), F.least("id", "up").alias("up"))
        labels = found


def neighbourhoods(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, id, outgoing, incoming, neighbours): edges (a, b) that leave and enter each node, and its distinct other ends but itself."""
    keys = keys or []
    end = lambda me, other, out: F.struct(F.col(me).alias("id"), F.col(other).alias("other"), F.lit(out).alias("out"))
    ends = edges.select(*keys, F.explode(F.array(end("a", "b", 1), end("b", "a", 0))).alias("e")).select(*keys, "e.*").filter("id is not null")
    return ends.groupBy(*keys, "id").agg(F.sum("out").alias("outgoing"), F.sum(1 - F.col("out")).alias("incoming"), F.count_distinct(F.when(F.col("other") != F.col("id"), F.col("other"))).alias("neighbours"))


def broken_symmetry(edges: DataFrame) -> DataFrame:
    """Edges (a, b) whose reverse is missing."""
    return edges.join(edges.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")


def broken_inverse(edges: DataFrame, relation: str, inverse: str) -> DataFrame:
    """Edges (a, b, relation) of ``relation`` whose reverse is missing among ``inverse``, and the other way round; null ends never have one."""
    left, right = edges.filter(F.col("relation") == relation), edges.filter(F.col("relation") == inverse)
    lacking = lambda f, g: f.join(g.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti").select("a", "b", "relation")
    return lacking(left, right).unionByName(lacking(right, left))
