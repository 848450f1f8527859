"""Graph checks over many graphs at once, of which some are long chains."""

from __future__ import annotations

from tagmill.operators import bundles, graph
from tagmill.operators.bundles import bundle_problems


def test_chains_take_no_rounds(spark, monkeypatch):
    """A chain of 400 nodes took 400 levels of joins; it is labelled in a row, and nothing is left to rounds."""
    monkeypatch.setattr(graph, "components", None)
    ids = [(d, i) for d in (1, 2) for i in range(400)]
    ents = spark.createDataFrame([(d, i, "A") for d, i in ids] + [(2, 5, "A")], "doc int, id int, label string")
    rels = spark.createDataFrame([(d, "r", i + 1, i) for d, i in ids if i < 399 and (d, i) != (2, 300)] + [(1, "r", 7, 7), (1, "r", 3, 999), (1, "q", 1, 2)], "doc int, relation string, head int, tail int")
    kinds = spark.createDataFrame([("r", "head", "A"), ("r", "tail", "A"), ("r", "tail", "A"), ("q", "head", "B"), ("q", "tail", "A")], "relation string, side string, label string")
    out = [tuple(r) for r in bundle_problems(ents, rels, kinds, spark.createDataFrame([(1, 0), (2, 0)], "doc int, id int"), "doc").collect()]
    want = {(2, "duplicate id", "5"), (1, "self-relation", "r"), (1, "missing end", "r"), (1, "head label", "q/A")} | {(2, "not connected", str(i)) for i in range(301, 400)}
    assert len(out) == len(want) and set(out) == want
    assert bundles.reached_within is graph.reached_within
