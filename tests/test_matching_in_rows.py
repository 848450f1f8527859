"""Relation triples matched in one row each record: short lists and long ones give what plain turns give."""

from __future__ import annotations

import random

import pytest

from tagmill.operators import relations

GOLD, PRED = "record long, relation string, i long, heads array<string>, tails array<string>", "record long, relation string, i long, head string, tail string, u double"


def plain(gold, pred, least, lenient):
    done, used = set(), set()
    pairs = sorted((p[2], g[2]) for p in pred for g in gold if p[:2] == g[:2] and None not in p[:2] and p[5] is not None and p[5] >= least and None not in p[3:5] and ((p[3] in g[3] and p[4] in g[4]) or (lenient and p[4] in g[3] and p[3] in g[4])))
    for p, g in pairs:
        if p not in done and g not in used:
            done.add(p)
            used.add(g)
    return len(used)


@pytest.mark.parametrize("short", [relations.SHORT, 0])
def test_counts_at_thresholds(spark, monkeypatch, short):
    monkeypatch.setattr(relations, "SHORT", short)
    draw = random.Random(3)
    name = lambda: draw.choice(["a", "b", "c", None])
    gold = [(1, "x", i, [name(), name()], [name()]) for i in range(9)] + [(None, "x", 1, ["a"], ["b"]), (2, "y", 1, ["a"], ["b"])]
    pred = [(1, "x", i // 2, name(), name(), draw.choice([0.1, 0.3, 0.6, None])) for i in range(14)] + [(None, "x", 1, "a", "b", 0.9), (2, "y", 1, "b", "a", 0.9), (3, "y", 1, "a", "a", 0.9)]
    out = relations.match_counts(spark.createDataFrame(gold, GOLD), spark.createDataFrame(pred, PRED), [0.2, 0.5]).collect()
    assert len(out) == 8
    for r in out:
        g, p = [x for x in gold if x[0] == r.record], [x for x in pred if x[0] == r.record and x[5] is not None and x[5] >= r.threshold]
        strict, lenient = plain(g, p, r.threshold, False), plain(g, p, r.threshold, True)
        assert (r.tp, r.fp, r.fn, r.lenient_tp, r.lenient_fp, r.lenient_fn) == (strict, len(p) - strict, len(g) - strict, lenient, len(p) - lenient, len(g) - lenient)


def test_many_equal_triples_make_no_pairs(spark):
    """4,000 copies on each side would be 16 million pairs; they stay two lists."""
    n = spark.range(4000)
    gold = n.selectExpr("1L as record", "'x' as relation", "id as i", "array('A') as heads", "array('b') as tails")
    pred = n.selectExpr("1L as record", "'x' as relation", "id as i", "'a ' as head", "'b' as tail")
    (row,) = relations.match_records(gold, pred).collect()
    assert (row.tp, row.fp, row.fn) == (4000, 0, 0)
