"""Many small graphs labelled in rows, and relations matched through them: the same as rounds of joins and plain turns."""

from __future__ import annotations

import random

import pytest

from tagmill.operators import graph, relations


@pytest.mark.parametrize(("gathered", "kind"), [(graph.GATHERED, "int"), (0, "int"), (5, "string")])
def test_components_within(spark, monkeypatch, gathered, kind):
    monkeypatch.setattr(graph, "GATHERED", gathered)
    draw = random.Random(5)
    edges = [(k, draw.randrange(12), draw.randrange(12)) for k in range(30) for _ in range(draw.randrange(9))] + [(99, i, i + 1) for i in range(60)] + [(None, 1, 2), (3, None, 2)]
    rows = spark.createDataFrame(edges, "k long, a int, b int").selectExpr("k", f"cast(a as {kind}) as a", f"cast(b as {kind}) as b")
    want = {}
    name = str if kind == "string" else int
    for k, a, b in edges:
        if None not in (k, a, b):
            for x in (name(a), name(b)):
                want.setdefault((k, x), {x})
            both = want[k, name(a)] | want[k, name(b)]
            for x in both:
                want[k, x] = both
    found = {(r.k, r.id): r.component for r in graph.components_within(rows, "k").collect()}
    assert found == {at: min(xs) for at, xs in want.items()}


@pytest.mark.parametrize("short", [relations.SHORT, 0])
def test_coreferent_turns(spark, monkeypatch, short):
    monkeypatch.setattr(relations, "SHORT", short)
    draw = random.Random(7)
    docs = range(6)
    ents = [(d, i, draw.choice([None, i - 1, 77])) for d in docs for i in range(6)]
    ments = [(d, i, s := draw.randrange(120), s + 9) for d in docs for i in range(6)]
    gold = [(d, i, draw.choice("xy"), draw.randrange(7), draw.randrange(7)) for d in docs for i in range(8)]
    pred = [(d, i, draw.choice("xy"), s := draw.randrange(120), s + 12, t := draw.randrange(120), t + 12) for d in docs for i in range(9)]
    of = {}
    for d, i, same in ents:
        of[d, i] = of.get((d, same), i)
    hit = lambda d, s, e: {of[x, i] for x, i, a, b in ments if x == d and a < e and s < b}
    want, used_p, used_g = set(), set(), set()
    pairs = []
    for d, p, r, hs, he, ts, te in pred:
        for d2, g, r2, h, t in gold:
            if (d, r) == (d2, r2) and (d, h) in of and (d, t) in of:
                for turned, (a, b) in enumerate(((h, t), (t, h))):
                    if of[d, a] in hit(d, hs, he) and of[d, b] in hit(d, ts, te):
                        pairs.append((d, r, turned, p, g))
    for d, r, turned, p, g in sorted(pairs):
        if (d, p) not in used_p and (d, g) not in used_g:
            used_p.add((d, p))
            used_g.add((d, g))
            want.add((d, r, "reversed" if turned else "match", g, p))
    want |= {(d, r, "fn", g, None) for d, g, r, _, _ in gold if (d, g) not in used_g} | {(d, r, "fp", None, p) for d, p, r, *_ in pred if (d, p) not in used_p}
    frames = (spark.createDataFrame(rows, schema) for rows, schema in ((ents, "doc long, id long, same_as long"), (ments, "doc long, id long, start int, end int"), (gold, "doc long, i long, relation string, head long, tail long"), (pred, "doc long, i long, relation string, head_start int, head_end int, tail_start int, tail_end int")))
    assert {tuple(r) for r in relations.match_coreferent(*frames, "doc").select("doc", "relation", "status", "gold_i", "pred_i").collect()} == want
