"""Events, sparse scores, frozen builds, records and results: plain loops, odd rows, second runs and broken invariants."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tagmill.operators import events, formatting, reviewing, sanitize, sparse
from tagmill.sources import frozen
from tagmill.written import complete, new_folder


def test_events_are_matched_stably(spark):
    rng = random.Random(5)
    anchors = [(d, f"a{i}") for d in range(6) for i in range(rng.randint(0, 4))] + [(None, "a0"), (9, "alone")]
    offers = [(d, a, f, f"m{rng.randint(0, 4)}", round(rng.random(), 1)) for d, a in anchors if a != "alone" for f in ("part", "tag", "odd") for _ in range(5)]
    offers += [(0, "nobody", "part", "m1", 9.0), (0, "a0", "part", None, 9.0), (0, "a0", "part", "m0", None)]
    fields = [events.Field("part", 1, 2), events.Field("tag", 0, 1, exclusive=False)]
    out = events.bind_fields(spark.createDataFrame(anchors, "doc int, anchor string"), spark.createDataFrame(offers, "doc int, anchor string, field string, mention string, score double"), ["doc"], fields).collect()
    got = {(r.doc, r.anchor): r for r in out}
    assert got.keys() == set(anchors)
    for doc in {d for d, _ in anchors}:
        best: dict = {}
        for d, a, f, m, s in offers:
            if d == doc and (d, a) in anchors and m and s is not None:
                best[f, a, m] = max(s, best.get((f, a, m), s))
        bound, room = set(), {}
        for (_, a, m), s in sorted(((k, s) for k, s in best.items() if k[0] == "part"), key=lambda x: (-x[1], x[0][1], x[0][2])):
            if m not in bound and len(room.get(a, [])) < 2:
                bound.add(m)
                room.setdefault(a, []).append((m, s))
        for a in [a for d, a in anchors if d == doc]:
            fields_of = {k: [(x.mention, x.score) for x in v] for k, v in (got[doc, a].fields or {}).items()}
            assert fields_of.get("part", []) == room.get(a, []) and got[doc, a].complete == bool(room.get(a)) == (got[doc, a].missing == [])
            tags = sorted(((m, s) for (f, b, m), s in best.items() if f == "tag" and b == a), key=lambda x: (-x[1], x[0]))[:1]
            assert fields_of.get("tag", []) == tags and "odd" not in fields_of


def test_sparse_scores_equal_the_dense_grid(spark):
    vocabulary = [("t", x) for x in "abcde"] + [("u", "x"), ("t", "a"), ("t", None)]
    scores = [(1, "t", "a", 2.0), (1, "t", "b", -1.0), (2, "t", "c", 0.5), (2, "t", "c", 0.7), (2, "t", "zz", 0.1), (2, "t", "d", float("nan")), (3, "u", "x", 1.0), (4, "t", "e", None), (5, "t", "a", 50.0), (None, "t", "a", 1.0)]
    frames = spark.createDataFrame(scores, "id int, task string, label string, logit double"), spark.createDataFrame(vocabulary, "task string, label string")
    good, problems = sparse.checked_scores(*frames, ["id"], -10, 10)
    assert {(r.id, r.label, r.problem) for r in problems.collect()} == {(2, "c", "duplicate"), (2, "zz", "unknown label"), (2, "d", "out of range"), (4, "e", "out of range"), (5, "a", "out of range")}
    out = {(r.id, r.label): (r.p, r.implied_p) for r in sparse.implied_softmax(good, frames[1], ["id"], -0.5).collect()}
    grid = [math.exp(x) for x in (2.0, -1.0, -0.5, -0.5, -0.5)]
    assert out[1, "a"] == (pytest.approx(grid[0] / sum(grid)), pytest.approx(grid[2] / sum(grid)))
    assert out[3, "x"] == (pytest.approx(1.0), None) and set(out) == {(1, "a"), (1, "b"), (3, "x"), (None, "a")}


def test_builds_are_published_once_and_whole(spark):
    path = new_folder(spark, "build")
    rows = spark.range(100).select("id", F.concat(F.lit("p"), F.col("id") % 4).alias("part"), F.when(F.col("id") != 3, "x").alias("note"))
    first = frozen.publish(rows, path, "part", {})
    assert first.changed == ["p0", "p1", "p2", "p3"] and frozen.publish(rows.repartition(7), path, "part", {}).changed == []
    when = {f: s.getModificationTime() for f, s in _files(spark, first.data).items()}
    with pytest.raises(ValueError, match="ids are few"):
        frozen.publish(rows.limit(5), path, "part", {"ids are few": lambda r, m: m.filter("rows > 1")})
    assert {f: s.getModificationTime() for f, s in _files(spark, first.data).items()} == when and spark.read.parquet(first.data).count() == 100
    third = frozen.publish(rows.filter("part <> 'p3' and id <> 4"), path, "part", {})
    assert third.changed == ["p0"] and third.removed == ["p3"]
    back = spark.read.parquet(third.data)
    assert sorted(r.id for r in back.collect()) == [i for i in range(100) if i % 4 != 3 and i != 4]
    assert {f for f in _files(spark, first.data) if "part=p1" in f} == {f for f in when if "part=p1" in f}
    spark._jvm.org.apache.hadoop.fs.Path(f"{third.manifest}/_SUCCESS").getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{third.manifest}/_SUCCESS"), False)
    assert not complete(spark, third.manifest) and frozen.publish(rows, path, "part", {}).changed == ["p0", "p1", "p2", "p3"]


def _files(spark, path):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, it = {}, store.listFiles(root, True)
    while it.hasNext():
        status = it.next()
        if status.getPath().getName().endswith(".parquet"):
            found[str(status.getPath())] = status
    return found


def test_records_keep_what_the_text_holds(spark):
    text = "Ada Lovelace lived in London."
    record = ([("person", ["ADA", ""]), ("city", ["Paris", "London"]), ("", ["Ada"]), ("none", None)], [("tone", ["calm"], ["calm"]), ("tone", ["calm"], ["loud"]), ("tone", [], []), ("x", ["a"], None)], [("s", [("who", ["ada"], None), ("where", ["Rome"], None), ("size", ["big"], ["big", "small"])]), ("t", [("where", ["Rome"], None)]), ("", [("who", ["Ada"], None)])], [("in", [("a", "Ada"), ("b", "london")]), ("in", [("a", "Ada"), ("b", "Rome")]), ("none", [])])
    rows = [(1, text, record), (2, None, record), (3, "  ", record), (4, text, None), (5, text, (None, None, None, None)), (6, "nothing here", record)]
    out = {r.id: r for r in sanitize.sanitize(spark.createDataFrame(rows, f"id int, text string, record {sanitize.RECORD}"), "text", "record").collect()}
    clean = out[1].record
    assert [e.type for e in clean.entities] == ["person", "none"] and [c.task for c in clean.classes] == ["tone", "x"]
    assert [(s.name, [f.name for f in s.fields]) for s in clean.structures] == [("s", ["who", "size"])] and len(clean.relations) == 1
    assert out[1].valid and not any(out[i].valid for i in (2, 3, 4, 5))
    assert [e.type for e in out[6].record.entities] == ["none"] and [[f.name for f in s.fields] for s in out[6].record.structures] == [["size"]]


def test_results_are_filled_in(spark):
    docs = spark.createDataFrame([(1,), (2,), (2,), (None,)], "doc int")
    ents = spark.createDataFrame([(1, "email", "A@b", 5, 8, 0.5), (1, "email", "a@B", 5, 8, 0.9), (1, "email", "c@d", 1, 4, 0.2), (1, "email", " ", 0, 1, 0.9), (7, "email", "x", 0, 1, 0.9), (None, "card", "1", 0, 1, 0.1), (1, None, "z", 0, 1, 0.3)], "doc int, label string, text string, start int, end int, confidence double")
    rels = spark.createDataFrame([(1, "knows", "a", "b", 0.3), (1, "knows", "a", "b", 0.8), (1, "knows", "c", "d", 0.9)], "doc int, relation string, head string, tail string, confidence double")
    classes = spark.createDataFrame([(1, "tone", "calm", 0.4), (1, "tone", "sad", 0.6), (1, "tone", None, 0.9)], "doc int, task string, label string, confidence double")
    asked = {"entities": ["phone"], "relations": ["hates"], "classes": ["topic"]}
    out = {r.doc: r for r in formatting.format_results(docs, ents, rels, classes, "doc", asked).collect()}
    assert len(out) == 3 and out[1].entities == {"email": ["c@d", "a@B"], "phone": []} and out[2].entities == {"phone": []} and out[None].entities == {"card": ["1"], "phone": []}
    assert {k: [tuple(p) for p in v] for k, v in out[1].relations.items()} == {"knows": [("c", "d"), ("a", "b")], "hates": []} and out[1].classes == {"tone": ["sad", "calm"], "topic": []}
    sure = {r.doc: r for r in formatting.format_results(docs, ents, rels, classes, "doc", {}, confidence=True).collect()}
    assert [tuple(x) for x in sure[1].entities["email"]] == [("c@d", 0.2), ("a@B", 0.9)] and sure[2].classes == {}
    spans = spark.createDataFrame([([("a", 0.5, 0, 1)], [("a", 0.5, 0, 1, "k")])], "s array<struct<text:string,confidence:double,start:int,end:int>>, e array<struct<text:string,confidence:double,start:int,end:int,kind:string>>")
    shown = lambda c, **kw: spans.select(reviewing.stripped(spans, c, **kw).alias("x")).first().x
    assert shown("s") == ["a"] and shown("e")[0].asDict() == {"text": "a", "kind": "k"} and shown("s", places=True)[0].asDict() == {"text": "a", "start": 0, "end": 1}
