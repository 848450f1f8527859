"""Weighted draws by running sums, caches across runs and restarts at a stage."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from tagmill.operators import bundles as b
from tagmill.operators.leakage import shared_passages
from tagmill.operators.ranking import running_total
from tagmill.operators.vocabulary import unique_names
from tagmill.written import complete, new_folder


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([1.0, 2.0, None])) for i in range(300)]
    got = {(r.g, r.i): (r.upto, r.upto_all) for r in running_total(spark.createDataFrame(rows, "g string, i int, w double"), ["g"], ["i"], "w").collect()}
    for g, i, _ in rows:
        mine = [(j, w or 0.0) for h, j, w in rows if h == g]
        assert got[g, i] == (sum(w for j, w in mine if j <= i), sum(w for _, w in mine))


def test_star_draws_by_weight(spark):
    """A heavy place, many light ones in its bucket, and places that must never come."""
    towns = [("x", "heavy", 500.0)] + [("x", f"t{i}", 1.0) for i in range(250)] + [("x", "none", 0.0), ("x", "gone", None), ("y", "only", 0.5), ("empty", "z", 0.0)]
    streets = [("heavy", "h1", 1.0), ("heavy", "h2", 3.0)] + [(f"t{i}", f"s{i}", 1.0) for i in range(250)] + [("only", "o1", 2.0)]
    start = spark.range(8000).select("id", F.when(F.col("id") % 80 == 0, "y").when(F.col("id") % 81 == 0, "empty").otherwise("x").alias("city"))
    levels = [(spark.createDataFrame(towns, "city string, town string, weight double"), "town", "city"), (spark.createDataFrame(streets, "town string, street string, weight double"), "street", "town")]
    out = b.star_pick(levels, start, ["id"]).collect()
    n = Counter(r.city for r in start.collect())
    assert len(out) == n["x"] + n["y"] and len({r.id for r in out}) == len(out)
    town, street = Counter(r.town for r in out), Counter(r.street for r in out)
    assert town["only"] == n["y"] and not town["none"] and not town["gone"]
    assert abs(town["heavy"] / n["x"] - 500 / 750) < 0.02 and abs(street["h2"] / town["heavy"] - 0.75) < 0.03
    assert len(town) > 240 and all(r.street[1:] == r.town[1:] for r in out if r.town[0] == "t")
    assert b.star_pick(levels, start, ["id"]).exceptAll(spark.createDataFrame(out, b.star_pick(levels, start, ["id"]).schema)).count() == 0


def test_second_run_computes_nothing(spark):
    path = new_folder(spark, "cache")
    rows = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None), (5, "")], "id int, s string")
    size = lambda c: F.length(c)
    assert b.cached_each(rows.filter("id < 3"), "s", size, "n", path)[1] == 2
    out, fresh = b.cached_each(rows, "s", size, "n", path)
    assert fresh == 1 and {r.id: r.n for r in out.collect()} == {1: 2, 2: 1, 3: 2, 4: None, 5: 0}
    wrong = lambda c: F.raise_error(F.lit("computed again")).cast("int")
    again, fresh = b.cached_each(rows, "s", wrong, "n", path)
    assert fresh == 0 and sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_stages_start_where_they_must(spark):
    path = new_folder(spark, "stages")
    stages = [("one", lambda _: spark.range(5)), ("two", lambda t: t.filter("id > 1")), ("three", lambda t: t.withColumn("x", F.col("id") * 2))]
    assert b.staged(spark, path, stages)[1] == ["one", "two", "three"]
    table, ran = b.staged(spark, path, stages)
    assert ran == [] and sorted(r.x for r in table.collect()) == [4, 6, 8]
    assert b.staged(spark, path, stages, "two")[1] == ["two", "three"]
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/two/_SUCCESS")
    fs.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs, False)
    assert not complete(spark, f"{path}/two") and b.staged(spark, path, stages)[1] == ["two", "three"]


def test_one_name_of_many_nodes(spark):
    nodes = spark.range(5000).select("id", F.when(F.col("id") == 7, "Other").otherwise("Same").alias("name"))
    names = {r.id: r.unique_name for r in unique_names(nodes, "id", "name").collect()}
    assert names[0] == "Same" and names[7] == "Other" and names[4999] == "Same 4999" and len(set(names.values())) == 5000


def test_passages_with_and_without_a_filter(spark, monkeypatch):
    from tagmill.operators import leakage

    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(None, "w1 w2 w3 w4 w5"), (70, None), (71, " W1\tw2\n w3  w4 w5 "), (1, "w1 w2 w3 w4 w5 w6"), (72, "x " * 60_000)]
    items = [(f"i{i}", " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))) for i in range(20)] + [("short", "w1"), ("five", "w1 w2 w3 w4 w5"), (None, "w1 w2 w3 w4 w5")]
    runs = lambda t: {" ".join(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(len(w) - 4)}
    want = {(d, k, s) for d, t in docs if d is not None for k, u in items if k for s in runs(t) & runs(u)}
    frames = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item string, text string")
    for largest in (1 << 29, 0):
        monkeypatch.setattr(leakage, "LARGEST", largest)
        assert {tuple(r) for r in shared_passages(*frames, "doc", "item").collect()} == want
    assert shared_passages(frames[0].limit(0), frames[1], "doc", "item").count() == 0
    assert shared_passages(frames[0], frames[1].limit(0), "doc", "item").count() == 0
