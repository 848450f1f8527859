"""Ties of chosen values, and labels by largest overlap where many share a place."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from tagmill.operators.relations import best_label
from tagmill.operators.structures import structures
from tagmill.plans import registry


def test_first_told_is_chosen(spark):
    rows = spark.createDataFrame([(1, 0, "flag", "b", 0.9, 1), (1, 0, "flag", "a", 0.9, 2), (1, 0, "flag", "c", 0.8, 0), (1, 0, "part", "z", 0.9, 1), (1, 0, "part", "y", 0.9, 2)], "k int, instance int, field string, value string, p double, n int")
    values = lambda told: structures(rows, ["k"], {"flag": False}, 0.5, told).collect()[0]["values"]
    assert values(["n"]) == {"flag": ["b"], "part": ["y", "z"]}
    assert values(None) == {"flag": ["a"], "part": ["y", "z"]}


def test_equal_scores_take_the_tables_first(spark, tmp_path):
    """Both lines of an order have the same part and supplier, so their flags score the same."""
    rows = [(k, 3, 5, 1, flag) for k in range(40) for flag in "RN"]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    flags = {r.flag for r in registry()["structure_assembly"].run(spark, str(tmp_path)).collect()}
    assert flags <= {"R", ""} and "R" in flags


def test_best_label_in_shared_places(spark):
    draw = random.Random(2)
    spans = [(draw.choice([1, 2]), i, s := draw.choice([0, 3, 60, 70]), s + draw.choice([5, 90]), f"s{i}") for i in range(60)]
    sides = [(draw.choice([1, 2, 3, None]), n, s := draw.choice([0, 4, 66, 200]), s + draw.choice([2, 70])) for n in range(60)] + [(1, 99, None, 4)]
    out = best_label(spark.createDataFrame(sides, "k int, n int, start int, end int"), spark.createDataFrame(spans, "k int, i int, start int, end int, label string"), "k").collect()
    size = lambda a, b: min(a[3], b[3]) - max(a[2], b[2])
    for r in out:
        met = [s for s in spans if s[0] == r.k and r.start is not None and size(r, s) > 0]
        assert r.label == (max(met, key=lambda s: (size(r, s), -s[1]))[4] if met else None)
    assert sorted(map(repr, (r[:4] for r in map(tuple, out)))) == sorted(map(repr, sides))


def test_places_and_not_pairs_are_compared(spark):
    """200,000 probes and 200,000 spans of one place: 40 thousand million pairs, or one."""
    n = spark.range(200_000)
    sides, spans = n.selectExpr("1 as k", "id", "5 as start", "9 as end"), n.selectExpr("1 as k", "id as i", "6 as start", "20 as end", "'s' || id as label")
    assert best_label(sides, spans, "k").agg(F.count("*"), F.min("label"), F.max("label")).collect()[0] == (200_000, "s0", "s0")


def same_structures(spark, folder, rows: list[tuple]) -> bool:
    """Whether the query gives the rows of its SQL on ``rows`` of lineitem; one thread, so that the SQL's ties go by the table's order."""
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    item, con = registry()["structure_assembly"], duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
    ours = item.run(spark, str(folder))
    want = con.execute(f"select {', '.join(ours.columns)} from ({item.sql})").fetchall()
    return sorted(map(repr, map(tuple, ours.collect()))) == sorted(map(repr, want)) and bool(want)


def test_nulls_of_lines_go_as_in_the_sql(spark, tmp_path):
    """A line with a null key has no score, a null flag is taken where there is no other, and lines without number don't meet."""
    draw = random.Random(3)
    upto = lambda n: draw.choice([*range(1, n + 1), None])
    rows = [(upto(5), upto(8), upto(3), upto(7), draw.choice(["R", "N", "A", None])) for _ in range(400)]
    assert same_structures(spark, tmp_path, rows)


def test_every_line_number_and_supplier_is_told(spark, tmp_path):
    """An order of many lines: each line number is an instance of its own with its own flag and suppliers."""
    draw = random.Random(5)
    rows = [(k, draw.randrange(2000), draw.randrange(100), 1 + n % 7, draw.choice("RNA")) for k in range(30) for n in range(40)]
    assert same_structures(spark, tmp_path, rows)
    out = registry()["structure_assembly"].run(spark, str(tmp_path)).collect()
    assert {r.instance for r in out} == set(range(1, 8))
    suppliers = {(k, n): set() for k, _, _, n, _ in rows}
    for k, _, s, n, _ in rows:
        suppliers[k, n].add(str(s))
    said = {(r.l_orderkey, r.instance): r.suppliers.split(",") for r in out if r.suppliers}
    assert len(said) > 100 and all(len(set(s)) == len(s) and set(s) <= suppliers[at] for at, s in said.items())


def test_of_many_choices_all_are_taken_by_score(spark):
    rows = spark.createDataFrame([(1, "many", "b", 0.9, 1), (1, "many", "a", 0.9, 2), (1, "many", "c", 0.95, 3), (1, "many", "c", 0.7, 0), (1, "one", "y", 0.8, 2), (1, "one", "x", 0.8, 3), (1, "many", "d", 0.3, 4), (2, "one", "z", 0.4, 5)], "k int, field string, value string, p double, n int").withColumn("instance", F.lit(0))
    assert [r["values"] for r in structures(rows, ["k"], {"many": True, "one": False}, 0.5, ["n"]).collect()] == [{"many": ["c", "a", "b"], "one": ["y"]}]
