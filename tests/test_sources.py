"""Readers and writers."""

from __future__ import annotations

import json
import re

import pytest

from tagmill.sources.readers import normalise_shape, read_jsonl, read_jsonl_quarantine, read_weighted, surfaces_to_spans
from tagmill.sources.writers import markdown, report, write_files_of, write_splits


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "n": 2}\n\n{"id": "ü", "n": 3}\n', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"id": "x", "n": "no number"}\nnot json\n{"id": "y"}\n')
    a, b = (f"file://{tmp_path}/{n}.jsonl" for n in "ab")
    assert [tuple(r) for r in read_jsonl(spark, a, "id string, n int").collect()] == [("1", 2), ("ü", 3)]
    with pytest.raises(Exception, match="(?i)malformed"):
        read_jsonl(spark, [a, b], "id string, n int").collect()
    good, bad = read_jsonl_quarantine(spark, [a, b], "id string, n int")
    assert sorted((r.id, r.n) for r in good.collect()) == [("1", 2), ("y", None), ("ü", 3)]
    assert {r.line for r in bad.collect()} == {"not json", '{"id": "x", "n": "no number"}'}


def test_weighted(spark, tmp_path):
    (tmp_path / "n.csv").write_text("name,weight\nAy,2\nBo,0\nCe,\n")
    assert [tuple(r) for r in read_weighted(spark, f"file://{tmp_path}/n.csv").collect()] == [("Ay", 2.0)]


def test_shapes(spark):
    rows = spark.createDataFrame([("a", None, "s"), (None, "b", None)], "input string, text string, schema string")
    assert [tuple(r) for r in normalise_shape(rows).collect()] == [("a", "s"), ("b", None)]


def test_surfaces(spark):
    text = "Ali, Alice and Ali. a.b axb a.b (x) Éva Év Ali"
    docs = spark.createDataFrame([(1, text, [("p", "Ali"), ("q", "a.b"), ("r", "(x)"), ("s", "Év"), ("t", "none"), ("u", "")]), (2, None, [("p", "Ali")]), (3, "Ali", None)], "doc_id int, text string, mentions array<struct<label:string,surface:string>>")
    got = sorted(tuple(r) for r in surfaces_to_spans(docs).collect())
    want = sorted((1, m.start(), m.end(), label) for label, s in (("p", "Ali"), ("q", "a.b"), ("r", "(x)"), ("s", "Év")) for m in re.finditer(rf"(?<!\w){re.escape(s)}(?!\w)", text))
    assert got == want


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(i, "train" if i % 3 else "test", "é") for i in range(10)], "id int, split string, text string")
    write_splits(rows, f"file://{tmp_path}/s")
    assert spark.read.json(f"file://{tmp_path}/s/split=test").count() == 4
    write_files_of(rows, f"file://{tmp_path}/f", 2, "split", "id")
    for folder in (tmp_path / "f").glob("split=*/file=*"):
        lines = [json.loads(x) for p in folder.glob("*.json") for x in p.read_text(encoding="utf-8").splitlines()]
        assert len(lines) == 2 and lines[0]["id"] < lines[1]["id"] and lines[0]["text"] == "é"
    small = rows.filter("id < 2").orderBy("id")
    assert json.loads(report(small)) == [{"id": 0, "split": "test", "text": "é"}, {"id": 1, "split": "train", "text": "é"}]
    assert markdown(small, ["id", "split"]).splitlines() == ["| id | split |", "|---|---|", "| 0 | test |", "| 1 | train |"]
    with pytest.raises(ValueError):
        report(spark.range(20_000))
