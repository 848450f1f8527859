"""Evaluation variants and typed tables: odd names, nulls and round trips."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tagmill.operators.variants import name_problems, variants
from tagmill.sources import readers, writers
from tagmill.written import new_folder

NAMES = [("training", "a", "a"), ("training", "a", "alpha"), ("training", "a", "first"), ("training", "b", "b"), ("u1", "a", "eins"), ("u1", "b", "zwei"), ("u2", "a", "un"), ("u2", "b", "deux"), ("u2", "b", None)]
SCHEMA = "pool string, label string, name string"


def test_good_pools_have_no_problems(spark):
    assert name_problems(spark.createDataFrame(NAMES, SCHEMA)).count() == 0
    bad = [*NAMES[:-2], ("u1", "a", "ALPHA"), ("u2", "a", "Zwei"), ("u1", "b", "eins")]
    found = {(r.problem, r.name) for r in name_problems(spark.createDataFrame(bad, SCHEMA)).collect()}
    assert found == {("in training", "alpha"), ("in two pools", "zwei"), ("twice in a pool", "eins"), ("label without a held-out name", "b")}
    assert name_problems(spark.createDataFrame([], SCHEMA)).count() == 0


def test_variants_are_drawn_and_stay_apart(spark):
    records = spark.range(400).select("id", F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("label")).unionByName(spark.createDataFrame([(1, None), (2, "a"), (2, "a"), (5, "unknown")], "id long, label string"))
    out = variants(records, spark.createDataFrame(NAMES, SCHEMA), "id", canonical=0.3).collect()
    assert len(out) == len({(r.id, r.variant, r.label) for r in out})
    by = lambda v, label: [r.name for r in out if r.variant == v and r.label == label]
    assert set(by("u1", "a")) == {"eins"} and set(by("u2", "b")) == {"deux"} and set(by("training", "b")) == {"b"} and by("training", "unknown") == ["unknown"] and by("u1", "unknown") == []
    drawn = by("training", "a")
    assert set(drawn) == {"a", "alpha", "first"} and 0.2 < drawn.count("a") / len(drawn) < 0.4
    again = variants(records.repartition(5), spark.createDataFrame(NAMES, SCHEMA), "id", canonical=0.3)
    assert sorted(again.collect()) == sorted(out)


def test_nested_columns_travel_as_text(spark):
    rows = spark.createDataFrame([(1, [(1, "x")], {"a": 1}), (2, None, None), (3, [], {})], "id int, spans array<struct<at:int,label:string>>, counts map<string,int>")
    path = new_folder(spark, "typed")
    writers.write_typed(rows, path)
    assert dict(spark.read.parquet(path).dtypes) == {"id": "int", "spans": "string", "counts": "string"}
    back = readers.read_typed(spark, path, {"spans": "array<struct<at:int,label:string>>", "counts": "map<string,int>"})
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(Exception, match="(?i)malformed|failfast|cannot parse|bad_record"):
        readers.read_typed(spark, path, {"spans": "int", "counts": "map<string,int>"}).collect()


def test_why_values_are_refused(spark):
    from tagmill.functions.kinds import FORMS, by_words, refusal

    cases = [
        ("nickname", "Deli Ali", None), ("nickname", "a", "format"), ("nickname", "bir iki üç dört", "format"), ("salary_info", "45.000", None), ("salary_info", "maaş", "format"), ("workplace_location", "Levent No: 3", "format"),
        ("medical_condition", "RAHATSIZLIK", None), ("medical_condition", "rahatsızlık", "format"), ("medication", "1 hap", "format"), ("job_title", "baş-mühendis / şef", None), ("job_title", "Personel", "format"), ("work_history", "on yıl boyunca depo", None),
        ("company_name", "Ak Market", None), ("company_name", "ak market", "format"), ("company_name", "Öz ve Ak", None), ("company_name", "Tek", "format"), ("tax_office_name", "Şişli Vergi Dairesi", None), ("union", "Eğitim SENDİKA", "format"), ("union", "öz-iş", None),
        ("union", "bir sendikası", None), ("medication", "Şirket Adı", "placeholder"), ("medication", "xxxx", "placeholder"), ("medication", "[ilaç]", "placeholder"), ("medication", "77", "digits only"), ("medication", "", "length"), ("medication", None, "length"), ("medication", "m" * 161, "length"),
        ("medication", "Parol", "known value"), ("medication", "paro", "known value"), ("medication", "par", None), (None, "x", "unknown kind"), ("ghost", "x", "unknown kind"),
    ]
    table = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(cases)], "i int, kind string, value string").withColumn("known", F.array(F.lit("PAROL"), F.lit(None).cast("string")))
    kinds = FORMS | {"union": by_words(("Sendika", "-iş"))}
    found = {r.i: r.why for r in table.select("i", refusal(F.col("value"), F.col("kind"), F.col("known"), kinds, ("union",)).alias("why")).collect()}
    assert [found[i] for i in range(len(cases))] == [w for _, _, w in cases]
    nothing = table.select(refusal(F.col("value"), F.col("kind"), F.lit(None).cast("array<string>"), kinds).alias("why")).filter("why = 'known value'")
    assert nothing.count() == 0
