"""Every registered query with SQL gives DuckDB's rows on tables with all cases, under two partitionings."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tagmill.plans import registry

DATA = Path("/root/testdata/sf0.01")
ITEMS = registry()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return ""
        return f"{v:.8f}" if isinstance(v, float) else str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n, i in ITEMS.items() if i.sql])
def test_same_rows_as_duckdb(spark, duck, name):
    ours, theirs = ITEMS[name].run(spark, str(DATA)).toPandas(), duck.execute(ITEMS[name].sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


def test_result_does_not_depend_on_partitions(spark):
    names = ["pii_mentions_by_lang", "stratified_split", "conflict_drop", "length_grouped_batches", "coref_components"]
    before = {n: normal(ITEMS[n].run(spark, str(DATA)).toPandas()) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert before == {n: normal(ITEMS[n].run(spark, str(DATA)).toPandas()) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
