"""What larger tables cost: rows of one document, turn or order meet once, in as few shuffles and written tables as the work needs."""

from __future__ import annotations

import hashlib

import duckdb
from pyspark.sql import functions as F

from tagmill.operators import bundles, events
from tagmill.operators.tokens import detokenise, detokenise_rows
from tagmill.plans import records, registry
from tagmill.sources.writers import write_files_of
from tagmill.written import cut

DATA = "/root/testdata/sf0.001"


def exchanges(frame) -> int:
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_events_take_one_shuffle(spark):
    assert exchanges(registry()["event_structures"].run(spark, DATA)) == 1
    fields = [events.Field("part", 1, 1), events.Field("flag", 0, 2, exclusive=False)]
    rows = spark.sql("select 1 as k, array('a', 'b', 'a') as anchors, array(named_struct('anchor', 'b', 'field', 'part', 'mention', 'm', 'score', 0.5d), named_struct('anchor', 'a', 'field', 'part', 'mention', 'm', 'score', 0.5d), named_struct('anchor', 'b', 'field', 'flag', 'mention', 'm', 'score', 0.2d), named_struct('anchor', 'b', 'field', 'flag', 'mention', 'm', 'score', 0.4d)) as offers union all select 2, array('c'), null union all select 3, null, array()")
    got = {(r.k, r.anchor): (r.fields, r.missing) for r in events.bind_rows(rows, ["k"], fields).collect()}
    assert got == {(1, "a"): ({"part": [("m", 0.5)]}, []), (1, "b"): ({"flag": [("m", 0.4)]}, ["part"]), (2, "c"): (None, ["part"])}


def test_numbered_files_are_written_by_several_tasks(spark, tmp_path):
    write_files_of(spark.range(400).selectExpr("id", "id % 2 as half"), f"file://{tmp_path}/f", 10, "half", "id")
    files = [p for folder in (tmp_path / "f").glob("half=*/file=*") for p in folder.glob("*.json")]
    assert len(files) == 40 and len({p.name.split("-")[1] for p in files}) > 1
    assert all(len(p.read_text().splitlines()) == 10 for p in files)


def test_tokens_are_joined_without_windows(spark):
    assert "Window" not in registry()["detokenise"].run(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    texts = {1: '" a . b " . . . . c', 2: ". .", 3: "", 4: 'x " 1 . 2', 5: "…"}
    rows = spark.createDataFrame([(k, [(i + 10, t) for i, t in enumerate(x.split())]) for k, x in texts.items()] + [(6, None)], "k int, tokens array<struct<pos:int,token:string>>")
    for dots, want in ((True, {1: '"a. b" ... c', 2: "..", 4: 'x "1.2', 5: "…"}), (False, {1: '"a. b".... c', 2: "..", 4: 'x "1.2', 5: "…"})):
        out = detokenise_rows(rows, "k", dots).orderBy("k", "pos").collect()
        said: dict = {}
        for r in out:
            said[r.k] = said.get(r.k, "") + r.sep + r.token
            assert len(said[r.k]) == r.end and said[r.k][r.start :] == r.token
        assert said == want
    odd = detokenise(spark.createDataFrame([("d", 1, None, "x"), ("d", 2, "a", "y"), (None, 1, ",", "z")], "doc string, pos int, token string, note string"), "doc").collect()
    assert sorted((str(r.doc), r.pos, r.token, r.note, r.start, r.end) for r in odd if r.token) == [("None", 1, ",", "z", 0, 1), ("d", 2, "a", "y", 1, 2)]
    assert [(r.start, r.end, r.note) for r in odd if r.token is None] == [(None, 0, "x")]


def same_on(spark, folder, name: str, documents: list[tuple]) -> bool:
    """Whether the query gives DuckDB's rows on ``documents`` (doc_id, lang, text)."""
    spark.createDataFrame(documents, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"file://{folder}/documents.parquet")
    item, con = registry()[name], duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    ours = item.run(spark, f"file://{folder}")
    rows = lambda found: sorted(map(repr, found))
    want = con.execute(f"select {', '.join(ours.columns)} from ({item.sql})").fetchall()
    return rows(tuple(r) for r in ours.collect()) == rows(want) and bool(want)


def test_words_of_a_document_are_counted_before_they_are_moved(spark, tmp_path):
    plan = registry()["conservation_check"].run(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange ") > plan.rindex("Generate ")
    docs = [(1, "tr", "Ev ev EVLER evler ... a,b,c,d x"), (1, "tr", "evler Kapılar"), (1, "en", "evler"), (2, "tr", ""), (3, "tr", None), (None, "tr", "Çiçekler çiçekler"), (4, None, "words Words"), (5, "de", None)]
    assert same_on(spark, tmp_path, "conservation_check", docs)


def shuffled(spark) -> int:
    """Bytes that the session's stages have put into shuffles so far."""
    none = spark._jvm.java.util.ArrayList()
    stages = spark._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_of_documents_of_one_row_stay_where_they_are_read(spark):
    began = shuffled(spark)
    assert registry()["conservation_check"].run(spark, DATA).count() == 4
    assert 0 < shuffled(spark) - began < 60_000  # the texts are 290,000 bytes of Parquet


def test_words_of_a_large_document_need_not_meet_in_one_row(spark, tmp_path, monkeypatch):
    docs = [(k, lang, text) for k in (1, 2, None) for lang in ("tr", "en", None) for text in ("Ev ev EVLER evler ... a,b,c,d x", "Ölçü ölçü evler\u00a0Kapılar", " \n", None, "..." * 5, "Zeytin ZEYTIN zeytin")]
    docs += [(3, "tr", "evler EVLER"), (3, "de", "  "), (3, "de", "Haus haus"), (4, "fr", " "), (5, "en", "House houses"), (5, "en", "HOUSES house")]
    for most in (0, 64, 1 << 24):  # by words, some by words, in one row
        monkeypatch.setattr(records, "_TOGETHER", most)
        assert same_on(spark, tmp_path / str(most), "conservation_check", docs)


def test_cached_values_are_written_once_and_meet_the_known_in_one_shuffle(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(bundles, "cut", lambda frame, label="table": written.append(label) or cut(frame, label))
    rows = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None), (5, "")], "id int, s string")
    path = f"file://{tmp_path}/cache"
    assert [bundles.cached_each(f, "s", lambda c: F.length(c), "n", path)[1] for f in (rows.filter("id = 1"), rows, rows)] == [1, 2, 0] and not written
    stored = spark.read.parquet(path).orderBy("value").collect()
    assert [(r.key, r.value, r.result) for r in stored] == [(hashlib.sha256(v.encode()).hexdigest(), v, len(v)) for v in ("", "aa", "b")]


def test_texts_are_read_once_beside_their_hints(spark, tmp_path):
    plan = registry()["ngram_copy_guard"].run(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 1
    long = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, "a", long), (2, "a", f"... {long.upper()}, four five SIX seven"), (3, "a", "x y z"), (4, "a", None), (5, "a", "b c d e f g h i j k l m n o p q r"), (6, "a", "-b c d e f g h i j k l m"), (7, "a", ""), (8, "a", "a b c d e f")]
    assert same_on(spark, tmp_path, "ngram_copy_guard", docs)
