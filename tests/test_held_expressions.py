"""Work inside a row is done once a row, and files are written where their rows are."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tagmill.functions.text import WORD, align_sentences, find_all, sentences, squeeze
from tagmill.operators.building import token_spans
from tagmill.plans import registry


def test_tokens_are_made_once_a_row(spark):
    """1,500 spans over 4,500 tokens: made anew for each span, the tokens alone took 3,000 passes of a pattern."""
    rows = spark.createDataFrame([("Abc def! " * 1500,)], "text string")
    spans = F.transform(find_all(F.col("text"), "[A-Z][a-z]+ [a-z]+"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("x").alias("label")))
    began = time.monotonic()
    out = rows.select(token_spans(spans, find_all(F.col("text"), WORD)).alias("s")).collect()[0].s
    assert [(s.first, s.last) for s in out] == [(3 * i, 3 * i + 1) for i in range(1500)]
    assert time.monotonic() - began < 60


def test_sentences_are_sought_in_what_is_left(spark):
    text = "One  two. 😀 Üç dört! " * 300 + "The end."
    rows = spark.createDataFrame([(text,), ("",), (None,)], "text string")
    said = F.transform(sentences(F.col("text")), lambda s: squeeze(s))
    out = [r.at for r in rows.select(align_sentences(F.col("text"), said).alias("at")).collect()]
    assert out[1:] == [[], []]
    at = [(r.start, r.end) for r in out[0]]
    assert all(b[0] >= a[1] for a, b in zip(at, at[1:], strict=False)) and at[-1] == (len(text) - 8, len(text))
    assert {"".join(text[a:b].split()) for a, b in at} == {"".join(s.split()) for s in (text[a:b] for a, b in at)}
    assert "".join("".join(text[a:b].split()) for a, b in at) == "".join(text.split())


def test_json_lines_are_written_without_a_shuffle(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("rows are dealt to few tasks")

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.repartition", refused)
    assert registry()["jsonl_round_trip"].run(spark, "/root/testdata/sf0.001").count() == 4


def test_a_sentence_of_many_words_is_found_apart(spark):
    """A pattern of 20,000 words in a row ended the stack, and with it the executor; words may hold the pattern's own quotes."""
    texts = ["Ab  " + "word " * 20_000 + "end. Next\n one.", r"Say \E and  \Q(x) a\Eb. Then a\Eb."]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    said = F.transform(sentences(F.col("text")), lambda s: squeeze(s))
    out = {r.i: [texts[r.i][x.start : x.end] for x in r.at] for r in rows.select("i", align_sentences(F.col("text"), said).alias("at")).collect()}
    assert out == {0: [texts[0][: -len(" Next\n one.")], "Next\n one."], 1: [r"Say \E and  \Q(x) a\Eb.", r"Then a\Eb."]}


def test_the_rest_of_a_text_is_not_copied_for_each_sentence(spark):
    """100,000 sentences: what was left of the text was copied for each; that took over 150 seconds."""
    text = "One two. " * 100_000
    rows = spark.createDataFrame([(text,)], "text string")
    began = time.monotonic()
    out = rows.select(align_sentences(F.col("text"), sentences(F.col("text"))).alias("at")).collect()[0].at
    assert [(r.start, r.end) for r in out] == [(9 * i, 9 * i + 8) for i in range(100_000)]
    assert time.monotonic() - began < 60
