"""Token, record and relation operators and the mention stream."""

from __future__ import annotations

import random

import pytest

from tagmill.operators.recognise import mentions
from tagmill.operators.relations import match_records
from tagmill.operators.tokens import detokenise, pack_sentences
from tagmill.streaming import mention_stream


@pytest.mark.parametrize(
    ("tokens", "text"),
    [
        ("Ali , geldi .", "Ali, geldi."), ("( a ) [ b ]", "(a) [b]"), ('dedi " evet " ve', 'dedi "evet" ve'), ("Ankara ' da", "Ankara'da"), ("3 . 14 12 : 30", "3.14 12:30"),
        ("ve / veya", "ve/veya"), ("% 20", "%20"), ("T . C . no", "T.C. no"), ("tek", "tek"),
    ],
)
def test_detokenise(spark, tokens, text):
    rows = detokenise(spark.createDataFrame([(1, i, t) for i, t in enumerate(tokens.split())], "doc int, pos int, token string"), "doc").orderBy("pos").collect()
    assert "".join(r.sep + r.token for r in rows) == text
    assert all(text[r.start : r.end] == r.token for r in rows)


def test_pack_sentences(spark):
    rng = random.Random(1)
    docs = {d: [rng.randint(1, 12) for _ in range(rng.randint(1, 15))] for d in range(30)}
    frame = spark.createDataFrame([(d, i, n) for d, own in docs.items() for i, n in enumerate(own)], "doc int, pos int, size int")
    found = {(r.doc, r.pos): r.piece for r in pack_sentences(frame, "doc", 10).collect()}
    for d, own in docs.items():
        piece, held = -1, 0
        for i, n in enumerate(own):
            piece, held = (piece, held + n) if piece >= 0 and held + n <= 10 else (piece + 1, n)
            assert found[d, i] == piece
    assert pack_sentences(frame.limit(0), "doc", 10).count() == 0


def test_relations_take_turns(spark):
    gold = spark.createDataFrame([(1, "r", 0, ["A  b", "x"], ["c"]), (1, "r", 1, ["a b"], ["c", "d"]), (1, "s", 0, ["q"], ["w"]), (2, "r", 0, ["m"], ["n"])], "record int, relation string, i int, heads array<string>, tails array<string>")
    pred = spark.createDataFrame([(1, "r", 0, "a b", "C"), (1, "r", 1, "A B", "c "), (1, "r", 2, "a b", "d"), (2, "r", 0, "n", "m"), (3, "r", 0, "z", "z")], "record int, relation string, i int, head string, tail string")
    scores = lambda swapped: {(r.record, r.relation): (r.tp, r.fp, r.fn) for r in match_records(gold, pred, swapped).collect()}
    assert scores(False) == {(1, "r"): (2, 1, 0), (1, "s"): (0, 0, 1), (2, "r"): (0, 1, 1), (3, "r"): (0, 1, 0)}
    assert scores(True)[2, "r"] == (1, 0, 0)


def test_mention_stream(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    source, sink, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    parts = docs.randomSplit([0.5, 0.5], 1)
    for part in parts:
        part.write.mode("append").parquet(source)
        mention_stream(spark, source, "doc_id long, text string", sink, state).awaitTermination()
    mention_stream(spark, source, "doc_id long, text string", sink, state).awaitTermination()  # nothing new: nothing written
    got = spark.read.parquet(f"{sink}/*").select("doc_id", "start", "label").collect()
    want = mentions(docs).select("doc_id", "start", "label").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
