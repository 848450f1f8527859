"""Literal cases and differential tests of the operators outside ``llm``."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tagmill.functions import text as t
from tagmill.functions import turkish as tr
from tagmill.functions import validators as v
from tagmill.operators import graph, matching, spans
from tagmill.operators.constraints import cardinality, violations

SPAN = "doc int, start int, end int, label string, confidence double"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("check", "value", "expected"),
    [
        (v.tckn, "10000000146", True), (v.tckn, "10000000147", False), (v.tckn, "01234567890", False), (v.tckn, None, False), (v.tckn, "", False),
        (v.iban_tr, "TR33 0006 1005 1978 6457 8413 26", True), (v.iban_tr, "TR33 0006 1005 1978 6457 8413 27", False), (v.iban_tr, "x", False), (v.iban_tr, None, False),
        (v.luhn, "4111 1111 1111 1111", True), (v.luhn, "4111 1111 1111 1112", False), (v.luhn, None, False),
        (v.ipv4, "1.2.3.255", True), (v.ipv4, "1.2.3.256", False), (v.ipv4, "1.2.3", False),
    ],
)
def test_validators(spark, check, value, expected):
    assert one(spark, check(F.lit(value).cast("string"))) is expected


def test_mrz(spark):
    assert one(spark, v.mrz_check_digit(F.lit("520727"))) == 3
    assert one(spark, v.mrz_check_digit(F.lit("D231458907"))) in range(10)


def test_text(spark):
    assert one(spark, t.tr_lower(F.lit("İIĞ"))) == "iığ"
    assert one(spark, t.squeeze(F.lit("  a \n\t b "))) == "a b"
    assert one(spark, t.sentences(F.lit("Ab c. De f? \n Gh. ij"))) == ["Ab c.", "De f?", "Gh. ij"]
    assert one(spark, t.words(F.lit("Yılmaz'ın a@b.co www.x.y well-known"))) == ["Yılmaz", "'", "ın", "a@b.co", "www.x.y", "well-known"]
    found = one(spark, t.find_all(F.lit("é12 34é 5"), "[0-9]+"))
    assert [(x.start, x.end, x.text) for x in found] == [(1, 3, "12"), (4, 6, "34"), (8, 9, "5")]
    assert one(spark, t.find_all(F.lit(None).cast("string"), "[0-9]+")) == []
    start, text = t.trim_span(F.lit(5), F.lit(" (Ahmet), "))
    assert (one(spark, start), one(spark, text)) == (7, "Ahmet")
    assert [one(spark, t.junk_reason(F.lit(x))) for x in ("...", " ", "", "ab", "12345", "ab c", "a,b,c,d", "- -", "(a b c d)", "Ahmet Yılmaz")] == ["punctuation", "punctuation", "punctuation", "short", "short", None, "noisy", "punctuation", "noisy", None]
    many = " ".join(f"é{i}" for i in range(300))
    assert [(x.start, x.end, x.text) for x in one(spark, t.find_all(F.lit(many), "[0-9]+"))] == [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", many)]


def rows(spark, items):
    return spark.createDataFrame(items, SPAN)


def got(frame):
    return sorted((r.doc, r.start, r.end, r.label) for r in frame.collect())


def test_policies(spark):
    s = rows(spark, [(1, 0, 5, "a", 0.9), (1, 0, 13, "b", 0.8), (1, 4, 8, "c", 0.7), (1, 13, 15, "d", 0.1), (1, 13, 15, "e", 0.2), (2, 0, 1, "z", 0.5)])
    assert got(spans.greedy(s, ["doc"])) == [(1, 0, 5, "a"), (1, 13, 15, "e"), (2, 0, 1, "z")]
    assert got(spans.longest_first(s, ["doc"])) == [(1, 0, 13, "b"), (1, 13, 15, "d"), (2, 0, 1, "z")]
    assert got(spans.outermost(s, ["doc"])) == [(1, 0, 13, "b"), (1, 13, 15, "e"), (2, 0, 1, "z")]
    assert got(spans.nested(s, ["doc"])) == [(1, 0, 5, "a"), (1, 0, 13, "b"), (1, 13, 15, "e"), (2, 0, 1, "z")]
    assert spans.greedy(rows(spark, []), ["doc"]).count() == 0


def test_best_total_against_all_subsets(spark):
    rng = random.Random(3)
    items = [(d, a, a + rng.randint(1, 6), "l", rng.randint(1, 9) / 10) for d in range(40) for a in rng.sample(range(12), 6)]
    kept = {}
    for r in spans.best_total(rows(spark, items), ["doc"]).collect():
        kept.setdefault(r.doc, []).append(r)
    for doc in range(40):
        own = [i for i in items if i[0] == doc]
        best = max(sum(i[4] for i in c) for k in range(len(own) + 1) for c in itertools.combinations(own, k) if all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(c, 2)))
        mine = kept.get(doc, [])
        assert all(x.end <= y.start or y.end <= x.start for x, y in itertools.combinations(mine, 2))
        assert sum(r.confidence for r in mine) == pytest.approx(best)


def test_bio_round_trip(spark):
    tokens = spark.createDataFrame([(1, i, 3 * i, 3 * i + 2) for i in range(8)], "doc int, pos int, start int, end int")
    s = spark.createDataFrame([(1, 0, 5, "p"), (1, 6, 8, "p"), (1, 15, 20, "q")], "doc int, start int, end int, label string")
    tagged = spans.bio_encode(tokens, s, ["doc"])
    assert [r.tag for r in tagged.orderBy("pos").collect()] == ["B-p", "I-p", "B-p", "O", "O", "B-q", "I-q", "O"]
    assert got(spans.bio_decode(tagged, ["doc"])) == [(1, 0, 5, "p"), (1, 6, 8, "p"), (1, 15, 20, "q")]
    orphan = spark.createDataFrame([(1, 0, 0, 1, "I-x"), (1, 1, 2, 3, "I-x"), (1, 2, 4, 5, "I-y")], "doc int, pos int, start int, end int, tag string")
    assert got(spans.bio_decode(orphan, ["doc"])) == [(1, 0, 3, "x"), (1, 4, 5, "y")]


def test_chunk_windows(spark):
    docs = spark.createDataFrame([(n, n) for n in range(40)], "doc int, words int")
    for size, overlap in ((8, 3), (5, 0)):
        found = {}
        for r in spans.chunk_windows(docs, "words", size, overlap).collect():
            found.setdefault(r.doc, []).append((r.start_word, r.end_word))
        for n in range(40):
            want, at = [], 0
            while True:
                want.append((at, min(at + size, n)))
                if at + size >= n:
                    break
                at += size - overlap
            assert sorted(found[n]) == want
    with pytest.raises(ValueError):
        spans.chunk_windows(docs, "words", 4, 4)


def test_surface_scores(spark):
    cols = "doc int, label string, surface string"
    g = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "a", "x")], cols)
    p = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "c", "z")], cols)
    counts = {r.label: (r.tp, r.fp, r.fn, r.support) for r in matching.surface_counts(g, p, ["doc"]).collect()}
    assert counts == {"a": (1, 0, 0, 1), "b": (0, 0, 1, 1), "c": (0, 1, 0, 0)}
    m = matching.micro_macro(matching.surface_counts(g, p, ["doc"])).first()
    assert (m.micro_precision, m.micro_recall, m.macro_f1, m.n_labels) == (0.5, 0.5, 0.5, 2)
    empty = matching.micro_macro(matching.surface_counts(g.limit(0), p.limit(0), ["doc"])).first()
    assert (empty.micro_f1, empty.macro_f1, empty.n_labels) == (0.0, 0.0, 0)


def test_offset_statuses(spark):
    cols = "doc int, start int, end int, label string"
    g = spark.createDataFrame([(1, 0, 5, "a"), (1, 10, 15, "a"), (1, 20, 30, "a"), (1, 40, 45, "a")], cols)
    p = spark.createDataFrame([(1, 0, 5, "a"), (1, 10, 15, "b"), (1, 22, 33, "a"), (1, 28, 40, "a"), (1, 60, 61, "a")], cols)
    found = sorted((r.status, r.same_label) for r in matching.offset_statuses(g, p, "doc").collect())
    assert found == [("boundary_mismatch", True), ("fn", False), ("fp", False), ("fp", False), ("label_mismatch", False), ("match", True)]


def test_constraints(spark):
    yes, no, unknown = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert one(spark, cardinality([yes, unknown], 1, 1)) is None
    assert one(spark, cardinality([yes, yes, unknown], 0, 1)) is False
    assert one(spark, cardinality([yes, no], 1, 1)) is True
    assert one(spark, violations({"a": yes, "b": no, "c": unknown})) == ["b"]


def test_graph(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31), (32, 31), (40, 40)], "a long, b long")
    comp = {r.id: r.component for r in graph.components(edges).collect()}
    assert {comp[i] for i in range(1, 21)} == {1} and comp[32] == 30 and comp[40] == 40
    assert sorted(r.id for r in graph.reachable(edges, spark.createDataFrame([(18,)], "id long")).collect()) == [18, 19, 20]
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 1)], "a long, b long")
    assert sorted(r.id for r in graph.cyclic_nodes(ring).collect()) == [1, 2, 3]
    assert graph.cyclic_nodes(edges.filter("a < 40")).count() == 0
    rings = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 6), (6, 5), (7, 7), (9, 1), (None, 1), (1, None)], "a long, b long")
    assert sorted(r.id for r in graph.cyclic_nodes(rings).collect()) == [1, 2, 5, 6, 7]
    near = {r.id: (r.outgoing, r.incoming, r.neighbours) for r in graph.neighbourhoods(rings).collect()}
    assert near[1] == (2, 3, 2) and near[7] == (1, 1, 0)
    pairs = spark.createDataFrame([(1, 2, "child"), (2, 1, "parent"), (3, 4, "child"), (5, 6, "parent"), (1, 9, "other")], "a long, b long, relation string")
    assert sorted(tuple(r) for r in graph.broken_inverse(pairs, "child", "parent").collect()) == [(3, 4, "child"), (5, 6, "parent")]
    assert sorted((r.a, r.b) for r in graph.broken_symmetry(spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "a long, b long")).collect()) == [(1, 3)]


@pytest.mark.parametrize(
    ("word", "suffix", "right"),
    [
        ("Yılmaz", "in", "ın"), ("Zeynep", "de", "te"), ("Ali", "nin", "nin"), ("Ankara", "dan", "dan"), ("İzmir", "dan", "den"), ("2005", "de", "te"), ("1990", "dan", "dan"), ("40", "de", "ta"), ("100", "de", "de"), ("3000", "da", "de"),
        ("TL", "dır", "dir"), ("TCKN", "ya", "ye"), ("Boğaz", "daki", "daki"), ("Köy", "daki", "deki"), ("Gül", "in", "ün"), ("Burak", "dir", "tır"), ("Ali", "xyz", "xyz"), ("..", "de", "de"), ("Onur", "ndan", "ndan"), ("Ayşe", "yla", "yle"), ("Ufuk", "lar", "lar"), ("Gül Hanım.", "in", "ın"),
    ],
)
def test_suffix_harmony(spark, word, suffix, right):
    assert one(spark, tr.harmonious(F.lit(suffix), tr.spoken_end(F.lit(word)))) == right


def test_suffixes_are_fixed_in_place(spark):
    text = "é Yılmaz'in ve Zeynep’de, Ali'xyz 2005'de."
    spans_ = [(1, m.start(), m.end()) for m in re.finditer("Yılmaz|Zeynep|Ali|2005", text)]
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "doc int, text string")
    out = {r.doc: (r.text, r.fixes) for r in tr.fix_suffixes(docs, spark.createDataFrame(spans_, "doc int, start int, end int"), "doc").collect()}
    assert out == {1: ("é Yılmaz'ın ve Zeynep’te, Ali'xyz 2005'te.", 3), 2: ("nothing", 0), 3: (None, 0)}


def test_sentences_are_found_again(spark):
    text = "Ab  c. De\n f? Xy c. (x) Gh"
    got = one(spark, t.align_sentences(F.lit(text), F.array(F.lit("Ab c."), F.lit(" "), F.lit("De f?"), F.lit("Xy c."), F.lit("(x) Gh"))))
    assert [text[x.start : x.end] for x in got] == ["Ab  c.", "De\n f?", "Xy c.", "(x) Gh"]
    assert one(spark, t.align_sentences(F.lit(None).cast("string"), F.array().cast("array<string>"))) == []
    with pytest.raises(Exception, match="not found"):
        one(spark, t.align_sentences(F.lit(text), F.array(F.lit("absent"))))
