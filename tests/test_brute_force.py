"""Operators outside ``llm`` held against plain loops on random and odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagmill.operators import chunks, corpus, decoding, guards, spans, targets
from tagmill.operators.building import build_records
from tagmill.operators.ranking import ranked
from tagmill.operators.structures import policy
from tagmill.plans import registry
from tagmill.written import shared_root


def test_ranked_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]) if i % 4 else "hot", rng.randint(0, 40), i) for i in range(3000)]
    found = ranked(spark.createDataFrame(rows, "g string, v int, i int").repartition(7), ["g"], ["v", "i"]).collect()
    assert len(found) == len(rows)
    for group in ("a", "b", "hot", None):
        want = {i: k for k, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == group), key=lambda r: (r[1], r[2])), 1)}
        assert {r.i: r["rank"] for r in found if r.g == group} == want
    assert ranked(spark.createDataFrame([], "g string, v int"), ["g"], ["v"]).count() == 0


def test_null_keys_lose_no_row(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "s", None if i % 2 else "l", i % 5) for i in range(60)], "doc_id long, source string, lang string, n int")
    assert corpus.group_split(rows, "source", "lang", 0.3).count() == 60
    assert corpus.stratified_split(rows, "source", "doc_id", {"test": 0.2}).count() == 60
    collapsed = corpus.catalogue_collapse(rows, ["source", "lang"], ["doc_id"], ["n"], "doc_id")
    assert collapsed.count() == 4
    tags = spark.createDataFrame([(1, None, None), (2, None, "x"), (3, "k", None), (4, "k", None), (None, "m", "y")], "doc_id long, k string, tag string")
    assert sorted((r.doc_id or 0) for r in corpus.conflict_drop(tags, F.col("k"), F.col("tag"), "doc_id").collect()) == [0, 3]


def test_token_boundaries(spark):
    rng = random.Random(2)
    tokens, spans_, want = [], [], {}
    for doc in range(30):
        at, own = rng.randint(0, 2), []
        for pos in range(rng.randint(0, 9)):
            size = rng.randint(1, 4)
            own.append((at, at + size))
            tokens.append((doc, pos, at, at + size))
            at += size + rng.randint(0, 3)
        for i in range(8):
            a = rng.randint(0, 25)
            b = a + rng.randint(-1, 8)
            hit = [k for k, (s, e) in enumerate(own) if s < b and a < e and a < b]
            spans_.append((doc, a, b, i))
            want[doc, i] = (min(hit), max(hit) + 1) if hit else (None, None)
    t = spark.createDataFrame(tokens, "doc int, pos int, start int, end int")
    found = targets.char_to_token(spark.createDataFrame(spans_, "doc int, start int, end int, i int"), t, ["doc"])
    assert {(r.doc, r.i): (r.token_start, r.token_end) for r in found.collect()} == want
    back = {(r.doc, r.i): (r.start, r.end) for r in targets.token_to_char(found.select("doc", "i", "token_start", "token_end"), t, ["doc"]).collect()}
    place = {(d, p): (s, e) for d, p, s, e in tokens}
    assert back == {k: (place[k[0], a][0], place[k[0], b - 1][1]) for k, (a, b) in want.items() if a is not None}


def test_policies_that_fail_the_job(spark):
    m = spark.createDataFrame([(1, 0, 3), (1, 4, 9), (2, 0, 2)], "doc int, token_start int, token_end int")
    assert targets.truncate(m, ["doc"], 5, "drop_target").count() == 2 and targets.truncate(m, ["doc"], 5, "drop_example").count() == 1
    with pytest.raises(Exception, match="crosses the cut"):
        targets.truncate(m, ["doc"], 5, "error").collect()
    with pytest.raises(Exception, match="ambiguous"):
        spark.range(1).select(targets.by_policy(F.array(F.lit(1), F.lit(2)), "error_on_ambiguous")).collect()
    with pytest.raises(ValueError, match="unknown overlap policy"):
        policy("sideways")
    assert policy("DISALLOW") is spans.best_total and policy("none") is spans.best_total
    many = spark.createDataFrame([(1, f"l{i}", 0.1) for i in range(13)], "doc int, label string, utility double")
    with pytest.raises(Exception, match="too many candidates"):
        decoding.assignments(many, ["doc"]).collect()


def test_priority_merge(spark):
    rng = random.Random(3)
    cols = "doc int, start int, end int, label string"
    first, second = ([(d, a, a + rng.randint(1, 5), f"{n}{a}") for d in range(20) for a in rng.sample(range(20), 4)] for n in "ps")
    want = set()
    for d in range(20):
        kept = [s for s in first if s[0] == d]
        for s in sorted((s for s in second if s[0] == d), key=lambda s: s[1:]):
            if all(s[2] <= k[1] or k[2] <= s[1] for k in kept):
                kept.append(s)
        want |= set(kept)
    got = spans.priority_merge(spark.createDataFrame(first, cols), spark.createDataFrame(second, cols), ["doc"])
    assert {tuple(r) for r in got.collect()} == want


def test_guards_against_a_scan(spark):
    """Every guard's first open match by a loop over Python's matches; all nine find something."""
    texts = [
        "call 0532 111 22 33 now", "14.05.2025 09:30 and 1.148.600.000", "plate 34 ABC 123 [x]", "TR33 0006 1005 1978 6457 8413 26", "255.255.255.0 or 1234567890123", "nothing", None, "05321112233 05321112234",
        "x" * 5000 + " 12345678901", "a 06 AB 99 b", "Gül Sokak No 7 ve Lale Cad. 3 No: 9", "Demir Ltd. ve Öz Gıda A.Ş.", "Yaş: 40; Din : yok", "SIMÜLASYON ve Coreference", "kisisinin kisisi kisisix", "the e_mail is e_mails", "",
        "2025-02-14 16:00 ve 2025-02-14 16 12345678901",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    covered = [(0, 5, 19), (2, 6, 16), (0, 0, 3), (10, 0, 14), (12, 5, 7), (11, 0, 12), (2, 6, 7)]
    known = [(3, "TR33 0006 1005 1978 6457 8413 26"), (7, "0532 111 22 33"), (5, None), (11, "Demir Ltd.")]
    used = (*guards.GUARDS, guards.label_guard(["e_mail", "phone"]))
    found = {(r.doc, r.problem): (r.surface, r.start) for r in guards.guard_problems(docs, spark.createDataFrame(covered, "doc int, start int, end int"), spark.createDataFrame(known, "doc int, value string"), "doc", used).collect()}
    want = {}
    num = lambda s: re.sub("[^0-9]", "", s)
    word = lambda c: bool(re.match(r"\w", c)) if c else False
    for doc, text in enumerate(texts):
        values = [v for d, v in known if d == doc and v]
        for g in used:
            read = (text or "").lower() if g.folded else text or ""
            for m in re.finditer(g.pattern.replace(r"\p{L}", "a-zA-ZçğıöşüÇĞİÖŞÜ"), read):
                s, (a, e) = m.group(), m.span()
                at = a + len(re.match(r"[^:]*:[ \t]*", s).group()) if g.closed_by == "value" else a
                skip = (g.spared and re.match(g.spared, s)) or (g.edges and (word(read[a - 1 : a]) or word(read[e : e + 1])))
                closed = g.closed_by and any(d == doc and x <= at and (y > at if g.closed_by == "value" else e <= y) for d, x, y in covered)
                explained = any(num(s) in num(v) or (num(v) and num(v) in num(s)) for v in values if num(v)) if g.explained_by == "digits" else any(s.strip() in v for v in values) if g.explained_by == "text" else False
                if not (skip or closed or explained):
                    want[doc, g.problem] = (s, a)
                    break
    assert found == want and {p for _, p in want} == {g.problem for g in used}
    zero = {r.doc: r.problems for r in guards.zero_problems(docs, spark.createDataFrame(covered, "doc int, start int, end int"), "doc").collect()}
    assert zero[0] == ["tagged span", "unlisted number"] and zero[3] == ["unlisted identifier", "unlisted number"] and 5 not in zero and 6 not in zero


def test_pilot_selection_one_by_one(spark):
    """The query's choice equals choosing label by label in a loop."""
    from hashlib import md5

    from tagmill.plans.derived import gold

    d = "/root/testdata/sf0.01"
    pairs = {(r.doc_id, r.label) for r in gold(spark, d).select("doc_id", "label").collect()}
    freq, chosen = Counter(label for _, label in pairs), {}
    for label in sorted(freq, key=lambda x: (freq[x], x)):
        own = [i for i, x in pairs if x == label]
        have = sum(i in chosen for i in own)
        for i in sorted((i for i in own if i not in chosen), key=lambda i: (md5(f"42|{i}".encode()).hexdigest(), i))[: max(0, 10 - have)]:
            chosen[i] = label
    assert {r.doc_id: r.taken_for for r in registry()["pilot_selection"].run(spark, d).collect()} == chosen


def test_merges_of_no_rows_and_nulls(spark):
    none = spark.createDataFrame([], "doc int, chunk int, choice string, confidence double")
    assert chunks.merge_choices(none, ["doc"]).count() == 0
    some = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", 0.0), (1, 2, None, 0.9), (None, 0, "c", 0.2)], "doc int, chunk int, choice string, confidence double")
    assert sorted((r.doc or 0, r.choice, r.confidence) for r in chunks.merge_choices(some, ["doc"]).collect()) == [(0, "c", 0.2), (1, "a", 0.0)]
    docs = spark.createDataFrame([(1, None), (2, "")], "doc int, text string")
    ents = spark.createDataFrame([], "doc int, id string, label string, start int, end int, span string")
    rels = spark.createDataFrame([(1, 0, "r", "x", "y")], "doc int, i int, relation string, head string, tail string")
    built = build_records(docs, ents, rels, "doc", spark.createDataFrame([("r",), ("q",)], "relation string"), 1)
    assert built.entities.count() == 0 and sorted((r.doc, r.relation) for r in built.relations.collect())[0] == (1, "q")
    assert [r.kind for r in built.warnings.collect()] == ["triple_unmatchable"]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared_root(Session())
