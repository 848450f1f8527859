"""Language identification: the filter against plain sets, whole texts in pieces, held-out accuracy and odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagmill.llm import language_id as lid
from tagmill.llm import queries

D = "/root/testdata/sf0.01"


def plain_grams(text: str) -> list[tuple[str, ...]]:
    """n-grams of the folded text, by a loop over characters."""
    kept = [" "]
    for c in text:
        to, _ = lid._folding()
        f = chr(to[ord(c)])
        if f != " " or kept[-1] != " ":
            kept.append(f)
    if kept[-1] != " ":
        kept.append(" ")
    return [tuple(kept[i : i + n]) for n in lid.LENGTHS for i in range(len(kept) - n + 1)]


TEXTS = ["", "a", "Été là!", "x1y  2z", "  two   words \n\n", "ÀÉ\x00Ö", "日本語 テキスト", "नमस्ते", "The quick brown fox", "\x00", "aaaaaaaa"]


@pytest.mark.parametrize("piece", [4, 7, 1 << 18])
def test_grams_equal_a_plain_loop_in_any_pieces(monkeypatch, piece):
    monkeypatch.setattr(lid, "PIECE", piece)
    for text in TEXTS:
        keys = [int(k) for _, key in lid.grams([text]) for k in key]
        assert len(keys) == len(plain_grams(text)), text
    together = sorted((int(o), int(k)) for owner, key in lid.grams(TEXTS) for o, k in zip(owner, key, strict=True))
    alone = sorted((i, int(k)) for i, t in enumerate(TEXTS) for _, key in lid.grams([t]) for k in key)
    assert together == alone


def test_equal_grams_have_equal_hashes_and_others_do_not():
    texts = [t for t in TEXTS if t]
    seen: dict[tuple, int] = {}
    for text in texts:
        keys = [int(k) for _, key in lid.grams([text]) for k in key]
        for g, k in zip(plain_grams(text), keys, strict=True):
            assert seen.setdefault(g, k) == k
    assert len(set(seen.values())) == len(seen)


def test_masks_hold_all_languages_and_few_others():
    rng = np.random.default_rng(1)
    slots, languages = 1 << 14, [f"l{i:02d}" for i in range(70)]
    own = [rng.integers(0, 1 << 62, 500).astype(np.uint64) for _ in languages]
    masks = np.zeros((slots, 2), np.uint64)
    for i, keys in enumerate(own):
        for at in lid.slots_of(keys, slots):
            masks[at.astype(np.int64), i // 64] |= np.uint64(1 << (i % 64))
    made = lid.LanguageFilter(languages, masks)
    for i in (0, 63, 64, 69):
        assert (made.mask_of(own[i], i // 64) >> np.uint64(i % 64) & np.uint64(1)).all()
    strange = rng.integers(1 << 62, 1 << 63, 20_000).astype(np.uint64)
    wrong = np.mean([(made.mask_of(strange, i // 64) >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(70)])
    assert wrong == pytest.approx(made.chance.mean(), rel=0.3)


def test_learned_filter_equals_plain_counts(spark):
    """Every n-gram with its share in a language is in the language's filter; others are there by chance only."""
    rows = [("xx", "the cat and the dog and the bird"), ("xx", "the hat"), ("yy", "der hund und die katze und der vogel"), ("zz", None), (None, "lost words")]
    model = lid.learn_languages(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == ["xx", "yy"]
    for i, lang in enumerate(model.languages):
        for text in [t for g, t in rows if g == lang]:
            for _, key in lid.grams([text]):
                others = [key2 for g, t in rows if g not in (lang, None) and t for _, key2 in lid.grams([t])]
                rare = np.isin(key, np.concatenate(others))
                assert ((model.mask_of(key[~rare], 0) >> np.uint64(i)) & np.uint64(1)).all()


def test_held_out_accuracy(spark):
    out = queries.op13_language_id(spark, D)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = {r.doc_id: r for r in out.collect()}
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert got.keys() == want.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].lang_pred == want[i] for i in held]) > 0.98
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    other = docs.withColumn("lang", F.when(lid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(lid.language_id(docs).collect()) == sorted(lid.language_id(other).collect())


def test_odd_rows(spark):
    rows = [(i, "the house and the garden of the king " * 3, "en", 1) for i in range(20)] + [(100 + i, "das haus und der garten des herrn " * 3, "de", 1) for i in range(20)]
    odd = [(None, None, None, 1), (901, "", "en", 1), (902, "12 34 !?", "de", 1), (903, "and the house", None, 1), (904, "und der garten", None, 1), (903, "und das haus", None, 1), (905, "中文", None, 1)]
    long = [(906, "der garten und das haus " * 100_000, None, 1)]
    docs = spark.createDataFrame(rows + odd + long, "doc_id long, text string, lang string, score int")
    out = [tuple(r) for r in lid.language_id(docs).filter("doc_id is null or doc_id > 900").collect()]
    said = sorted((str(r[0]), r[2]) for r in out)
    assert said == [("901", "und"), ("902", "und"), ("903", "de"), ("903", "en"), ("904", "de"), ("905", "en"), ("906", "de"), ("None", "und")]
    assert next(r for r in out if r[0] == 905)[3] == 0.0 and next(r for r in out if r[0] == 906)[3] > 0.8
    assert lid.language_id(docs.limit(0)).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in lid.language_id(unlabelled).collect()} == {"und"}
