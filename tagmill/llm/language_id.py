"""Language identification: a bit-sliced Bloom filter gives each n-gram the mask of all languages that hold it."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.llm.common import bounded_batches, mix64, slices
from tagmill.written import cut

#: Lengths of the n-grams, in code points.
LENGTHS = (3, 4)
#: A language's n-gram is held if it is this share of all n-grams of the language, so at most 1 / SHARE are ...
SHARE = 2e-5
#: ... and at least this part of its largest share in any language: passages in a foreign language don't spread its n-grams.
OF_LARGEST = 0.1
#: Slots of the filter for each n-gram of the fullest language (rounded up to a power of two), and slots an n-gram sets.
ROOM, HASHES = 16, 4
#: Code points folded and hashed at a time; counted n-grams that a task keeps before it hands them on.
PIECE, HELD = 1 << 18, 1 << 20

_SPACE = 32


@lru_cache(maxsize=1)
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: what it counts as (letters in lower case, marks as they are, all else a space), and whether it is a letter."""
    to, letter = np.full(0x110000, _SPACE, np.uint32), np.zeros(0x110000, bool)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            letter[code] = True
            to[code] = ord(char.lower()[0])
        elif code >= 0x300 and unicodedata.category(char)[0] == "M":
            to[code] = code
    return to, letter


def _hashed(run: np.ndarray, owner: np.ndarray, fresh: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, 64-bit hash) of the n-grams of each length that lie in one owner and end at place ``fresh`` or later."""
    code = run.astype(np.uint64)
    for n in LENGTHS:
        count = len(code) - n + 1
        if count <= 0:
            continue
        packed = np.full(count, n, np.uint64)
        for i in range(n):
            packed = packed * np.uint64(0x9E3779B97F4A7C15) + code[i : i + count]
        inside = owner[:count] == owner[n - 1 :]
        inside[: max(0, fresh - n + 1)] = False
        yield owner[:count][inside], mix64(packed[inside])


def _runs(texts: list[str], first: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(folded code points, owner of each, first new place) of ``texts``, short ones together, long ones in pieces; spaces don't repeat."""
    to, _ = _folding()
    raw = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(first, first + len(texts)), [len(t) + 2 for t in texts])
    run = to[raw]
    again = (run[1:] == _SPACE) & (run[:-1] == _SPACE) & (owner[1:] == owner[:-1])
    keep = np.concatenate([[True], ~again])
    yield run[keep], owner[keep], 0


def _long_runs(text: str, number: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """As ``_runs`` for one text, piece by piece; each piece starts with the last places of the one before."""
    to, _ = _folding()
    most = max(LENGTHS) - 1
    carried = np.array([_SPACE], np.uint32)
    for a in range(0, len(text), PIECE):
        piece = text[a : a + PIECE] + (" " if a + PIECE >= len(text) else "")
        run = np.concatenate([carried, to[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]])
        new = np.concatenate([np.ones(len(carried), bool), (run[len(carried) :] != _SPACE) | (run[len(carried) - 1 : -1] != _SPACE)])
        run = run[new]
        yield run, np.full(len(run), number), len(carried) if a else 0
        carried = run[-most:]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, hash) of all n-grams of ``texts``, in pieces of about PIECE; a text begins and ends with a space."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > PIECE:
            runs, stop = _long_runs(texts[at], at), at + 1
        else:
            stop, size = at, 0
            while stop < len(texts) and len(texts[stop]) <= PIECE and (stop == at or size + len(texts[stop]) <= PIECE):
                size, stop = size + len(texts[stop]) + 2, stop + 1
            runs = _runs(texts[at:stop], at)
        for run in runs:
            yield from _hashed(*run)
        at = stop


def has_letter(text: str) -> bool:
    """Whether a character of ``text`` is a letter; looks at no more than it must."""
    return any(map(str.isalpha, text))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of rows (lang, text), added up in the task until HELD are held."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

    def given() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    for batch in slices(batches):
        langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
        names, code = np.unique(langs.astype(str), return_inverse=True) if len(langs) else ((), langs)
        for owner, key in grams(texts):
            for i, lang in enumerate(names):
                part = np.unique(key[code[owner] == i], return_counts=True)
                if len(part[0]):
                    held.setdefault(str(lang), []).append(part)
                    size += len(part[0])
        if size > HELD:
            held = {lang: [merged(parts)] for lang, parts in held.items()}
            size = sum(len(parts[0][0]) for parts in held.values())
            if size > HELD // 2:
                yield from given()
                size = 0
    yield from given()


def slots_of(key: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    """The HASHES slots of each n-gram in a filter of ``slots``, a power of two: steps of its upper half from its lower half."""
    step = (key >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield (key + np.uint64(i) * step) & np.uint64(slots - 1)


class LanguageFilter:
    """One Bloom filter a language, bit-sliced: slot s holds bit l if language l's filter has s set.

    A language's bits are in word l // 64 of a slot. An n-gram's mask is the conjunction of its slots: all languages that
    hold it, and each other language with the probability that ``chance`` gives, from the filter's real load.
    """

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        self.words = [np.ascontiguousarray(column) for column in masks.T]
        load = [float(np.mean((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1))) for i in range(len(languages))]
        self.chance = np.array(load) ** HASHES

    def mask_of(self, key: np.ndarray, word: int) -> np.ndarray:
        """The bits of ``word`` of each n-gram's mask."""
        found = np.full(len(key), -1).astype(np.uint64)
        for at in slots_of(key, len(self.masks)):
            found &= self.words[word].take(at.view(np.int64))
        return found

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(n, languages) shares of each text's n-grams that a language holds, less those by chance; and the n-grams of each."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for owner, key in grams(texts):
            total += np.bincount(owner, minlength=len(texts))
            for i in range(len(self.languages)):
                if i % 64 == 0:
                    mask = self.mask_of(key, i // 64)
                hits[:, i] += np.bincount(owner[(mask & np.uint64(1 << (i % 64))) != 0], minlength=len(texts))
        raw = hits / np.maximum(total, 1)[:, None]
        return np.clip((raw - self.chance) / np.maximum(1 - self.chance, 1e-12), 0, 1), total


def learn_languages(docs: DataFrame) -> LanguageFilter | None:
    """The filter of the rows (lang, text) of ``docs`` whose lang and text are not null; None without an n-gram.

    All n-grams of all rows are counted in Spark. What comes to the driver are the set slots: at most HASHES / SHARE for
    each language, whatever the corpus. Languages are thought to be hundreds: a slot has a bit for each.
    """
    bounded_batches(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    counts = cut(known.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all"))
    languages = [(r.lang, r["all"]) for r in totals.collect()]
    if not languages:
        return None
    # the more text a language has, the earlier it stands: the first of equal scores wins
    names = [name for name, n in sorted(languages, key=lambda x: (-x[1], x[0]))]
    share = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("all")).filter(F.col("share") >= SHARE)
    best = F.max("share").over(Window.partitionBy("gram"))  # a row a language
    kept = cut(share.withColumn("best", best).filter(F.col("share") >= OF_LARGEST * F.col("best")).select("lang", "gram"), "kept")
    fullest = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    slots = 1 << max(10, (ROOM * fullest - 1).bit_length())
    place = {name: i for i, name in enumerate(names)}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            at = np.concatenate([a.astype(np.int64) for a in slots_of(batch.column(1).to_numpy().view(np.uint64), slots)])
            mask = np.left_shift(np.uint64(1), (bit % 64).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(bit // 64, HASHES)), pa.array(np.tile(mask, HASHES))], ["slot", "word", "mask"])

    found = kept.mapInArrow(spread, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros((slots, -(-len(names) // 64)), np.uint64)
    masks[found.column("slot").to_numpy(), found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return LanguageFilter(names, masks)


def held_out(col: Column) -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; a null doc_id counts as empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, model: LanguageFilter | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of ``docs`` (doc_id, text).

    ``score`` is the share of the text's n-grams that the language holds. A null text, an empty one and one without a
    letter is ``und`` with score 0, as is any text without a model; a text whose n-grams no language holds goes to the
    language with most text, with score 0. Rows that share a doc_id are judged each; extra columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            said = [made is not None and has_letter(t) for t in texts]
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if any(said):
                share, _ = made.shares([t if s else "" for t, s in zip(texts, said, strict=True)])
                best = share.argmax(1)
                score = np.where(said, share[np.arange(len(texts)), best], 0.0)
                pred = [made.languages[b] if s else "und" for b, s in zip(best, said, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """``identify`` with the filter learned from the rows of ``docs`` (doc_id, text, lang) that are not held out. An empty table gives an empty one."""
    learned = docs.filter(~held_out(F.col("doc_id"))).select("lang", "text")
    return identify(docs.select("doc_id", "text"), learn_languages(learned))
