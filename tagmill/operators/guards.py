"""Guards of documents: what a text says outside its tagged spans that it must not say."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions.text import find_all

# Words and forms that the guards look for.
STREET_WORDS = ("Mah.", "Mahallesi", "Cad.", "Caddesi", "Sok.", "Sokak", "Bulvarı")
LEGAL_FORMS = ("A.Ş.", "Ltd. Şti.", "Ltd.Şti.", "San. Tic.", "Ltd.")
PERSONAL_FIELDS = ("Cinsiyet", "Yaş", "Medeni Durum", "Uyruk", "Doğum Tarihi", "Kan Grubu", "Din", "Etnik Köken")
META_PHRASES = (
    "coreference", "madde 6", "atıf çözümü", "doc_subject", "sampler", "coarse mod", "entity node", "anotasyon",
    "simülasyon amaçlı", "eğitim amaçlı örnek", "fine-coarse", "simetrik ilişki", "tek yönlü olarak", "(rol:", "etiket olarak",
)
FOLDED_BEGINNINGS = ("kisisin",)
FOLDED_WORDS = (
    "kisisi", "kisisine", "bileseni", "parcasidir", "numarasidir", "sicilidir", "isaretler",
    "baglanmistir", "goruntulenmistir", "kesilmistir", "uyrugudur", "tam adinin", "tam adresinin",
)

_DIGIT, _UPPER, _LETTER = "[0-9]", "[A-ZÇĞİÖŞÜ]", r"\p{L}"
_SPACE = "[ \t]"


def any_of(parts: tuple[str, ...]) -> str:
    """A pattern for one of the literal ``parts``, the longer before the shorter."""
    return "(?:" + "|".join(re.escape(p).replace(r"\ ", " ") for p in sorted(parts, key=len, reverse=True)) + ")"


class Guard(NamedTuple):
    """What must not stand open in a text.

    A match counts if it does not begin with ``spared`` and, with ``edges``, touches no letter, digit or
    underscore outside. It is closed if it lies inside one span ("inside"), if its value, after the colon, begins in one
    ("value"), or never (""); and if a known value explains it: by its digits ("digits"), its text ("text"), or never ("").
    ``folded`` guards read the text in lower case. A text with none of the texts in ``needs``, if there are any, or no
    match of the cheap pattern ``hint`` is not searched.
    """

    problem: str
    pattern: str
    spared: str = ""
    edges: bool = False
    closed_by: str = "inside"
    explained_by: str = ""
    folded: bool = False
    needs: tuple[str, ...] = ()
    hint: str = ""


_DAY, _YEAR = f"{_DIGIT}{{1,2}}", f"(?:19|20){_DIGIT}{{2}}"
_DATE_AND_HOUR = (f"{_DAY}[./-]{_DAY}[./-]{_YEAR}[ .-]{_DAY}", f"{_YEAR}-{_DIGIT}{{2}}-{_DIGIT}{{2}} {_DAY}")
_AMOUNT, _MASK = rf"{_DIGIT}{{1,3}}(?:\.{_DIGIT}{{3}}){{3,}}$", r"(?:255|0)(?:\.(?:255|0)){3}$"
#: Identifiers by their parts: 17 characters of a vehicle number (no I, O, Q), a plate's province, letters and number, an account of the country.
_VEHICLE, _PLATE = "[A-HJ-NPR-Z0-9]{17}", f"{_DIGIT}{{2}} [A-Z]{{1,3}} {_DIGIT}{{2,4}}"
_ACCOUNT = f"TR{_DIGIT}{{2}}(?: ?{_DIGIT}{{4}}){{5}} ?{_DIGIT}{{2}}"
_CAPITALISED = rf"{_UPPER}[{_LETTER}0-9_&.-]*{_SPACE}+"

GUARDS = (
    Guard("unlisted number", f"{_DIGIT}(?:[ .-]?{_DIGIT}){{9,}}", rf"(?:(?:{'|'.join(_DATE_AND_HOUR)})(?:[^0-9]|$)|{_AMOUNT}|{_MASK})", explained_by="digits", hint=f"{_DIGIT}[ .-]?{_DIGIT}"),
    Guard("unlisted identifier", f"(?:{_VEHICLE}|{_PLATE}|{_ACCOUNT})", edges=True, explained_by="text", hint="[A-Z0-9]{2}"),
    Guard("untagged address", rf"[^ \t\n]+ {any_of(STREET_WORDS)}[^\n]{{0,40}}?No:?[ \t]?{_DIGIT}+", needs=STREET_WORDS),
    Guard("untagged organisation", f"(?:{_CAPITALISED}){{1,4}}{any_of(LEGAL_FORMS)}", explained_by="text", needs=LEGAL_FORMS),
    Guard("untagged personal field", rf"{any_of(PERSONAL_FIELDS)}[ \t]*:[ \t]*[^\n,;]+", closed_by="value", needs=PERSONAL_FIELDS),
    Guard("stray bracket", r"[\[\]]", closed_by="", needs=("[", "]")),
    Guard("meta-language", any_of(META_PHRASES), closed_by="", folded=True, needs=META_PHRASES),
    Guard("folded word", rf"(?:{any_of(FOLDED_BEGINNINGS)}[a-z0-9_]*|{any_of(FOLDED_WORDS)})", edges=True, closed_by="", folded=True, needs=(*FOLDED_BEGINNINGS, *FOLDED_WORDS)),
)
#: What a document that must hold no personal data may not have at all.
ZERO = ("unlisted number", "unlisted identifier", "untagged address", "untagged personal field", "stray bracket")


def label_guard(labels: list[str]) -> Guard:
    """The ninth guard: a label's name as a word of the text. ``labels`` is a vocabulary."""
    return Guard("label words leaked", any_of(tuple(labels)), edges=True, closed_by="", needs=tuple(labels))


def _hits(guard: Guard) -> Column:
    """array<struct<problem,surface,start,end,at>> of a guard's matches that count; ``at`` is where a span must begin to close it."""
    text = F.col("_low") if guard.folded else F.col("_text")
    found = find_all(text, guard.pattern)
    may = F.lit(not guard.needs)
    for word in guard.needs:
        may = may | F.contains(text, F.lit(word))
    if guard.hint:
        may = may & text.rlike(guard.hint)
    if guard.needs or guard.hint:
        found = F.when(may, found).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)"))
    if guard.spared:
        found = F.filter(found, lambda m: ~m["text"].rlike(f"^{guard.spared}"))
    if guard.edges:
        word = r"[\p{L}\p{N}_]"
        # a start of 0 has no character before it
        before = lambda m: F.when(m["start"] > 0, F.substring(text, m["start"], F.lit(1))).otherwise("")
        found = F.filter(found, lambda m: ~before(m).rlike(word) & ~F.substring(text, m["end"] + 1, F.lit(1)).rlike(word))
    at = (lambda m: m["start"] + F.length(F.regexp_extract(m["text"], r"^[^:]*:[ \t]*", 0))) if guard.closed_by == "value" else (lambda m: m["start"])
    return F.transform(found, lambda m: F.struct(F.lit(guard.problem).alias("problem"), m["text"].alias("surface"), m["start"].alias("start"), m["end"].alias("end"), at(m).alias("at")))


def subtract_spans(hits: DataFrame, spans: DataFrame, key: str, whole: Column) -> DataFrame:
    """``hits`` (key, at, end, …) that no span (key, start, end) closes: one that begins at ``at`` or before and reaches ``end``, where ``whole`` holds, else goes beyond ``at``.

    One sort of hits and spans together: the largest end of the spans that began so far says it, so neither side is
    gathered and no pairs are made.
    """
    columns = hits.columns
    told = hits.select(F.col(key), F.col("at").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_reach"), F.struct(*columns).alias("_hit"), whole.alias("_whole"))
    cover = spans.select(F.col(key), F.col("start").cast("int").alias("_at"), F.lit(0).alias("_kind"), F.col("end").cast("int").alias("_reach"), F.lit(None).cast(told.schema["_hit"].dataType).alias("_hit"), F.lit(None).cast("boolean").alias("_whole"))
    reach = F.max("_reach").over(Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    both = told.unionByName(cover).withColumn("_far", reach).filter("_kind = 1")
    closed = F.when(F.col("_whole"), F.col("_far") >= F.col("_hit.end")).otherwise(F.col("_far") > F.col("_at"))
    return both.filter(~F.coalesce(closed, F.lit(False))).select("_hit.*")


def guard_problems(docs: DataFrame, spans: DataFrame, known: DataFrame, key: str, guards: tuple[Guard, ...] = GUARDS) -> DataFrame:
    """(key, problem, surface, start): the first open match of each guard in ``docs`` (key, text).

    ``spans`` has (key, start, end), ``known`` (key, value). Rows of ``docs`` that share a key are read as one document; null
    texts have no problems; a null key is a key.
    """
    by = {g.problem: g for g in guards}
    read = docs.select(key, F.coalesce("text", F.lit("")).alias("_text")).withColumn("_low", F.lower("_text"))
    hits = read.select(key, F.inline(F.concat(*(_hits(g) for g in guards))))
    never = [p for p, g in by.items() if not g.closed_by]
    value = [p for p, g in by.items() if g.closed_by == "value"]
    left = subtract_spans(hits.filter(~F.col("problem").isin(*never)), spans, key, ~F.col("problem").isin(*value)).unionByName(hits.filter(F.col("problem").isin(*never)))
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    values = known.filter("value is not null").groupBy(F.col(key).alias("_key")).agg(F.collect_set("value").alias("_values"))
    m = left.join(values, F.col(key).eqNullSafe(F.col("_key")), "left")
    own = digits(F.col("surface"))
    by_digits = F.exists("_values", lambda v: (digits(v) != "") & (F.contains(digits(v), own) | F.contains(own, digits(v))))
    by_text = F.exists("_values", lambda v: F.contains(v, F.trim("surface")))
    kind = lambda name: F.col("problem").isin(*[p for p, g in by.items() if g.explained_by == name])
    explained = F.coalesce((kind("digits") & by_digits) | (kind("text") & by_text), F.lit(False))
    return m.filter(~explained).groupBy(key, "problem").agg(F.min(F.struct("start", "surface")).alias("f")).select(key, "problem", "f.surface", "f.start")


def zero_problems(docs: DataFrame, spans: DataFrame, key: str, guards: tuple[Guard, ...] = GUARDS) -> DataFrame:
    """(key, problems) of ``docs`` that should hold no personal data and don't pass: a tagged span, or a match of a guard in ZERO, closed or not."""
    none = spans.limit(0)
    found = guard_problems(docs, none, none.select(key, F.lit("").alias("value")), key, tuple(g for g in guards if g.problem in ZERO)).select(key, "problem")
    tagged = spans.join(docs.select(key), key, "left_semi").select(key, F.lit("tagged span").alias("problem"))
    return found.unionByName(tagged).groupBy(key).agg(F.sort_array(F.collect_set("problem")).alias("problems"))
