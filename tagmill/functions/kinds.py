"""Values of named kinds: what a value of a kind looks like, by length, words and form, or by the words it holds."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Kind(NamedTuple):
    """From ``least`` to ``most`` characters and at most ``words`` words; it matches ``pattern`` and not ``unlike``, and is none of ``never``, all in any case."""

    least: int = 1
    most: int = 160
    words: int = 160
    pattern: str = ""
    unlike: str = ""
    never: tuple[str, ...] = ()


# The kinds that are told by their form.
_MONEY = "(?:TL|₺|lira|TRY)"
_ORGANISATION_WORDS = (
    "A.Ş", "A.S", "Ltd", "Şti", "San.", "Tic.", "Holding", "Vakfı", "Derneği", "Belediyesi", "Üniversitesi", "Hastanesi", "Bankası", "Sigorta", "Kooperatif", "Müdürlüğü", "Bakanlığı",
    "Başkanlığı", "Okulu", "Lisesi", "Kliniği", "Eczanesi", "Market", "Şirketi", "Grup", "Group", "Inc", "GmbH", "Limited", "Anonim", "Enerji", "Lojistik", "Teknoloji", "Yazılım", "İnşaat",
    "Tekstil", "Gıda", "Otomotiv", "Merkezi", "Danışmanlık", "Laboratuvar", "Hizmetleri", "Sanayi", "Medya", "Çözümleri", "Ajans", "Kurumu", "Ofisi", "Bürosu",
)
_CAPITALISED = r"(?:\p{Lu}[^ ]*|ve|&)"
_ORGANISATION = "|".join(re.escape(w) for w in _ORGANISATION_WORDS)
FORMS = {
    "nickname": Kind(2, 30, 3),
    "salary_info": Kind(pattern=rf"[0-9]{{1,3}}(?:\.[0-9]{{3}})+|[0-9]{{4,6}}[ ]?{_MONEY}"),
    "workplace_location": Kind(2, 60, 7, unlike="No:"),
    "medical_condition": Kind(3, 120, never=("hastalık", "rahatsızlık")),
    "mental_health_info": Kind(3, 120),
    "medication": Kind(3, 60, pattern=r"^\p{L}"),
    "medical_procedure": Kind(4, 120),
    "job_title": Kind(3, 80, 8, rf"^[\p{{L}}.\-/ ]+$", never=("çalışan", "personel")),
    "work_history": Kind(10, 160, pattern=r"[^ ]+ +[^ ]+ +[^ ]+|(?:19|20)[0-9]{2}|süre|arasında|görev|deneyim"),
    "company_name": Kind(2, 160, pattern=rf"{_ORGANISATION}|^{_CAPITALISED}(?: {_CAPITALISED}){{1,6}}$", unlike=r"^[^\p{Lu}]*$"),
    "tax_office_name": Kind(pattern="[Vv]ergi [Dd]airesi *$"),
}
PLACEHOLDERS = ("x", "y", "z", "abc", "xyz", "örnek", "ornek", "lorem", "n/a", "na", "test")
PLACEHOLDER_PHRASES = ("firma adı", "şirket adı", "kurum adı")


def by_words(words: tuple[str, ...], least: int = 1) -> Kind:
    """A kind that is told by one of ``words`` in it, in lower case: a vocabulary of the user's."""
    return Kind(least, pattern="|".join(re.escape(w.lower()) for w in words))


def refusal(value: Column, kind: Column, known: Column, kinds: dict[str, Kind], lowered: tuple[str, ...] = ()) -> Column:
    """Why ``value`` can't be a new value of ``kind``; null if it can.

    In order: "unknown kind", "length" (empty or over 160 characters), "placeholder", "digits only", "known value" (the value,
    or one of over three characters inside it, is in the array ``known``, in any case), "format". Kinds named in ``lowered`` are
    matched in lower case, as those of ``by_words`` must be. A null value is empty, a null ``known`` holds nothing.
    """
    v = F.trim(F.coalesce(value, F.lit("")))
    low = F.lower(v)
    words = F.split(low, " +")
    alike = lambda k: (F.lower(k) == low) | ((F.length(v) > 3) & F.contains(F.lower(k), low))
    odd = F.exists(words, lambda w: w.isin(*PLACEHOLDERS) | w.rlike(r"^(?:x{3,}|\?{2,}|\.{3,})$")) | v.rlike(r"\[[^\]]*\]|<[^>]*>")
    for phrase in PLACEHOLDER_PHRASES:
        odd = odd | F.contains(low, F.lit(phrase))
    fits, there = F.lit(False), F.lit(False)
    for name, k in kinds.items():
        read = low if name in lowered else v
        own = F.length(v).between(k.least, k.most) & (F.size(words) <= k.words)
        if k.pattern:
            own = own & read.rlike(k.pattern)
        if k.unlike:
            own = own & ~v.rlike(k.unlike)
        if k.never:
            own = own & ~low.isin(*k.never)
        here = F.coalesce(kind == name, F.lit(False))
        fits, there = fits | (here & own), there | here
    return (
        F.when(~there, "unknown kind").when((v == "") | (F.length(v) > 160), "length").when(odd, "placeholder").when(v.rlike("^[0-9]+$"), "digits only")
        .when(F.coalesce(F.exists(known, lambda k: k.isNotNull() & alike(k)), F.lit(False)), "known value").when(~fits, "format")
    )
