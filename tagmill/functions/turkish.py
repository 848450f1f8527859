"""Turkish word shapes: how values are read aloud, suffixes in harmony with them, streets and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagmill.functions.text import squeeze, tr_title

#: Last vowel and voicing ('t' voiceless, 'd' voiced) of the spoken digits 1 to 9, of the tens from 10, and of letters read by name.
DIGITS = ("id", "id", "üt", "öd", "et", "ıd", "id", "id", "ud")
TENS = ("od", "id", "ud", "ıt", "id", "ıt", "it", "ed", "ad")
LETTERS = {"A": "a", "I": "ı", "İ": "i", "O": "o", "Ö": "ö", "U": "u", "Ü": "ü"}
#: Suffix shapes with A for a or e, I for ı, i, u or ü, D for d or t; after n the D stays d.
SHAPES = ("DA", "DAn", "nDA", "nDAn", "In", "nIn", "A", "yA", "I", "yI", "nI", "DIr", "lA", "ylA", "lAr", "DAnI")
KI = ("DA", "nDA")
#: Kinds of streets by how their names end.
STREETS = {"sokak": ("sokak", "sokağı", "sk", "sk."), "cadde": ("caddesi", "cadde", "cad", "cad."), "bulvar": ("bulvarı", "bulvar", "blv", "blv.")}


def spoken_end(value: Column) -> Column:
    """Two characters: the last vowel of ``value`` as it is read aloud, and t if that ends voiceless, else d; null if unknown."""
    bare = F.regexp_replace(F.coalesce(value, F.lit("")), r"[ .)\]\"'’]+\z", "")
    return F.element_at(F.transform(F.array(bare), _spoken_end), 1)  # a lambda's variable is made once, however often it is named


def _spoken_end(v: Column) -> Column:
    """The vowel a value's spoken form ends with, and whether its end sounds hard (t) or soft (d).

    By what stands last: a number ends like its last spoken digit, ten, hundred or thousand; an abbreviation, in capitals
    and short or without a vowel, like its last letter's name; any other word like its last vowel and last letter.
    """
    number, last = F.regexp_extract(v, r"([0-9]+)\z", 1), F.substring(v, -1, 1)
    pick = lambda table, digit: F.element_at(F.array(*(F.lit(x) for x in table)), digit.cast("int"))
    ten = F.substring(number, -2, 1)
    as_number = F.when(number.endswith("000"), "id").when(number.endswith("00"), "üd").when(number.endswith("0"), F.when((F.length(number) > 1) & (ten != "0"), pick(TENS, F.when(ten != "0", ten))).otherwise("ad")).otherwise(pick(DIGITS, F.when(last.rlike("[1-9]"), last)))
    word = F.element_at(F.split(v, "[ .]"), -1)
    vowels = "[aeıioöuüAEIİOÖUÜ]"
    spelt = last.rlike(r"\p{L}") & (word == F.upper(word)) & ((F.length(word) <= 3) | ~word.rlike(vowels))
    name = F.lit("e")
    for letter, vowel in LETTERS.items():
        name = F.when(last == letter, vowel).otherwise(name)
    low = F.lower(v)
    vowel = F.regexp_extract(low, r"([aeıioöuü])[^aeıioöuü]*\z", 1)
    as_word = F.when(vowel != "", F.concat(vowel, F.when(F.substring(low, -1, 1).rlike("[pçtkfsşh]"), "t").otherwise("d")))
    return F.when(v == "", None).when(number != "", as_number).when(spelt, F.concat(name, F.lit("d"))).otherwise(as_word)


def harmonious(suffix: Column, spoken: Column) -> Column:
    """``suffix`` as it must sound after a word that ends like ``spoken``; suffixes of unknown shape stay."""
    both = F.array(F.struct(suffix.alias("suffix"), spoken.alias("spoken")))
    return F.element_at(F.transform(both, lambda x: _harmonious(x["suffix"], x["spoken"])), 1)


def _harmonious(suffix: Column, spoken: Column) -> Column:
    vowel, voice = F.substring(spoken, 1, 1), F.substring(spoken, 2, 1)
    back = vowel.isin("a", "ı", "o", "u")
    two = F.when(back, "a").otherwise("e")
    four = F.when(vowel.isin("o", "u"), "u").when(back, "ı").when(vowel.isin("ö", "ü"), "ü").otherwise("i")
    ki = F.endswith(suffix, F.lit("ki"))
    stem = F.when(ki, F.substring(suffix, F.lit(1), F.length(suffix) - 2)).otherwise(suffix)
    shape = F.translate(stem, "aeıiuüdt", "AAIIIIDD")
    known = F.when(ki, shape.isin(*KI)).otherwise(shape.isin(*SHAPES))
    d = F.when(shape.startswith("nD"), "d").otherwise(voice)
    made = F.replace(F.replace(F.replace(shape, F.lit("A"), two), F.lit("I"), four), F.lit("D"), d)
    return F.when(known & spoken.isNotNull(), F.concat(made, F.when(ki, "ki").otherwise(""))).otherwise(suffix)


def fix_suffixes(docs: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """(key, text, fixes): ``docs`` (key, text) with the apostrophe suffixes right after ``spans`` (key, start, end) in harmony.

    A fix keeps the length, so every offset stays. Spans must not overlap; documents without a fix come back as they are.
    """
    after = F.regexp_extract(F.substring("text", F.col("end") + 1, F.lit(8)), r"\A['’]([a-zçğıöşü]{1,5})(?![a-zçğıöşü])", 1)
    at = spans.join(docs.select(key, "text"), key).withColumn("_old", after).filter("_old <> ''")
    value = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    at = at.withColumn("_said", spoken_end(value)).withColumn("_new", harmonious(F.col("_old"), F.col("_said"))).filter((F.col("_new") != F.col("_old")) & (F.length("_new") == F.length("_old")))
    at = at.select(key, "text", (F.col("end") + 1).alias("_a"), "_new").distinct()
    by = Window.partitionBy(key).orderBy("_a")
    from_ = F.coalesce(F.lag(F.col("_a") + F.length("_new")).over(by), F.lit(0))
    at = at.withColumn("_from", from_).withColumn("_last", F.lead("_a").over(by).isNull())
    tail = F.when(F.col("_last"), F.substring("text", F.col("_a") + F.length("_new") + 1, F.length("text"))).otherwise(F.lit(""))
    piece = F.concat(F.substring("text", F.col("_from") + 1, F.col("_a") - F.col("_from")), F.col("_new"), tail)
    fixed = at.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_a", piece.alias("p")))), lambda x: x["p"]), "").alias("_fixed"), F.count("*").alias("_n"))
    return docs.join(fixed, key, "left").select(key, F.coalesce("_fixed", "text").alias("text"), F.coalesce("_n", F.lit(0)).cast("long").alias("fixes"))


def neighbourhood(name: Column) -> tuple[Column, Column]:
    """(name without brackets in title case, with a final ``mah`` as ``Mah.``; whether it is rural: a village or the like, and no quarter)."""
    base = squeeze(F.regexp_replace(name, r"\s*\(.*?\)\s*", " "))
    quarter = F.lower(base).rlike(r"(?:\A|\s)mah\z")
    shown = F.when(quarter, F.concat(tr_title(F.substring(base, F.lit(1), F.length(base) - 3)), F.lit(" Mah."))).otherwise(tr_title(base))
    return F.trim(shown), F.lower(name).rlike("köy|kume|küme|belde|mezra|yayla") & ~quarter


def street_kind(name: Column) -> Column:
    """sokak, cadde or bulvar by the name's end; kume where it speaks of such houses; village in brackets; else other."""
    low = F.lower(F.trim(name))
    out = F.lit("other")
    for kind, ends in [("village", None), ("kume", None), *reversed(STREETS.items())]:
        test = low.startswith("(") if kind == "village" else low.rlike("k[uü]me evleri") if kind == "kume" else low.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in ends) + r")\z")
        out = F.when(test, kind).otherwise(out)
    return out


def address(shape: Column, part: dict[str, Column], with_zip: Column) -> Column:
    """A full address in one of five shapes from the parts quarter, street, no, flat, floor, town, city and zip."""
    p = {k: v.cast("string") for k, v in part.items()}
    say = lambda form, *names: F.format_string(form, *(p[n] for n in names))
    line = (
        F.when(shape == 1, say("%s %s No:%s D:%s", "quarter", "street", "no", "flat"))
        .when(shape == 2, say("%s %s No:%s Daire:%s", "quarter", "street", "no", "flat"))
        .when(shape == 3, say("%s No:%s/%s, %s", "street", "no", "flat", "quarter"))
        .when(shape == 4, say("%s, %s, No: %s, Kat: %s, Daire: %s", "quarter", "street", "no", "floor", "flat"))
        .otherwise(say("%s %s %s/%s", "quarter", "street", "no", "flat"))
    )
    before, after = F.when(with_zip, F.concat(p["zip"], F.lit(" "))).otherwise(""), F.when(with_zip, F.concat(F.lit(" "), p["zip"])).otherwise("")
    end = (
        F.when(shape == 3, F.concat(F.lit(", "), p["town"], F.lit(", "), p["city"], after))
        .when(shape == 4, F.concat(F.lit(", "), before, p["town"], F.lit(" / "), p["city"]))
        .when(shape == 5, F.concat(F.lit(" "), p["town"], F.lit(" "), p["city"]))
        .otherwise(F.concat(F.lit(" "), before, p["town"], F.lit("/"), p["city"]))
    )
    return F.concat(line, end)
