"""Text functions as columns: tokens with offsets, sentences, normal forms."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The word splitter's alternatives in their order, and where a sentence may end.
WORD = r"(?:https?://\S+|www\.\S+)|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|@[A-Za-z0-9_]+|[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*|\S"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-ZÇĞİÖŞÜ0-9\"(])"


def words(text: Column) -> Column:
    """Tokens of the word splitter, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<start,end,text>> of the matches of ``pattern``; code points, half-open.

    What lies between the matches is found by a split, and only where there is a match.
    """
    text = F.coalesce(text, F.lit(""))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    # both arrays in one, made once: a lambda's variable is not planned again for each use
    held = F.filter(F.array(hits), lambda h: F.size(h) > 0)
    return F.flatten(F.transform(held, lambda h: with_starts(h, gaps)))


def with_starts(pieces: Column, gaps: Column, most: int = 64) -> Column:
    """array<struct<start,end,text>> of ``pieces``, each of which follows its gap (a number of code points) in a text.

    Running sums in blocks of ``most``: a sum inside a block costs its place there, and the blocks' own sums are few, so the
    cost is the number of pieces times ``most`` at worst, not its square.
    """
    steps = F.zip_with(gaps, F.concat(F.array(F.lit("")), pieces), lambda g, p: F.coalesce(g, F.lit(0)) + F.coalesce(F.length(p), F.lit(0)))  # gap i and piece i - 1
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    blocks = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / most).cast("int")), lambda b: total(F.slice(s, b * most + 1, F.lit(most))))
    tables = F.array(F.struct(steps.alias("s"), pieces.alias("p")))
    summed = F.transform(tables, lambda t: F.struct(t["s"].alias("s"), t["p"].alias("p"), blocks(t["s"]).alias("b")))
    start = lambda t, i: total(F.slice(t["b"], F.lit(1), F.floor(i / most).cast("int"))) + total(F.slice(t["s"], F.floor(i / most).cast("int") * most + 1, F.pmod(i, F.lit(most)) + 1))
    begun = F.flatten(F.transform(summed, lambda t: F.transform(t["p"], lambda x, i: F.struct(start(t, i).alias("start"), x.alias("text")))))
    return F.transform(begun, lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["text"])).alias("end"), m["text"].alias("text")))


def sentences(text: Column) -> Column:
    """Sentences in order: cut at white space after a full stop, question or exclamation mark before a capital, digit, quote or bracket."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SENTENCE_GAP, -1), lambda s: F.trim(s) != "")


def squeeze(text: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def tr_lower(text: Column) -> Column:
    """Turkish lower case: dotted and dotless i keep apart."""
    return F.lower(F.translate(text, "İI", "iı"))


def ascii_fold(text: Column) -> Column:
    """Turkish letters as their ASCII likeness."""
    return F.translate(text, "çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU")


def closed(text: Column) -> Column:
    """``text`` with a full stop unless it ends in one, or in a question or exclamation mark."""
    return F.when(text.rlike(r"[.!?]\z"), text).otherwise(F.concat(text, F.lit(".")))


def junk_reason(mention: Column) -> Column:
    """Why a mention is junk, or null: nothing but punctuation and spaces; one token of at most three letters; over 30 per cent punctuation.

    Spaces count for neither side of the share; the first reason that holds is told; a null mention is none.
    """
    solid = F.replace(mention, F.lit(" "), F.lit(""))
    others, letters = F.length(F.regexp_replace(solid, r"\p{P}", "")), F.length(F.regexp_replace(solid, r"[^\p{L}]", ""))
    share = 1 - others / F.length(solid)
    reasons = {"punctuation": others == 0, "short": (F.length(solid) == F.length(mention)) & (letters < 4), "noisy": share > 0.3}
    return F.coalesce(*(F.when(holds, name) for name, holds in reasons.items()))


def trim_span(start: Column, text: Column) -> tuple[Column, Column]:
    """(start, text) of a span without white space and closing marks at its end and opening marks at its begin."""
    ltrim = F.regexp_replace(text, r"^[ \t\n\r\f\x0B]+", "")
    right = F.regexp_replace(F.regexp_replace(ltrim, r"[ \t\n\r\f\x0B]+$", ""), r"[,.;:!?)\]}\"']+$", "")
    left = F.regexp_replace(right, r"^[(\[{\"']+", "")
    moved = F.length(text) - F.length(ltrim) + F.length(right) - F.length(left)
    return start + moved, F.regexp_replace(left, r"[ \t\n\r\f\x0B]+$", "")


#: The character splitter, and the pretokeniser's apostrophes.
CHARS = r"[A-Za-z0-9@._\-+]+|\S"
APOSTROPHES = "'’"


def char_words(text: Column) -> Column:
    """Tokens of the character splitter: runs of ASCII letters, digits and ``@._-+``; any other visible character alone."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CHARS), F.lit(0))


def low_words(text: Column) -> Column:
    """Tokens of the word splitter in lower case."""
    return F.transform(words(text), lambda x: F.lower(x))


def clitic_words(text: Column) -> Column:
    """White-space words, each cut before the first apostrophe that follows another character."""
    cut = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\s{APOSTROPHES}][^\s{APOSTROPHES}]*|[{APOSTROPHES}]\S*"), F.lit(0))
    return F.filter(cut, lambda x: x != "")


def tr_upper(text: Column) -> Column:
    """Turkish upper case: i gets its dot, dotless i none."""
    return F.upper(F.translate(text, "iı", "İI"))


def tr_title(text: Column) -> Column:
    """Turkish title case of single-spaced words."""
    return F.array_join(F.transform(F.split(squeeze(text), " "), lambda w: F.concat(tr_upper(F.substring(w, 1, 1)), tr_lower(F.substring(w, 2, 1 << 30)))), " ")


def document_type(text: Column) -> Column:
    """Lower case, white space squeezed."""
    return F.lower(squeeze(text))


def brief_key(description: Column, kind: Column) -> Column:
    """md5 of the trimmed lower-case description, or of the kind where that is null or empty."""
    return F.md5(F.lower(F.trim(F.coalesce(F.nullif(description, F.lit("")), kind, F.lit("")))))


def file_name(text: Column) -> Column:
    """``text`` with anything but ASCII letters, digits and ``-_.`` as an underscore."""
    return F.regexp_replace(text, r"[^A-Za-z0-9\-_.]", "_")


def without_fences(text: Column, marker: str) -> tuple[Column, Column]:
    """(text, complete): code fences and the end ``marker`` taken off; complete if the marker stood at the end."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^```[A-Za-z]*[ \t]*$\n?", ""))
    done = bare.endswith(marker)
    return F.when(done, F.trim(F.substring(bare, F.lit(1), F.length(bare) - len(marker)))).otherwise(bare), done


def repeated_before(text: Column, start: Column, span: Column) -> Column:
    """Whether the span's first word, of three characters or more, stands right before it in the forty characters before, and no colon or hyphen before that."""
    head = F.rtrim(F.substring(text, F.greatest(start - 40, F.lit(0)) + 1, F.least(start, F.lit(40))))
    first = F.element_at(F.split(F.trim(span), r"\s+"), 1)
    rest = F.rtrim(F.substring(head, F.lit(1), F.length(head) - F.length(first)))
    return F.coalesce((F.length(first) >= 3) & F.endswith(head, first) & ~rest.rlike(r"[:\-]\z"), F.lit(False))


def near(text: Column, start: Column, end: Column, reach: int = 60) -> Column:
    """The span with ``reach`` characters on either side."""
    begin = F.greatest(start - reach, F.lit(0))
    return F.substring(text, begin + 1, end + reach - begin)


def votes(text: Column, patterns: dict[str, str]) -> Column:
    """The name of the pattern with the most matches in ``text``; none, or a draw, gives null."""
    counts = F.array(*(F.struct(F.regexp_count(text, F.lit(p)).alias("n"), F.lit(name).alias("name")) for name, p in patterns.items()))
    best = F.array_max(F.transform(counts, lambda c: c["n"]))
    first = F.filter(counts, lambda c: c["n"] == best)
    return F.when((best > 0) & (F.size(first) == 1), first[0]["name"])


_BLANK = " \t\n\r\f\x0B"


def _apart(text: str, words_: list[str], begin: int) -> tuple[int, int] | None:
    """The first place from ``begin`` on where ``words_`` follow each other with any white space between, or none."""
    while (begin := text.find(words_[0], begin)) >= 0:
        end = begin + len(words_[0])
        for w in words_[1:]:
            while text[end : end + 1] in _BLANK and end < len(text):
                end += 1
            if not text.startswith(w, end):
                break
            end += len(w)
        else:
            return begin, end
        begin += 1
    return None


def _places(text: str, wanted: list[str]) -> list[dict]:
    found, cursor = [], 0
    for s in (w.strip(" ") for w in wanted if w is not None):
        if s == "":
            continue
        at = text.find(s, cursor)
        span = (at, at + len(s)) if at >= 0 else _apart(text, re.split(f"[{_BLANK}]+", s), cursor)
        if span is None or span[0] == span[1]:
            raise ValueError(f"sentence not found: {s[:60]!r}")
        found.append({"start": span[0], "end": span[1]})
        cursor = span[1]
    return found


def align_sentences(text: Column, sentences_: Column) -> Column:
    """array<struct<start,end>> of the places of ``sentences_`` in ``text``, each sought after the one before.

    A sentence is sought as it is, then with its words apart by any white space; blank ones are left out, and one that is
    not there fails the job. The search goes on in the text itself, in an Arrow batch: as an expression, what is left of the
    text was copied for each sentence, and a pattern of thousands of words ended the executor's stack.
    """

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def aligned(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([_places(t.as_py() or "", w.as_py() or []) for t, w in zip(texts, wanted, strict=True)], kind)

    return aligned(text, sentences_)
