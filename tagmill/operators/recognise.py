"""Rule-based recognition of personal data: patterns, checksum confirmation, overlap resolution."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions import validators as v
from tagmill.functions.text import find_all
from tagmill.operators.spans import greedy


class Recogniser(NamedTuple):
    """Label, pattern, confidence, the name of the validator that confirms a match, and a text that every match holds ('' for none)."""

    label: str
    pattern: str
    confidence: float
    validator: str = ""
    holds: str = ""


#: The built-in rules.
RULES = (
    Recogniser("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0.9, holds="@"),
    Recogniser("card", r"[0-9]{4}(?:[ -]?[0-9]{4}){3}", 0.8, "luhn"),
    Recogniser("phone", r"\+[0-9]{1,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 0.7, holds="+"),
    Recogniser("ipv4", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", 0.6, "ipv4"),
)


def _confirmed(rule: Recogniser, text: Column) -> Column:
    return getattr(v, rule.validator)(text) if rule.validator else F.lit(True)


def _matches(rule: Recogniser) -> Column:
    def labelled(m: Column) -> Column:
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("surface"), F.lit(rule.label).alias("label"), F.lit(rule.confidence).alias("confidence"))

    none = F.expr("cast(array() as array<struct<start:int,end:int,surface:string,label:string,confidence:double>>)")
    return F.when(F.contains(F.col("text"), F.lit(rule.holds)), F.transform(find_all(F.col("text"), rule.pattern), labelled)).otherwise(none)


def candidates(docs: DataFrame, rules: tuple[Recogniser, ...] = RULES, confirm: bool = True) -> DataFrame:
    """One row for each match of a rule: the columns of ``docs`` but text, and start, end, surface, label, confidence.

    One scan: all rules' matches are arrays of one projection, and a rule is tried only on texts that hold what each of
    its matches holds. Null texts have no matches.
    """
    others = [c for c in docs.columns if c != "text"]
    hit = F.concat(*(_matches(r) for r in rules))
    found = docs.filter("text is not null").select(*others, F.inline(hit))
    if not confirm:
        return found
    ok = F.lit(True)
    for r in rules:
        if r.validator:
            ok = ok & ((F.col("label") != r.label) | _confirmed(r, F.col("surface")))
    return found.filter(ok)


def mentions(docs: DataFrame, key: str = "doc_id", rules: tuple[Recogniser, ...] = RULES) -> DataFrame:
    """Confirmed matches without overlaps: the more confident, then longer, then earlier span stays."""
    return greedy(candidates(docs, rules), [c for c in docs.columns if c != "text"])
