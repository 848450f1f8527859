"""Checksum and format validators as boolean columns; malformed or null input is false, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(text: Column) -> Column:
    """Digits of a text of digits as an array of int."""
    return F.transform(F.split(text, ""), lambda c: c.cast("int"))


def _when_shaped(text: Column, pattern: str, test: Column) -> Column:
    return F.coalesce(F.when(text.rlike(pattern), test), F.lit(False))


def luhn(text: Column) -> Column:
    """Digits, spaces and hyphens apart, pass the Luhn check."""
    return F.coalesce(F.call_function("luhn_check", F.regexp_replace(text, "[ -]", "")), F.lit(False))


def tckn(text: Column) -> Column:
    """National number of 11 digits, the first not 0, with its two check digits."""
    d = _digits(text)
    at = lambda i: F.element_at(d, i + 1)
    odd = at(0) + at(2) + at(4) + at(6) + at(8)
    even = at(1) + at(3) + at(5) + at(7)
    return _when_shaped(text, "^[1-9][0-9]{10}$", (F.pmod(odd * 7 - even, F.lit(10)) == at(9)) & (F.pmod(odd + even + at(9), F.lit(10)) == at(10)))


def vkn_check_digit(nine: Column) -> Column:
    """Check digit of the first nine digits of a tax number."""
    d = _digits(nine)
    terms = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: _vkn_term((F.element_at(d, i + 1) + 9 - i) % 10, i))
    return (10 - F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10) % 10


def _vkn_term(t: Column, i: Column) -> Column:
    v = (t * F.shiftleft(F.lit(1), 9) / F.pow(F.lit(2.0), i)).cast("int") % 9
    return F.when((t != 0) & (v == 0), F.lit(9)).otherwise(v)


def vkn(text: Column) -> Column:
    """Tax number of ten digits whose last is its check digit."""
    return _when_shaped(text, "^[0-9]{10}$", vkn_check_digit(F.substring(text, 1, 9)) == F.substring(text, 10, 1).cast("int"))


def iban_tr(text: Column) -> Column:
    """TR account number of 26 characters with remainder 1 by 97; spaces and case don't matter."""
    clean = F.upper(F.regexp_replace(text, " ", ""))
    number = F.concat(F.substring(clean, 5, 22), F.lit("2927"), F.substring(clean, 3, 2)).cast("decimal(38,0)")
    return _when_shaped(clean, "^TR[0-9]{24}$", number % 97 == 1)


def mrz_check_digit(text: Column) -> Column:
    """Check digit of a machine-readable field: weights 7, 3, 1 over digits, letters from 10 on and ``<`` as 0."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    value = lambda c: F.when(c == "<", 0).when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    weight = lambda i: F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i % 3 + 1).cast("int"))
    return F.aggregate(F.transform(chars, lambda c, i: value(c) * weight(i)), F.lit(0), lambda a, x: a + x) % 10


def ipv4(text: Column) -> Column:
    """Four numbers up to 255."""
    return _when_shaped(text, r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$", F.forall(F.split(text, r"\."), lambda p: p.cast("int") <= 255))


def age_contradicts(age: Column, birth: Column, year: int = 2026) -> Column:
    """Whether an age differs by more than two years from a birth date that ends in its year; unreadable values don't."""
    born = F.substring(birth, -4, 4).try_cast("int")
    return F.coalesce(F.abs(F.lit(year) - born - age.try_cast("int")) > 2, F.lit(False))


def imei(text: Column) -> Column:
    """Fifteen digits that pass the Luhn check."""
    return _when_shaped(text, "^[0-9]{15}$", luhn(text))


def province(code: Column) -> Column:
    """Number of the province (1 to 81) that a postal code of five digits or a plate begins with, or null."""
    first = F.regexp_extract(F.coalesce(code, F.lit("")), r"^([0-9]{2})(?:[0-9]{3}$| ?[A-Z]{1,3} ?[0-9]{2,4}$)", 1).try_cast("int")
    return F.when(first.between(1, 81), first)


def mrz_line(document: Column, birth: Column, expiry: Column) -> Column:
    """A machine-readable line: number of nine, birth and expiry date of six digits, each with its check digit, and one over all three."""
    fields = [F.rpad(F.upper(F.regexp_replace(document, "[^A-Za-z0-9]", "<")), 9, "<"), birth, expiry]
    checked = F.concat(*(F.concat(f, mrz_check_digit(f).cast("string")) for f in fields))
    return F.concat(checked, mrz_check_digit(checked).cast("string"))


def fits_rule(value: Column, kind: Column, rules: dict[str, tuple[str, int, int, int, int]]) -> Column:
    """Whether ``value`` fits the rule of its ``kind``: pattern, least and most characters, least and most words; unknown kinds never."""
    v = F.trim(F.coalesce(value, F.lit("")))
    n = F.when(v == "", 0).otherwise(F.size(F.split(v, r"\s+")))
    out = F.when(F.lit(False), F.lit(False))
    for name, (pattern, low, high, few, many) in rules.items():
        out = out.when(kind == name, v.rlike(pattern) & F.length(v).between(low, high) & n.between(few, many))
    return out.otherwise(F.lit(False))


def tempered(p: Column, heat: float) -> Column:
    """Probability ``p`` with its logit divided by ``heat``; 0 and 1 stay."""
    return F.when((p <= 0) | (p >= 1), p).otherwise(1 / (1 + F.exp(-(F.log(p) - F.log(1 - p)) / heat)))
