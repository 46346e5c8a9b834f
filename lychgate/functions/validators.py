"""Checksum and plausibility tests as Column -> Column expressions.

Each takes the text of a match and is true or false, never null for a text that is not null.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, check letters and tables that the identifier schemes prescribe.
NRIC_WEIGHTS = (2, 7, 6, 5, 4, 3, 2)
NRIC_TABLES = {"ST": "JZIHGFEDCBA", "FG": "XWUTRQPNMLK", "M": "KLJNPQRTUWX"}
TFN_WEIGHTS = (1, 4, 3, 7, 5, 8, 6, 9, 10)
ABN_WEIGHTS = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
MEDICARE_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9)
MY_NUMBER_WEIGHTS = (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _decimal_digits() -> tuple[str, str]:
    """All decimal digits of all scripts beyond ASCII, and what they stand for."""
    found = [(chr(c), str(unicodedata.decimal(chr(c)))) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


_OTHER_DIGITS, _ASCII_DIGITS = _decimal_digits()


def ascii_digits(value: Column) -> Column:
    """Digits of any script as ASCII ones."""
    return F.when(F.octet_length(value) == F.length(value), value).otherwise(F.translate(value, _OTHER_DIGITS, _ASCII_DIGITS))


def without(value: Column, chars: str) -> Column:
    return F.translate(ascii_digits(value), chars, "")


def digit(value: Column, k: int) -> Column:
    """The k-th digit (from 0) as a number."""
    return F.substring(value, k + 1, 1).cast("int")


def weighted(value: Column, weights: tuple[int, ...]) -> Column:
    """The sum of digits times weights, as a balanced tree: deep expressions cost stack."""
    terms = [digit(value, k) * w for k, w in enumerate(weights)]
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) - len(terms) % 2 :]
    return terms[0]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value made once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def guarded(shape: Column, test: Column) -> Column:
    """test is only evaluated where the shape is right, so that no cast can fail."""
    return F.coalesce(F.when(shape, test), F.lit(False))


def not_all_alike(value: Column) -> Column:
    return value != F.repeat(F.substring(value, 1, 1), F.length(value))


def luhn(value: Column) -> Column:
    return let(without(value, " -"), lambda d: guarded(d.rlike(r"\A[0-9]{13,}\z"), not_all_alike(d) & F.call_function("luhn_check", d)))


def sg_nric(value: Column) -> Column:
    return let(F.upper(ascii_digits(value)), _sg_nric)


def _sg_nric(v: Column) -> Column:
    prefix = F.substring(v, 1, 1)
    total = weighted(F.substring(v, 2, 7), NRIC_WEIGHTS) + F.when(prefix.isin("T", "G"), 4).when(prefix == "M", 3).otherwise(0)
    table = F.when(prefix.isin("S", "T"), NRIC_TABLES["ST"]).when(prefix.isin("F", "G"), NRIC_TABLES["FG"]).otherwise(NRIC_TABLES["M"])
    return guarded(v.rlike(r"\A[STFGM][0-9]{7}.\z"), table.substr((total % 11 + 1).cast("int"), F.lit(1)) == F.substring(v, 9, 1))


def hk_hkid(value: Column) -> Column:
    return let(F.upper(ascii_digits(value)), lambda raw: let(F.translate(raw, "()", ""), lambda v: _hk_hkid(raw, v)))


def _hk_hkid(raw: Column, v: Column) -> Column:
    letters = F.length(v) - 7
    first, second = F.ascii(v) - 55, F.ascii(F.substring(v, 2, 1)) - 55
    lead = F.when(letters == 1, 36 * 9 + first * 8).otherwise(first * 9 + second * 8)
    total = lead + weighted(v.substr(letters + 1, F.lit(6)), (7, 6, 5, 4, 3, 2))
    rest = (11 - total % 11) % 11
    check = F.when(rest == 10, "A").otherwise(rest.cast("string"))
    shape = raw.rlike(r"\A[A-Z]{1,2}[0-9]{6}\(?[0-9A]\)?\z")
    return guarded(shape, check == F.right(v, F.lit(1)))


def jp_my_number(value: Column) -> Column:
    check = lambda d: let(weighted(d, MY_NUMBER_WEIGHTS) % 11, lambda rest: digit(d, 11) == F.when(rest <= 1, 0).otherwise(11 - rest))
    return let(without(value, " -"), lambda d: guarded(d.rlike(r"\A[0-9]{12}\z"), not_all_alike(d) & check(d)))


def au_tfn(value: Column) -> Column:
    return let(without(value, " -"), lambda d: guarded(d.rlike(r"\A[0-9]{9}\z"), weighted(d, TFN_WEIGHTS) % 11 == 0))


def au_abn(value: Column) -> Column:
    return let(without(value, " "), lambda d: guarded(d.rlike(r"\A[1-9][0-9]{10}\z"), (weighted(d, ABN_WEIGHTS) - ABN_WEIGHTS[0]) % 89 == 0))


def au_medicare(value: Column) -> Column:
    return let(without(value, " /"), lambda d: guarded(d.rlike(r"\A[2-6][0-9]{9,10}\z"), weighted(d, MEDICARE_WEIGHTS) % 10 == digit(d, 8)))


def iban(value: Column) -> Column:
    return let(without(F.upper(value), " "), _iban)


def _iban(v: Column) -> Column:
    turned = F.concat(v.substr(F.lit(5), F.length(v)), F.substring(v, 1, 4))
    # 34 characters overflow a long: the remainder is carried along
    step = lambda acc, c: F.when(c <= "9", (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))
    return guarded(v.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\z"), rest == 1)


def ipv4(value: Column) -> Column:
    v = ascii_digits(value)
    return guarded(v.rlike(r"\A[0-9]{1,9}(\.[0-9]{1,9}){3}\z"), F.forall(F.split(v, r"\."), lambda p: p.cast("int") <= 255))


def us_ssn(value: Column) -> Column:
    return let(without(value, "- "), _us_ssn)


def _us_ssn(d: Column) -> Column:
    area, group, serial = F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)
    return guarded(d.rlike(r"\A[0-9]{9}\z"), ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000"))


def phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"(?U)\D", "")).between(8, 15)


def date_of_birth(value: Column) -> Column:
    """A real calendar date, day first, ISO, or with the month's name or first three letters; years 1 to 9999."""
    return let(ascii_digits(value), _date_of_birth)


def _real(year: Column, month: Column, day: Column) -> Column:
    """Whether there is such a day, told by arithmetic: a failing parse costs an exception a value."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return (year > 0) & month.between(1, 12) & (day >= 1) & (day <= days)


def _date_of_birth(v: Column) -> Column:
    number = lambda p, k: F.element_at(p, k).cast("int")
    # two-digit years: 69 to 99 are of the last century, which matters for 29 February alone: 2000 and 1900 differ, and
    # neither 1969 to 1999 nor 2000 to 2068 holds a century year that is no leap year
    year_of = lambda p: number(p, 3) + F.when(F.length(F.element_at(p, 3)) == 2, 2000).otherwise(0)
    day_first = lambda p: _real(year_of(p), number(p, 2), number(p, 1))
    shape = lambda sep: v.rlike(rf"\A[0-9]{{1,2}}{sep}[0-9]{{1,2}}{sep}([0-9]{{4}}|[0-9]{{2}})\z")
    months = F.create_map(*[F.lit(x) for k, name in enumerate(MONTHS) for word in dict.fromkeys((name[:3], name)) for x in (word, k + 1)])
    named = lambda p: F.coalesce(_real(number(p, 3), F.try_element_at(months, F.lower(F.element_at(p, 2))), number(p, 1)), F.lit(False))
    return F.coalesce(
        F.when(shape("/"), let(F.split(v, "/"), day_first))
        .when(shape("-"), let(F.split(v, "-"), day_first))
        .when(v.rlike(r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), let(F.split(v, "-"), lambda p: _real(number(p, 1), number(p, 2), number(p, 3))))
        .when(v.rlike(r"\A[0-9]{1,2} [A-Za-z]+ [0-9]{4}\z"), let(F.split(v, " "), named)),
        F.lit(False),
    )
