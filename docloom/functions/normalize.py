"""Normalisers of extracted values, as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import confusions

# --- fixed values -------------------------------------------------------------
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
DIGIT_CONFUSIONS = [("O", "0"), ("I", "1"), ("T", "1"), ("Q", "0")]
MONTH_CONFUSIONS = [("0C1", "OCT"), ("N0V", "NOV"), ("0CT", "OCT")]
# Carriers as they are named on papers and the code before their flight numbers.
CARRIERS = [("东航", "MU"), ("南航", "CZ"), ("厦航", "MF"), ("海航", "HU")]
# Letters of which no two follow one another in a spelt name, ends that belong to
# the name after, and titles.
NEVER_TWO = ("L", "T", "F", "H")
PULLED_BACK = ("ZHA", "ZH")
TITLES = ("MS", "MR")
# ------------------------------------------------------------------------------


def first_run(value: Column, pattern: str) -> Column:
    """The first run that matches, else the value unchanged."""
    run = F.regexp_extract(value, f"({pattern})", 1)
    return F.when(run != "", run).otherwise(value)


def date_run(value: Column) -> Column:
    """First run of date characters; values of up to two characters are emptied."""
    v = first_run(value, r"[\p{Nd}./:：,^年月日时分秒点-]+")
    return F.when(F.length(v) <= 2, F.lit("")).otherwise(v)


def admission_number(value: Column) -> Column:
    return first_run(value, r"[\p{Nd}A-Za-z+-]+")


def two_digits(s: Column) -> Column:
    """A zero before a single character, longer ones unchanged."""
    return F.when(F.length(s) == 1, F.concat(F.lit("0"), s)).otherwise(s)


def _iso(v: Column, otherwise: Column) -> Column:
    p = "([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})"
    y, m, d = (F.regexp_extract(v, p, i) for i in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, two_digits(m), two_digits(d))).otherwise(otherwise)


def discharge_date(value: Column, fixed: bool = False) -> Column:
    """Dots to dashes, first date zero-padded, else unchanged. Dates written with
    the words for year, month and day are only read when ``fixed``."""
    v = F.regexp_replace(value, "[年月]", "-") if fixed else value
    return _iso(F.replace(v, F.lit("."), F.lit("-")), value)


def imaging_date(value: Column) -> Column:
    """Without the time of day, separators to dashes, first date zero-padded."""
    v = F.regexp_replace(value, "[0-9]{1,2}:[0-9]{2}:[0-9]{2}", "")
    v = F.regexp_replace(v, "[年月日./]", "-")
    return _iso(v, v)


def flight_date(value: Column) -> Column:
    """Misread letters of a day-month-year; letters without a month are no date."""
    v = confusions(confusions(F.replace(value, F.lit(" "), F.lit("")), DIGIT_CONFUSIONS), MONTH_CONFUSIONS)
    return F.when(v.rlike("[A-Za-z]") & ~v.rlike("|".join(MONTHS)), F.lit("")).otherwise(v)


def flight_date_iso(value: Column) -> Column:
    """``12OCT2019`` to ``2019-10-12``, ``12OCT`` to ``10-12``: what follows the month,
    the month, what precedes it; blanks, colons and points are dashes. The month
    that comes first in the calendar counts, where it first stands."""
    v = F.regexp_replace(value, "[ :：.]", "-")
    out = v
    for i in reversed(range(12)):
        at = F.instr(v, F.lit(MONTHS[i]))
        year = F.substr(v, at + 3)
        iso = F.concat_ws("-", F.when(year != "", year), F.lit(f"{i + 1:02d}"), F.substr(v, F.lit(1), at - 1))
        out = F.when(at > 0, iso).otherwise(out)
    return out


def flight_number(value: Column, text: Column, carriers: list[tuple[str, str]] = CARRIERS) -> Column:
    """The code of the first carrier whose name stands in ``text``, as does its code
    with the digits of the value; else the value. With ideographs it is none."""
    digits = F.regexp_replace(value, r"[^\p{Nd}]", "")
    out = value
    for name, code in reversed(carriers):
        full = F.concat(F.lit(code), digits)
        out = F.when(F.contains(text, F.lit(name)) & F.contains(text, full), full).otherwise(out)
    return F.when(value.rlike("[一-龥]"), F.lit(None)).otherwise(out)


def flight_number_cut(value: Column) -> Column:
    """Without blanks, at most six characters."""
    return F.substring(F.replace(value, F.lit(" "), F.lit("")), 1, 6)


def without_letters(value: Column) -> Column:
    """Amounts without letters and blanks."""
    return F.regexp_replace(value, "[A-Za-z ]", "")


def is_amount_text(text: Column) -> Column:
    """Text that looks like an amount: a zero (or o) beside the point, no ideograph, no exponent."""
    low = F.lower(text)
    return low.rlike("\\.[0o]|[0o]\\.") & ~text.rlike("[一-龥]") & ~low.contains("e-")


def department(value: Column, text: Column, place: Column | None = None) -> Column:
    """Adds the bracket and then the ward word that follow the value in the text, and
    corrects a common misreading. ``place`` (from 1) is where the value stands."""
    at = F.instr(text, value) if place is None else place
    tail = F.when(at > 0, F.substr(text, at + F.length(value), F.lit(3)))
    bracket = F.when(F.substring(tail, 1, 1).isin(")", "）"), F.lit(")")).otherwise(F.lit(""))
    ward = F.when(tail.startswith("住院") & (tail != "住院号"), F.lit("住院")).otherwise(F.lit(""))
    return F.replace(F.concat(value, bracket, ward), F.lit("料"), F.lit("科"))


def name_near(value: Column, text: Column, cue: str = "姓名", reach: int = 50) -> Column:
    """Empty where the text has the cue but not within ``reach`` of the value."""
    at = F.instr(text, value) - 1
    start = F.greatest(at - reach, F.lit(0))
    around = F.substr(text, start + 1, F.length(value) + 2 * reach)
    return F.when(F.contains(text, F.lit(cue)) & ~F.contains(around, F.lit(cue)), F.lit("")).otherwise(value)


def bracketless(value: Column) -> Column:
    """Without bracketed matter; one character is no name."""
    return F.when(F.length(value) == 1, F.lit("")).otherwise(F.regexp_replace(value, "\\(.+\\)", ""))


def syllables_of(known: list[str]):
    """A function: leading known syllables of a word, longest first, until none fits.
    A syllable has two letters at least and is looked for up to one letter beyond
    six, or beyond the letters left."""
    listed = {k.lower() for k in known}

    def one(text: str) -> list[str]:
        rest, out = text.lower(), []
        while rest:
            most = min(6, len(rest)) + 1
            n = next((n for n in range(most, 1, -1) if rest[:n] in listed), 0)
            if not n:
                break
            out.append(rest[:n])
            rest = rest[n:]
        return out

    return one


def syllables(known: list[str]):
    """:func:`syllables_of` as a column function."""
    one = syllables_of(known)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(value: pd.Series) -> pd.Series:
        return value.map(lambda v: None if v is None else one(v))

    return split


def passenger_name(known: list[str]):
    """A column function of a value and the text it stands in: the passenger's name.

    The value is found again in the text, takes back letters that were cut off before
    it, takes in the title or the letter after it, is cut at letters that never follow
    one another, after a title and before ideographs, and loses the field word. Without
    a title, a given name (after the slash) that spells no known syllables to its end
    is cut to its first syllable, one of more than two syllables to two. One letter is
    no name (null); a value that the text does not hold, and null, stay."""
    cut_up = syllables_of(known)
    apart = re.compile("|".join(a + b for a in NEVER_TWO for b in NEVER_TWO))
    title = re.compile("|".join(TITLES))
    han = re.compile("[一-龥]")

    def one(value, text):
        if value is None or not value:
            return value
        text = (text or "").upper().replace("^", "")
        at = text.find(value)
        name = value
        if at >= 0:
            end = at + len(value)
            for lost in PULLED_BACK:
                if at >= len(lost) and text.endswith(lost, 0, at):
                    at -= len(lost)
            near = title.search(text[end : end + 4])
            if near:
                end += near.end()
            name = text[at:end]
            if name[-1] == "M" and end < len(text):
                name = text[at : end + 1]
            if name[0] == "U" and at:
                name = text[at - 1 : end]
        clash = apart.search(name)
        if clash:
            name = name[2:] if clash.start() == 0 else name[: clash.start()]
        name = name.replace("NAME", "")
        called = title.search(name)
        if called:
            name = name[: called.end()]
        name = han.split(name, maxsplit=1)[0]
        if len(name) == 1:
            return None
        parts = name.split("/")
        if len(parts) > 1 and parts[1] and not title.search(name):
            spelt = cut_up(parts[1])
            if "".join(spelt) != parts[1].lower():
                if spelt and spelt[0][0] == parts[1][0].lower():
                    name = parts[0] + "/" + spelt[0].upper()
            elif len(spelt) > 2:
                name = parts[0] + "/" + "".join(spelt[:2]).upper()
        return name.replace("+", "")

    @F.pandas_udf(T.StringType())
    def names(value: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([one(v, t) for v, t in zip(value, text)], dtype=object)

    return names
