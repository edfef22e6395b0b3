"""Scalar columns: lenient parsing, rounding, division, labels and dates. No Python runs per row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """IEEE division: by zero gives inf, -inf or nan instead of an ANSI error; null if either side is null."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a == 0, F.lit(float("nan")))
    return F.when(b == 0, F.when(F.isnan(a), a).otherwise(at_zero)).otherwise(a / F.when(b != 0, b))


def round_to(x: Column, digits: int = 0, half_even: bool = False) -> Column:
    """Round a scaled double, half away from zero (or half to even), so that no decimal arithmetic interferes."""
    scale = float(10**digits)
    whole = F.bround if half_even else F.round
    return whole(x * scale, 0) / scale if digits else whole(x, 0)


def strip(x: Column) -> Column:
    """Drop all Unicode white space at both ends."""
    return F.regexp_replace(x.cast("string"), r"(?U)^\s+|\s+$", "")


def replace_first(x: Column, what: str, by: str) -> Column:
    """Replace the first occurrence only."""
    at = F.instr(x, what)
    return F.when(at > 0, F.overlay(x, F.lit(by), at, F.lit(len(what)))).otherwise(x)


def to_number(x: Column) -> Column:
    """Text to double: commas and the currency mark go, anything else that is no plain number is null."""
    text = strip(F.replace(F.replace(x.cast("string"), F.lit(","), F.lit("")), F.lit("AED"), F.lit("")))
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def _iso_day(ten: Column) -> Column:
    """The date of text of the shape 2026-03-01; the shape is tested first, since parsing that fails is slow. There is no year 0."""
    return F.when(ten.rlike(r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}$"), ten).try_cast("date")


def to_day(x: Column) -> Column:
    """Text to date: the first ten characters, year or day first, whatever time follows; else null."""
    ten = F.substring(strip(x), 1, 10)
    day_first = F.when(ten.rlike(r"^[0-9]{2}([-/])[0-9]{2}\1[0-9]{4}$"), F.concat_ws("-", F.substring(ten, 7, 4), F.substring(ten, 4, 2), F.substring(ten, 1, 2)))
    return _iso_day(F.coalesce(day_first, ten))


def day_text(day: Column) -> Column:
    """2026-03-01; a cast, which takes far less than a format."""
    return day.cast("date").cast("string")


def day_of(text: Column, strict: bool = False) -> Column:
    """The date of canonical date text, of which the first ten characters count; null if it is none, or an error if strict (null stays null)."""
    day = _iso_day(F.substring(text, 1, 10))
    return F.when(text.isNotNull() & day.isNull(), F.raise_error(F.concat(F.lit("not a date: "), text)).cast("date")).otherwise(day) if strict else day


def week_of(day: Column) -> Column:
    """Monday of the week."""
    return F.trunc(day, "week")


def room_label(x: Column) -> Column:
    text = strip(x)
    return F.when(F.lower(text) == "studio", "Studio").when(text.rlike(r"(?U)^\d+$"), F.concat(text, F.lit(" B/R"))).otherwise(text)


def bedroom(rooms: Column) -> Column:
    """`2 B/R` becomes `2BR`."""
    return replace_first(rooms, " B/R", "BR")


def direction(x: Column) -> Column:
    """down below zero, else up; null counts as up."""
    return F.when(x < 0, "down").otherwise("up")


def title_case(x: Column) -> Column:
    """Upper-case the first letter of each run of letters, lower-case the others."""
    parts = F.split(F.lower(x), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))), "")


def months_earlier(day: Column, months: int) -> Column:
    """The same day some months before, clamped to the month's length."""
    if months < 0:
        raise ValueError("months must not be negative")
    return F.add_months(day, -months)


def same_month_last_year(day: Column) -> Column:
    """Day 1 of the month a year before."""
    return F.trunc(F.add_months(day, -12), "month")


def same_day_ago(day: dt.date, months: int) -> dt.date:
    """months_earlier() for the driver: back from one month's first day to the one before, then as far into it as it goes."""
    if months < 0:
        raise ValueError("months must not be negative")
    first, one = day.replace(day=1), dt.timedelta(days=1)
    for _ in range(months):
        first = (first - one).replace(day=1)
    following = (first + 31 * one).replace(day=1)
    return min(first + (day.day - 1) * one, following - one)


def last_months(months: int = 4, as_of: dt.date | None = None) -> tuple[dt.date, dt.date]:
    end = as_of or dt.date.today()
    return same_day_ago(end, months), end
