"""Tolerant date functions: bad text gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rfc2822(c: Column) -> Column:
    """`Mon, 02 Jan 2024 03:04:05 +0900`, the weekday optional."""
    return F.try_to_timestamp(F.trim(F.regexp_replace(c, "^[A-Za-z]{3},", "")), F.lit("d MMM yyyy HH:mm:ss Z"))


def iso(c: Column) -> Column:
    """ISO text with or without an offset; without one it counts as UTC. Words like today, which Spark would read, are no dates."""
    return F.when(F.trim(c).rlike("^[0-9]{4}"), F.try_to_timestamp(F.trim(c)))


def compact_date(c: Column) -> Column:
    """The first eight digits of the text as a date."""
    return F.try_to_date(F.nullif(F.substring(F.regexp_replace(c, "[^0-9]", ""), 1, 8), F.lit("")), "yyyyMMdd")


def dotted_date(c: Column) -> Column:
    """yyyy.m.d, yyyy-m-d, yyyy/m/d or with year, month and day marks."""
    parts = [F.regexp_extract(c, r"([0-9]{4})\s*[.년/-]\s*([0-9]{1,2})\s*[.월/-]\s*([0-9]{1,2})", i) for i in (1, 2, 3)]
    return F.try_to_date(F.concat(parts[0], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[2], 2, "0")), "yyyy-MM-dd")


def any_date(c: Column) -> Column:
    return F.coalesce(dotted_date(c), compact_date(c))


def year_of(c: Column) -> Column:
    """The first year from 1900 to 2099 in the text."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), "((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")


def era_year(era: Column, year: Column) -> Column:
    """Japanese eras to Gregorian years: Showa, Heisei, Reiwa."""
    return year + F.when(era == "昭", 1925).when(era == "平", 1988).when(era == "令", 2018)


def older_than(published: Column, now: Column, days: int) -> Column:
    """False where the date is missing."""
    return F.coalesce(now - published > F.make_dt_interval(F.lit(days)), F.lit(False))
