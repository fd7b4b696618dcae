"""Numbers of publications, applications and registrations in their many spellings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .patents import let, once

_PARTS = "struct<country:string,number:string,kind:string>"


def _up(c: Column) -> Column:
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def _joined(sep: str, *parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), sep)


def _distinct(*values: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*values), lambda x: x.isNotNull() & (x != "")))


def publication_key(c: Column) -> Column:
    """CC-number-kind, or CC-number, from any spelling; null where there is none."""

    def of(x: Column) -> Column:
        part = lambda g: F.regexp_extract(x, r"\b([A-Z]{2})\s*-?\s*([0-9][0-9A-Z./-]*)\s*-?\s*([A-Z][0-9]?)?\b", g)
        return F.when(part(1) != "", _joined("-", part(1), F.regexp_replace(part(2), "[^0-9A-Z]+", ""), part(3)))

    return let(_up(c), of)


def publication_keys(country: Column, number: Column, kind: Column, *texts: Column) -> Column:
    """The keys under which a document may be known, the likeliest first: those in its texts, then its parts with and without the kind."""
    c, n, k = (F.trim(F.coalesce(x, F.lit(""))) for x in (country, number, kind))
    full = F.when((c != "") & (n != ""), F.concat_ws("-", c, n))
    return _distinct(*(publication_key(t) for t in texts), F.when(k != "", F.concat_ws("-", full, k)), full)


def reference_parts(c: Column) -> Column:
    """Country, digits and kind of a reference like `US 2010/0123456 A1`; null without a kind or digits."""

    def of(x: Column) -> Column:
        part = lambda g: F.regexp_extract(x, r"\b([A-Z]{2})\s*-?\s*([0-9][0-9A-Z./-]*)\s+([A-Z][0-9]?)\b", g)
        number = F.regexp_replace(part(2), "[^0-9]", "")
        return F.when(number != "", F.struct(part(1).alias("country"), number.alias("number"), part(3).alias("kind"))).cast(_PARTS)

    return let(_up(c), of)


def display_number(country: Column, number: Column, kind: Column, original: Column) -> Column:
    some = lambda x: F.coalesce(x, F.lit(""))
    return F.when((some(country) != "") & (some(number) != ""), _joined(" ", F.concat(country, number), some(kind))).otherwise(some(original))


def padded(c: Column) -> Column:
    """Digits of twelve places with the kind behind them, as archives file foreign literature; null without digits."""

    def of(x: Column) -> Column:
        part = lambda g: F.regexp_extract(x, r"\b[A-Z]{2}\s*-?\s*([0-9][0-9A-Z./-]*)\s*-?\s*([A-Z][0-9]?)?\b", g)
        number = F.regexp_replace(part(1), "[^0-9]", "")
        return F.when(number != "", F.concat(_zeros(number, 12), part(2)))

    return let(_up(c), of)


def _zeros(c: Column, places: int) -> Column:
    return F.when(F.length(c) >= places, c).otherwise(F.lpad(c, places, "0"))


def era_number(country: Column, number: Column, published: Column) -> Column:
    """A Japanese number of eight digits whose first two are the era's year of its publication, with the year instead; else null."""
    year = F.regexp_extract(F.coalesce(published.cast("string"), F.lit("")), "((?:19|20)[0-9]{2})", 1).try_cast("int")
    era = year - F.when(year >= 2019, 2018).when(year >= 1989, 1988)
    fits = (_up(country) == "JP") & number.rlike("^[0-9]{8}$") & (F.substring(number, 1, 2).try_cast("int") == era)
    return F.when(fits, F.concat(year.cast("string"), F.substring(number, 3, 6)))


def literature_numbers(country: Column, number: Column, kind: Column, published: Column, *texts: Column) -> Column:
    """The numbers under which archives may file a document: padded with its kind, by Japanese era, as spelled in its texts, and last without a kind."""
    digits = F.regexp_replace(F.coalesce(number, F.lit("")), "[^0-9]", "")
    with_kind = lambda n: F.when(n != "", F.concat(_zeros(n, 12), _up(kind)))
    return _distinct(with_kind(digits), with_kind(era_number(country, digits, published)), *(padded(t) for t in texts), F.when(digits != "", _zeros(digits, 12)))


def target_kinds(country: Column, value: Column, from_application: bool) -> Column:
    """Kinds to try for a number: its own, then those that its country uses for it."""
    own = F.regexp_extract(_up(value), r"\b([A-Z][0-9]?)\b\s*$", 1)
    c = _up(country)
    lists = lambda *k: _distinct(own, *map(F.lit, k))
    if from_application:
        return F.when(c == "CN", lists("A0")).otherwise(lists("A1", "A"))
    return F.when(c.isin("US", "JP"), lists("B2", "B1", "B")).when(c == "CN", lists("A0", "B0")).otherwise(lists("B2", "B"))


def target_digits(country: Column, value: Column, from_application: bool) -> Column:
    """Digits of a number; of Chinese applications without the check digit behind the point."""
    cut = F.substring_index(value, ".", 1) if from_application else value
    return F.regexp_replace(F.when(_up(country) == "CN", cut).otherwise(value), "[^0-9]", "")


def target_numbers(country: Column, registration: Column, application: Column) -> Column:
    """All pairs of number and kind to try for a target, as (number, kind, field): registrations first, but applications for China."""

    def pairs(value: Column, field: str) -> Column:
        number = target_digits(country, value, field == "application_number")
        made = F.transform(target_kinds(country, value, field == "application_number"), lambda k: F.struct(number.alias("number"), k.alias("kind"), F.lit(field).alias("field")))
        return F.when(F.coalesce(number, F.lit("")) != "", made).otherwise(F.array().cast("array<struct<number:string,kind:string,field:string>>"))

    r, a = pairs(registration, "registration_number"), pairs(application, "application_number")
    both = F.when(_up(country) == "CN", F.concat(a, r)).otherwise(F.concat(r, a))
    seen = lambda every: F.filter(every, lambda x, i: ~F.exists(F.slice(every, F.lit(1), i), lambda y: (y["number"] == x["number"]) & (y["kind"] == x["kind"])))
    return let(both, lambda b: F.when(F.size(b) > 0, seen(b)).otherwise(b))


def us_digits(c: Column) -> Column:
    """A US application publication's digits: the year and seven places."""
    return F.when(c.rlike("^(19|20)[0-9]{2}[0-9]{1,6}$"), F.concat(F.substring(c, 1, 4), _zeros(F.substring(c, 5, 6), 7))).otherwise(c)


def publication_id(country: Column, registration: Column, application: Column) -> Column:
    """The id under which a public archive shows the document: country, digits and kind; a registration without a kind is B2 in the US and Japan. All digits count, also those of a kind behind a space."""
    c = _up(country)
    registered = F.trim(F.coalesce(registration, F.lit(""))) != ""
    base = F.when(registered, _up(registration)).otherwise(_up(application))

    def of(base: Column) -> Column:
        tight = F.regexp_replace(base, "[^0-9A-Z]+", "")
        us = F.regexp_extract(tight, "^US([0-9]+)A[0-9]?$", 1)
        own = F.when((c == "US") & (us != ""), F.concat(F.lit("US"), us_digits(us), F.regexp_extract(tight, "^US[0-9]+(A[0-9]?)$", 1))).otherwise(tight)
        told = F.regexp_extract(base, r"\b([A-Z][0-9]?)\b\s*$", 1)
        kind = F.when(told != "", told).when(registered & c.isin("US", "JP"), "B2").otherwise("")
        digits = F.regexp_replace(base, "[^0-9]", "")
        plain = F.concat(c, F.when((c == "US") & kind.startswith("A"), us_digits(digits)).otherwise(digits), kind)
        return F.when((c == "") | (base == ""), F.lit(None).cast("string")).when(F.startswith(tight, c), own).when((c == "TW") & tight.startswith("I"), F.concat(F.lit("TW"), tight)).otherwise(plain)

    return let(base, of)


@once
def without_register_suffix(c: Column) -> Column:
    """A registration number without the four digits of its right's part."""
    bare = F.regexp_replace(F.trim(c), "-[0-9]{4}$", "")
    return F.nullif(F.when(bare.rlike("^[0-9]{13}$"), F.substring(bare, 1, 9)).otherwise(bare), F.lit(""))


def application_spellings(c: Column) -> Column:
    """Digits only, then as written with single spaces, the first of each."""
    value = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " ")
    return _distinct(F.regexp_replace(value, "[^0-9]", ""), value)


def int_or_null(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))
