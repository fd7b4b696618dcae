"""Claims out of running texts of foreign documents, as OCR or an archive gives them.

Columns over arrays of lines: a text is taken apart within its row, by the first way of numbering that it has any line of.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import (
    CLAIM_DESCRIPTION_MOST, FOREIGN_CLAIM_LEAST, FOREIGN_CLAIM_MARKERS, FOREIGN_CLAIM_MOST, FOREIGN_CLAIM_NOISE, FOREIGN_CLAIM_STARTS, FOREIGN_DEPENDENCIES, FOREIGN_MISREAD_ONE, FOREIGN_PAGE_END, JAPANESE_DEPENDENCY, JAPANESE_OWN_THING,
)
from . import text
from .arrays import runs
from .patents import filled, fullwidth_digits, let, lines_of


def claims_section(c: Column) -> Column:
    """What follows the earliest mark of claims; the whole text without one."""

    def of(x: Column) -> Column:
        def end(pattern: str) -> Column:
            return let(F.regexp_extract(x, rf"(?Uis)^(.*?(?m:{pattern}))", 1), lambda head: F.when(head != "", F.length(head)))

        ends = F.array_compact(F.array(*map(end, FOREIGN_CLAIM_MARKERS)))
        return let(ends, lambda e: F.when(F.size(e) > 0, F.substring(x, F.array_min(e) + 1, F.length(x))).otherwise(x))

    return let(F.coalesce(c, F.lit("")), of)


def claim_body(lines: Column) -> Column:
    """Lines of a claim as one text, without images, page marks, fences and numbers of pages; a claim 1 that was read as a letter is mended."""
    plain = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))), lambda x: (x != "") & ~x.rlike("(?U)" + "|".join(f"(?:{p})" for p in FOREIGN_CLAIM_NOISE)))
    joined = F.trim(F.regexp_replace(F.array_join(plain, " "), r"(?U)\s+", " "))
    return F.regexp_replace(joined, FOREIGN_MISREAD_ONE, "$1 1")


def dependency(body: Column) -> Column:
    """The claim that a claim refers to, in English, Chinese or Japanese; null for one that stands alone."""
    tight = F.regexp_replace(body, r"(?U)\s+", "")
    found = lambda x, pattern: filled(fullwidth_digits(F.regexp_extract(x, "(?Ui)" + pattern, 1)))
    first = F.coalesce(*(found(body, p) for p in FOREIGN_DEPENDENCIES), found(tight, JAPANESE_DEPENDENCY))
    return F.when(~tight.rlike("(?Uds)^" + JAPANESE_OWN_THING), first.cast("int"))


def foreign_claims(c: Column) -> Column:
    """An array of claim_no, text, is_independent, dependency, by number: the first of each number that has 20 characters or more."""

    def by(pattern: str, lines: Column) -> Column:
        starts = lambda x: F.regexp_like(x, F.lit("(?U)" + pattern))
        # what stands before the first numbered line is no claim
        parts = F.filter(runs(lines, lambda xs, i: starts(F.get(xs, i))), lambda part: starts(F.get(part, F.lit(0))))

        def claim(part: Column, last: Column) -> Column:
            head = F.get(part, F.lit(0))
            rest = F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0)))
            page = F.filter(F.transform(rest, lambda x, i: F.when(F.regexp_like(x, F.lit("(?U)" + FOREIGN_PAGE_END)), i)), lambda i: i.isNotNull())
            kept = F.when(last & (F.size(page) > 0), F.slice(rest, F.lit(1), F.get(page, F.lit(0)))).otherwise(rest)
            body = claim_body(F.concat(F.array(F.regexp_extract(head, "(?U)" + pattern, 2)), kept))
            number = F.regexp_extract(head, "(?U)" + pattern, 1).cast("int")
            return let(F.struct(number.alias("claim_no"), body.alias("body")), lambda x: let(dependency(x["body"]), lambda d: F.struct(x["claim_no"], F.substring(x["body"], 1, FOREIGN_CLAIM_MOST).alias("text"), d.isNull().alias("is_independent"), d.alias("dependency"))))

        every = let(parts, lambda ps: F.transform(ps, lambda part, i: claim(part, i == F.size(ps) - 1)))
        long = F.filter(every, lambda x: F.length(x["text"]) >= FOREIGN_CLAIM_LEAST)
        placed = let(long, lambda xs: F.array_sort(F.transform(xs, lambda x, i: F.struct(x["claim_no"].alias("n"), i.alias("i"), x.alias("claim")))))
        firsts = F.transform(runs(placed, lambda xs, i: F.get(xs, i)["n"] != F.get(xs, i - 1)["n"]), lambda run: F.get(run, F.lit(0))["claim"])
        return firsts

    def of(lines: Column) -> Column:
        any_ = lambda p: F.exists(lines, lambda x: F.regexp_like(x, F.lit("(?U)" + p)))
        found = F.when(F.lit(False), by(FOREIGN_CLAIM_STARTS[0], lines))
        for p in FOREIGN_CLAIM_STARTS:
            found = found.when(any_(p), by(p, lines))
        return F.coalesce(found, F.slice(by(FOREIGN_CLAIM_STARTS[0], F.array(F.lit(""))), 1, 0))

    return let(lines_of(claims_section(c)), of)


def claims_and_representative(claims: Column, representative: Column) -> Column:
    """All claims, then the representative one, as one text of 12,000 characters at most; blank ones are left out."""
    return F.substring(F.concat_ws("\n\n", text.present(claims), text.present(representative)), 1, CLAIM_DESCRIPTION_MOST)
