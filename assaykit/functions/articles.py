"""Texts of news articles: what is no article, clean lines and titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..config import ARTICLE_LEAST_CHARS, BOILERPLATE, BYLINES, NOISE_MOST_SHARE, NOISE_WORDS, PORTALS
from . import text
from .patents import let, lines_of, once


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


@once
def is_boilerplate(c: Column) -> Column:
    """A line of an article that tells nothing: short, of the site itself, or a reporter's name."""
    byline = reduce(lambda a, b: a | b, [F.lower(c).rlike(p) for p in BYLINES])
    return (F.length(c) < 20) | (text.hits(c, BOILERPLATE) > 0) | byline


def clean_article(c: Column) -> Column:
    """Squeezed lines without boilerplate."""
    return F.array_join(F.filter(F.transform(lines_of(c), squeezed), lambda x: (x != "") & ~is_boilerplate(x)), "\n")


def joined_paragraphs(paragraphs: Column) -> Column:
    """Distinct paragraphs without boilerplate, as one text."""
    return F.array_join(F.array_distinct(F.filter(F.transform(paragraphs, squeezed), lambda x: (x != "") & ~is_boilerplate(x))), "\n")


@once
def is_noise(line: Column) -> Column:
    return (text.hits(line, NOISE_WORDS) > 0) | (F.length(F.regexp_replace(line, "[^가-힣a-zA-Z0-9]", "")) < 20)


def is_article(c: Column) -> Column:
    """Long enough, and few of its lines noise."""
    lines = F.filter(lines_of(c), lambda x: F.trim(x) != "")
    few = let(lines, lambda every: (F.size(every) > 0) & (F.size(F.filter(every, is_noise)) <= NOISE_MOST_SHARE * F.size(every)))
    return (F.length(F.coalesce(c, F.lit(""))) >= ARTICLE_LEAST_CHARS) & few


def clean_title(c: Column) -> Column:
    """A title without the portal's name, and if it is long without a short name behind a dash, bar or colon; null below five characters."""
    plain = F.regexp_replace(squeezed(c), rf"(?i)\s*[-|:]\s*({'|'.join(PORTALS)})\s*$", "")
    cut = lambda x: F.when(F.length(x) > 45, F.trim(F.regexp_replace(x, r"\s*[-|:]\s*[가-힣A-Za-z0-9_. ]{2,30}\s*$", ""))).otherwise(x)
    return let(let(plain, cut), lambda x: F.when(F.length(x) >= 5, x))
