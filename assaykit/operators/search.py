"""Queries for outside evidence: companies and products put into them, other languages kept out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import BLANK_COMPANIES, INDUSTRY_KEYWORDS, COMMON_INDUSTRY, JOINT_MARKS, ORGANISATION_MARKS
from ..functions import text
from ..functions.patents import let, once
from .matching import label_of

MOST_QUERIES = 5


def _distinct(values: Column) -> Column:
    squeezed = F.transform(values, lambda q: F.trim(F.regexp_replace(F.coalesce(q, F.lit("")), r"\s+", " ")))
    return F.array_distinct(F.filter(squeezed, lambda q: q != ""))


def company(c: Column) -> Column:
    """A company's name with single spaces; empty for words that mean none."""
    return let(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), lambda x: F.when(F.lower(x).isin(*BLANK_COMPANIES), "").otherwise(x))


def is_joint(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(*JOINT_MARKS)


@once
def is_individual(c: Column) -> Column:
    """An applicant without any mark of an organisation, or none at all."""
    name = F.trim(F.coalesce(c, F.lit("")))
    return (name == "") | ~F.upper(name).rlike("|".join(m.replace("(", "[(]").replace(")", "[)]").replace(".", "[.]") for m in ORGANISATION_MARKS))


def company_query(name: Column, product: Column, *fields: Column) -> Column:
    """The company with its product, else with the first of the fields that is there, else alone."""
    return F.concat_ws(" ", name, text.first_present(product, *fields))


def english(queries: Column, most: int = MOST_QUERIES) -> Column:
    """Queries without hangul, letters, digits and spaces only, distinct."""
    kept = F.filter(queries, lambda q: (F.coalesce(q, F.lit("")) != "") & ~q.rlike("[가-힣ㄱ-ㅎㅏ-ㅣ]"))
    return F.slice(_distinct(F.transform(kept, lambda q: F.regexp_replace(q, r"[^0-9A-Za-z\s]", " "))), 1, most)


def with_product(queries: Column, product: Column, previous: Column, most: int = MOST_QUERIES) -> Column:
    """Queries with one that names the product: unchanged if one does; a new wording in the last place, or the first wording where there is no query at all."""
    p = F.trim(F.coalesce(product, F.lit("")))
    wordings = F.array(*(F.concat(p, F.lit(x)) for x in (" 시장 동향", " 기술 적용", " 기업 동향", "")))
    known = F.concat(queries, previous)
    fresh = F.get(F.filter(wordings, lambda w: ~F.array_contains(known, w)), F.lit(0))
    chosen = F.coalesce(fresh, F.when(F.size(queries) == 0, wordings[0]))
    grown = F.slice(_distinct(F.concat(F.when(F.size(queries) < most, queries).otherwise(F.slice(queries, 1, max(most - 1, 0))), F.array(chosen))), 1, most)
    there = (p == "") | F.exists(queries, lambda q: F.contains(q, p))
    return F.when(there | chosen.isNull(), queries).otherwise(grown)


def with_applicants(queries: Column, previous: Column, owner: Column, owner_query: Column, joint: Column, joint_query: Column, most: int = MOST_QUERIES) -> Column:
    """Queries with one for the owner and one for the joint applicant, unless one names them or was asked before; others leave at the end to make room."""

    def of(known: Column) -> Column:
        wanted = lambda name, q: F.when((F.coalesce(name, F.lit("")) != "") & (F.coalesce(q, F.lit("")) != "") & ~F.array_contains(previous, q) & ~F.exists(known, lambda k: F.contains(k, name)), q)
        new = F.filter(F.array(wanted(owner, owner_query), wanted(joint, joint_query)), lambda q: q.isNotNull())
        return let(new, lambda n: F.slice(F.array_distinct(F.concat(F.slice(known, F.lit(1), F.greatest(F.least(F.size(known), most - F.size(n)), F.lit(0))), n)), 1, most))

    return let(_distinct(queries), of)


def rewritten(given: Column, product: Column, previous: Column, most: int = 2) -> Column:
    """A model's variants that are neither the product's name nor asked before."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.slice(F.filter(_distinct(given), lambda q: ((low(product) == "") | (low(q) != low(product))) & ~F.array_contains(previous, q)), 1, most)


def industries(*fields: Column) -> Column:
    """The industries to search for a target: its own and the common one; null (no filter) where none is told."""
    words = F.concat_ws(" ", *fields)
    own = let(words, lambda w: label_of({k: text.word_hits(w, ws) for k, ws in INDUSTRY_KEYWORDS.items()}))
    return let(own, lambda x: F.when(x.isNotNull(), F.array(x, F.lit(COMMON_INDUSTRY))))
