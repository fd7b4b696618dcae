"""Evidence from a company's own sites: queries for a target, candidates with reasons, scores, and the final choice.

The company's domains, brand and media are arguments. A target is given by columns: product, title, business and technology area.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import BROAD_TERMS, DOMAIN_PROFILES, FOREIGN_PATH_WORDS, PARTICLES, SKIPPED_FILES, TITLE_STOPWORDS
from ..functions import text
from ..functions.patents import let, once
from . import filters


def _low(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _distinct(*values: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*values), lambda x: x.isNotNull() & (x != "")))


def first_of(row: DataFrame | None, *aliases: Column) -> Column:
    """A target's field under the first of its names that holds anything, else empty."""
    return F.coalesce(text.first_present(*aliases), F.lit(""))


def compact(*parts: Column) -> Column:
    """Distinct non-empty parts with single spaces between them."""
    return F.array_join(_distinct(*(F.trim(F.coalesce(p, F.lit(""))) for p in parts)), " ")


def without_site(query: Column) -> Column:
    """A query without its site: words."""
    return F.array_join(F.filter(F.split(F.trim(F.coalesce(query, F.lit(""))), r"\s+"), lambda w: ~F.lower(w).startswith("site:") & (w != "")), " ")


def title_keywords(title: Column, most: int = 4, stopwords: tuple[str, ...] = TITLE_STOPWORDS) -> Column:
    """The first distinct words of two characters or more that are no stop words."""
    words = F.regexp_extract_all(F.regexp_replace(F.coalesce(title, F.lit("")), r"[^0-9a-zA-Z가-힣\s]", " "), F.lit("([0-9a-zA-Z가-힣]{2,})"), 1)
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(*stopwords))), 1, most)


@once
def without_particle(word: Column) -> Column:
    """A Korean word without the first particle that it ends with, where more than one character stays before it."""
    cut = [F.when((F.length(word) > len(p) + 1) & word.endswith(p), F.substring(word, F.lit(1), F.length(word) - len(p))) for p in PARTICLES]
    return F.coalesce(*cut, word)


def profiles(product: Column, title: Column, business: Column, technology: Column) -> Column:
    """The names of the domains whose triggers the target's fields contain."""
    words = _low(F.concat_ws(" ", product, title, business, technology))
    return let(words, lambda w: F.filter(F.array(*(F.when(text.hits(w, p["triggers"]) > 0, n) for n, p in DOMAIN_PROFILES.items())), lambda x: x.isNotNull()))


def _of_profiles(names: Column, what: str) -> Column:
    lists = F.flatten(F.array(*(F.when(F.array_contains(names, n), F.array(*map(F.lit, p[what]))).otherwise(F.array().cast("array<string>")) for n, p in DOMAIN_PROFILES.items())))
    return F.array_distinct(lists)


def strong_terms(product: Column, keywords: Column, technology: Column, most: int = 8) -> Column:
    every = F.filter(F.concat(F.array(F.trim(F.coalesce(product, F.lit("")))), keywords, F.array(F.trim(F.coalesce(technology, F.lit(""))))), lambda x: (x != "") & ~F.lower(x).isin(*BROAD_TERMS))
    return F.slice(F.array_distinct(every), 1, most)


def queries(product: Column, title: Column, business: Column, technology: Column, *, domain: str, brand: str, given: Column | None = None, most: int = 5) -> Column:
    """Search queries for a target, given ones first, then by rule; distinct, at most so many, at least the bare site."""
    site = F.lit(f"site:{domain}")
    p, b, t = (F.trim(F.coalesce(c, F.lit(""))) for c in (product, business, technology))

    def of(words: Column, hints: Column) -> Column:
        word = lambda *at: [F.get(words, F.lit(i)) for i in at]
        named, unnamed = p != "", p == ""
        made = [
            F.when(named, compact(p)), F.when(named, compact(F.lit(brand), p)), compact(p, b, t), F.array_join(F.slice(hints, 1, 5), " "),
            compact(p, *word(0, 1), t), compact(p, *word(0, 1, 2)), compact(b, t, p), F.when(unnamed, compact(*word(0, 1, 2), t)), F.when(unnamed, compact(b, t, *word(0, 1))),
        ]
        rule = F.transform(_distinct(*made), lambda x: F.concat_ws(" ", site, x))
        own = F.array().cast("array<string>") if given is None else site_queries(given, domain)
        every = F.slice(F.array_distinct(F.concat(own, rule)), 1, most)
        return let(every, lambda q: F.when(F.size(q) > 0, q).otherwise(F.array(site)))

    return let(title_keywords(title), lambda w: let(_of_profiles(profiles(product, title, business, technology), "hints"), lambda h: of(w, h)))


def site_queries(given: Column, domain: str) -> Column:
    """Given queries with one site: word in front, distinct."""
    bare = F.transform(given, lambda q: F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(q, F.lit(""))), r"\s+", " "), rf"(?i)^site\s*:\s*{domain.replace('.', '[.]')}\s*", ""))
    some = F.filter(F.arrays_zip(bare.alias("b"), given.alias("g")), lambda x: F.trim(F.coalesce(x["g"], F.lit(""))) != "")
    return F.array_distinct(F.transform(some, lambda x: F.trim(F.concat(F.lit(f"site:{domain} "), x["b"]))))


def media_queries(base: Column, *, domain: str, brand: str) -> Column:
    """The same queries for related media: without the site, with the brand once in front."""
    bare = F.transform(base, lambda q: F.trim(F.regexp_replace(q, rf"(?i)^site\s*:\s*{domain.replace('.', '[.]')}\s*", "")))
    led = F.transform(bare, lambda q: F.when(q.rlike(rf"(?i)^{brand.replace(' ', '[ ]*')}\b"), q).otherwise(compact(F.lit(brand), q)))
    return F.array_distinct(F.filter(led, lambda q: q != ""))


def is_file(url: Column) -> Column:
    """The path ends like a file that is not read."""
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
    return reduce(lambda a, b: a | b, [path.endswith(x) for x in SKIPPED_FILES])


def candidates(results: DataFrame, *, by: str, order: str, domains: tuple[str, ...], most: int = 5, chars: int = 5_000) -> DataFrame:
    """Search results (title, url, content) of each query with normalized_url, skip_reason (null: accepted), score_reasons and content cut.

    Reasons in their order: empty_url, invalid_url, external_domain, file_url, duplicate_url. What comes after the last accepted one is not looked at and goes."""
    url = text.present(F.col("url"))
    normal = F.when(~F.lower(url).rlike("^(mailto|tel|javascript):"), text.url_normal(url))
    rows = results.withColumn("normalized_url", normal)
    owned = F.coalesce(text.in_domain(text.url_host(F.col("normalized_url")), domains), F.lit(False))
    rows = filters.reasons(rows.withColumn("_file", is_file(F.col("normalized_url"))), [("empty_url", url.isNull()), ("invalid_url", F.col("normalized_url").isNull()), ("external_domain", ~owned), ("file_url", F.col("_file"))])
    good = F.when(F.col("reason") == "passed", F.col("normalized_url"))
    nth = F.row_number().over(Window.partitionBy(by, good).orderBy(order))
    again = (F.col("reason") == "passed") & (nth > 1)
    rows = rows.withColumn("reason", F.when(again, "duplicate_url").otherwise(F.col("reason")))
    before = F.coalesce(F.count_if(F.col("reason") == "passed").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before).where(F.col("_before") < most)
    return rows.select(
        *results.columns[: results.columns.index("content")], F.substring(F.trim(F.coalesce("content", F.lit(""))), 1, chars).alias("content"), "normalized_url",
        F.when(F.col("reason") != "passed", F.col("reason")).alias("skip_reason"), F.when(F.col("reason") == "file_url", F.array(F.lit("penalty_file_url"))).otherwise(F.array().cast("array<string>")).alias("score_reasons"),
    )


def score(title: Column, content: Column, url: Column, product: Column, target_title: Column, business: Column, technology: Column, *, snippet: Column | None = None, foreign: tuple[str, ...] = FOREIGN_PATH_WORDS) -> Column:
    """How well a result meets a target: relevance_score from 0 to 1, score_reasons, is_relevant.

    Product .50, each strong term .16, technology area .14, business area .12, each hint of its domains .08, each preferred path .10; in the
    finance domain .50 less for a path with a foreign word that the target lacks. A result that meets nothing special scores 0. Words are
    looked for in the title, the snippet, the content and the address."""
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
    words = _low(F.concat_ws(" ", title, *([] if snippet is None else [snippet]), content, url))
    has = lambda w, x: (F.trim(F.coalesce(x, F.lit(""))) != "") & F.contains(w, _low(x))
    none = F.array().cast("array<string>")
    said = lambda cond, name: F.when(cond, F.array(F.lit(name))).otherwise(none)

    def of(w: Column, terms: Column, names: Column) -> Column:
        strong = F.filter(terms, lambda t: F.contains(w, F.lower(t)))
        hints = F.filter(_of_profiles(names, "hints"), lambda h: F.contains(w, F.lower(h)))
        paths = F.filter(F.array(*(F.when(F.array_contains(names, n), F.coalesce(*(F.when(path.startswith(x), x) for x in p["paths"]))) for n, p in DOMAIN_PROFILES.items())), lambda x: x.isNotNull())
        own = _low(F.concat_ws(" ", product, target_title, business, technology))
        strange = F.filter(F.array(*map(F.lit, foreign)), lambda x: F.contains(path, x) & ~F.contains(own, x)) if foreign else none
        astray = F.when(F.array_contains(names, "finance"), strange).otherwise(none)

        def scored(m: Column) -> Column:
            met = F.array_distinct(F.concat(F.when(m["product"], F.array(F.trim(product))).otherwise(none), m["strong"]))
            points = F.when(m["product"], 0.5).otherwise(0.0) + F.size(m["strong"]) * 0.16 + F.when(m["technology"], 0.14).otherwise(0.0) + F.when(m["business"], 0.12).otherwise(0.0) + F.size(m["hints"]) * 0.08 + F.size(m["paths"]) * 0.1 - F.size(m["astray"]) * 0.5
            fits = m["product"] | (F.size(met) >= 2) | ((F.size(met) >= 1) & (F.size(m["paths"]) > 0)) | ((F.size(m["paths"]) > 0) & (F.size(m["hints"]) >= 2))
            why = F.concat(
                said(m["product"], "matched_related_product"), F.transform(m["strong"], lambda t: F.concat(F.lit("matched_strong_term:"), t)), said(m["technology"], "matched_technology_area"), said(m["business"], "matched_business_area"),
                F.transform(m["hints"], lambda t: F.concat(F.lit("matched_domain_hint:"), t)), F.transform(m["paths"], lambda t: F.concat(F.lit("matched_preferred_path:"), t)), F.transform(m["astray"], lambda t: F.concat(F.lit("penalty_unrelated_keyword:"), F.upper(t))), said(~fits, "insufficient_specific_match"),
            )
            kept = F.when(fits, points).otherwise(F.least(points, F.lit(0.0)))
            return F.struct(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(kept, 3))).alias("relevance_score"), F.array_distinct(why).alias("score_reasons"), fits.alias("is_relevant"))

        matched = F.struct(has(w, product).alias("product"), strong.alias("strong"), has(w, technology).alias("technology"), has(w, business).alias("business"), hints.alias("hints"), paths.alias("paths"), astray.alias("astray"))
        return let(matched, scored)

    terms, names = strong_terms(product, title_keywords(target_title), technology), profiles(product, target_title, business, technology)
    return let(words, lambda w: let(terms, lambda t: let(names, lambda n: of(w, t, n))))


def final_reasons(found: DataFrame, scored: DataFrame, selected: DataFrame, evidence: DataFrame, *, url: str = "normalized_url", by: str | None = None) -> DataFrame:
    """Candidates with their score, whether they became evidence, and why not. scored: url, relevance_score; selected and evidence: url.

    Joins on the url. The floor is the lowest selected score, of the query where all tables have a column `by`, else of all. Null addresses meet nothing; of repeated scores the highest counts."""
    on = [by, url] if by else [url]
    best = scored.groupBy(*on).agg(F.max("relevance_score").alias("relevance_score"))
    tagged = lambda df, name: df.select(*on).distinct().withColumn(name, F.lit(True))
    least = selected.select(*on).join(best, on)
    rows = found.join(best, on, "left").join(tagged(selected, "_sel"), on, "left").join(tagged(evidence, "_ev"), on, "left")
    if by:
        rows = rows.join(least.groupBy(by).agg(F.min("relevance_score").alias("_floor")), by, "left").withColumn("_floor", F.coalesce("_floor", F.lit(0.0)))
    else:
        rows = rows.crossJoin(F.broadcast(least.agg(F.coalesce(F.min("relevance_score"), F.lit(0.0)).alias("_floor"))))  # one row
    points = F.coalesce("relevance_score", F.lit(0.0))
    why = (
        F.when(F.col("skip_reason").isNotNull(), F.col("skip_reason")).when(F.col("_ev"), F.lit(None).cast("string")).when(F.col("relevance_score").isNull(), "insufficient_specific_match")
        .when(F.col("_sel").isNull() & (points <= F.col("_floor")), "lower_relevance_than_selected").when(F.col("_sel").isNull(), "max_evidence_limit").otherwise("empty_content")
    )
    chosen = F.col("skip_reason").isNull() & F.coalesce("_ev", F.lit(False))
    return rows.select(*found.columns, F.when(F.col("skip_reason").isNull(), points).otherwise(F.lit(0.0)).alias("candidate_relevance_score"), chosen.alias("final_selected"), why.alias("final_skip_reason"))
