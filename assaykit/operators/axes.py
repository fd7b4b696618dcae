"""Scores of the four axes, from what a model returned: cleaned by rule, clamped, rescaled, summed.

A model's result is a row: raw subscores as map<string,int> and details as map<string,map<string,int>>; nulls and missing
keys count as nothing said.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..config import (
    ACTIVE_STATES, BUSINESS_FIT_MAXIMA, CONCRETE_PATHS, GLOBAL_HINTS, INACTIVE_STATES, LEGAL_DETAIL_MAXIMA, LEGAL_MAXIMA, MARKET_PART_MOST, MARKET_PARTS, MARKET_SIGNALS,
    TECHNOLOGY_CANDIDATES, TECHNOLOGY_GROUPS, TREND_PATHS,
)
from ..functions import scores, text
from ..functions.patents import let


def _sum(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _result(parts: dict[str, Column], total: Column, graded: Column | None = None) -> Column:
    return F.struct(F.struct(*(v.cast("int").alias(k) for k, v in parts.items())).alias("subscores"), total.cast("int").alias("score"), scores.grade(graded if graded is not None else total).alias("grade"))


def _capped(c: Column, most: int | Column) -> Column:
    return F.greatest(F.lit(0), F.least(most if isinstance(most, Column) else F.lit(most), F.coalesce(c, F.lit(0))))


def maxima(configured: Column | None, default: dict[str, int]) -> dict[str, Column]:
    """Configured maxima (a map) where they are there, else the default ones."""
    return {k: F.lit(v) if configured is None else F.coalesce(configured[k].cast("int"), F.lit(v)) for k, v in default.items()}


def detail_sum(details: Column, left_out: Column | None = None) -> Column:
    """The sum of the scores that are there, without the keys left out; null where none is."""
    kept = details if left_out is None else F.map_filter(details, lambda k, _: ~F.array_contains(left_out, k))
    values = F.filter(F.map_values(kept), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0), lambda a, b: a + b))


def unknown_details(details: Column, keys: Column) -> Column:
    """details with null scores for the keys: what could not be judged."""
    return F.transform_values(details, lambda k, v: F.when(~F.array_contains(keys, k), v))


def legal(raw: Column, details: Column, no_prior_art: Column, no_citing: Column, configured: Column | None = None) -> Column:
    """Legal axis. Sums of details win over raw subscores; abroad, what lacks comparable documents is left out and its points are taken from the maximum."""
    flags = {"prior_art_overlap": no_prior_art, "follow_on_right_signal": no_citing}
    top, parts = maxima(configured, LEGAL_MAXIMA), {}
    for key, most in LEGAL_MAXIMA.items():
        outs = [(d, points) for d, (of, points) in LEGAL_DETAIL_MAXIMA.items() if of == key]
        gone = F.filter(F.array(*(F.when(flags[d], d) for d, _ in outs), F.lit(None).cast("string")), lambda x: x.isNotNull())
        lost = _sum([F.when(flags[d], points).otherwise(0) for d, points in outs] or [F.lit(0)])
        score = _capped(F.coalesce(detail_sum(details[key], gone), raw[key]), F.lit(most) - lost)
        scaled = F.when(top[key] == most, score).otherwise(scores.rescale(score, most, top[key]))
        cap = F.when(lost > 0, scores.rescale(F.lit(most) - lost, most, top[key])).otherwise(top[key])
        parts[key] = _capped(scaled, cap)
    total = scores.rescale(_sum(parts.values()), _sum(top.values()), 100)
    return let(F.struct(*(v.alias(k) for k, v in parts.items()), _capped(total, 100).alias("_total")), lambda x: _result({k: x[k] for k in parts}, x["_total"]))


def business_fit(raw: Column, configured: Column | None = None) -> Column:
    """Business-fit axis: each part clamped to its maximum, the sum in proportion to 100."""
    top = maxima(configured, BUSINESS_FIT_MAXIMA)
    parts = {k: _capped(raw[k], m) for k, m in top.items()}
    whole = _sum(top.values())
    total = F.when(whole > 0, scores.rescale(_sum(parts.values()), whole, 100)).otherwise(0)
    return let(_capped(total, 100), lambda t: _result(parts, t))


def market(raw: Column, growth: Column, confidence: Column) -> Column:
    """Market axis: four parts of twenty, and growth where it is known. Without it confidence stays below a half. The grade follows the sum before it is clamped."""
    parts = {k: _capped(raw[k], MARKET_PART_MOST) for k in MARKET_PARTS}
    total = _sum(parts.values()) + F.coalesce(growth, F.lit(0))
    sure = scores.clamp(F.when(growth.isNull(), F.least(F.coalesce(confidence, F.lit(0.0)), F.lit(0.49))).otherwise(F.coalesce(confidence, F.lit(0.0))), 0.0, 1.0)
    scored = _result(parts | {"market_growth": growth}, _capped(total, 100), total)
    return F.struct(scored["subscores"].alias("subscores"), scored["score"].alias("score"), scored["grade"].alias("grade"), sure.alias("confidence"))


def technology(details: Column, raw: Column) -> Column:
    """Technology axis: each detail snaps to its candidates; a group without details keeps its raw score, clamped."""
    parts = {}
    for group, (most, names) in TECHNOLOGY_GROUPS.items():
        snapped = _sum([F.coalesce(scores.snap(details[group][n], TECHNOLOGY_CANDIDATES[n]), F.lit(0)) for n in names])
        parts[group] = F.when(details[group].isNull(), _capped(raw[group], most)).otherwise(snapped)
    return _result(parts, _capped(_sum(parts.values()), 100))


def max_score_conflict(missing: Column, notes: Column, limits: tuple[str, ...]) -> Column:
    """A top score beside missing information or words of limitation."""
    absent = F.exists(F.coalesce(missing, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    return absent | (text.hits(F.array_join(F.coalesce(notes, F.array().cast("array<string>")), " "), limits) > 0)


def right_state(*fields: Column) -> Column:
    """Of the first status that is there: inactive, registered_or_active, unclear, or unknown."""
    status = text.first_present(*fields)
    return F.when(status.isNull(), "unknown").when(text.hits(status, INACTIVE_STATES) > 0, "inactive").when(text.hits(status, ACTIVE_STATES) > 0, "registered_or_active").otherwise("unclear")


# --- evidence classes -----------------------------------------------------------------------------


def has_tag(tag: tuple[str, ...], *fields: Column) -> Column:
    """Any of the fields is one of the tags."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.trim(f).isin(*tag), F.lit(False)) for f in fields])


def url_path(url: Column, own: tuple[str, ...]) -> Column:
    """What follows an own domain's name, else the whole address; without the query, in lower case."""
    low = F.regexp_extract(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^([^?]*)", 1)
    rest = F.coalesce(*(F.when(F.contains(low, F.lit(d)), F.substring_index(low, d, -1)) for d in own), F.lit(None).cast("string"))
    return F.coalesce(rest, low)


def is_concrete_page(path: Column) -> Column:
    return text.hits(path, CONCRETE_PATHS) > 0


def is_trend_page(path: Column) -> Column:
    return text.hits(path, TREND_PATHS) > 0


def is_weak_page(path: Column) -> Column:
    return is_trend_page(path) | ~is_concrete_page(path)


def presence_score(official: Column, weak: Column, owned: Column) -> Column:
    """Points for official evidence by how many pieces there are, how many of them are weak, and how many come from owned media; with the reason."""
    out = lambda score, reason: F.struct(F.lit(score).alias("score"), F.lit(reason).alias("reason"))
    only_owned = F.when(owned == 1, out(8, "owned_media_only")).otherwise(out(16, "owned_media_only"))
    some = F.when(weak >= official, out(8, "broad_or_weak_only")).when(official >= 3, out(30, "official_3_or_more")).when(official == 2, out(24, "official_2")).otherwise(out(16, "official_1"))
    return F.when((official == 0) & (owned == 0), out(0, "no_official_evidence")).when(official == 0, only_owned).otherwise(some)


def relevance(*fields: Column) -> Column:
    """The first field that is there as a number, else 0."""
    return F.coalesce(*(f.cast("string").try_cast("double") for f in fields), F.lit(0.0))


def market_signal(*fields: Column) -> Column:
    """Any of the market's words in the texts."""
    return text.hits(F.concat_ws(" ", *fields), MARKET_SIGNALS) > 0


def abroad_signal(country: Column, hints: dict[str, tuple[str, ...]], *fields: Column) -> Column:
    """A market signal that is not only of the patent's own country: no hint of it, or a global one, or another country's."""
    words = F.concat_ws(" ", *fields)
    at = F.upper(F.trim(F.coalesce(country, F.lit(""))))
    own = reduce(lambda a, b: a | b, [(at == c) & (text.hits(words, h) > 0) for c, h in hints.items()], F.lit(False))
    other = reduce(lambda a, b: a | b, [(at != c) & (text.hits(words, h) > 0) for c, h in hints.items()], text.hits(words, GLOBAL_HINTS) > 0)
    return market_signal(*fields) & (~own | other)


def evidence_groups(kind: Column, source: Column) -> Column:
    """The groups that market evidence belongs to; news belongs to its channel and to competition."""
    s = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    return (
        F.when(F.lower(F.trim(F.coalesce(kind, F.lit("")))) == "industry_report", F.array(F.lit("industry_report")))
        .when(s.isin("naver_news", "domestic_news"), F.array(F.lit("domestic_news"), F.lit("competition")))
        .when(s == "global_news", F.array(F.lit("global_news"), F.lit("competition")))
        .otherwise(F.array().cast("array<string>"))
    )


# --- gates ----------------------------------------------------------------------------------------


def confidence_of(n: Column) -> Column:
    """By pieces of evidence: three or more, any, none."""
    return F.when(n >= 3, "HIGH").when(n > 0, "MEDIUM").otherwise("LOW")


def confidence_text(c: Column) -> Column:
    return F.when(c >= 0.7, "high").when(c >= 0.4, "medium").otherwise("low")
