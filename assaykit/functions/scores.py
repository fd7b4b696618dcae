"""Scores, grades and rescaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..config import CAGR_POINTS, Valuation


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def grade(score: Column, valuation: Valuation = Valuation()) -> Column:
    return F.when(score >= valuation.cutoff_a, "A").when(score >= valuation.cutoff_b, "B").otherwise("C")


def recommendation(grade_: Column) -> Column:
    return F.when(grade_ == "A", "keep").when(grade_ == "B", "conditional").otherwise("drop")


def weighted_mean(scores: dict[str, Column], weights: dict[str, float], places: int = 1) -> Column:
    total = sum(weights[k] for k in scores)
    return F.round(reduce(lambda a, b: a + b, [c * F.lit(weights[k]) for k, c in scores.items()]) / F.lit(total), places)


def snap(c: Column, candidates: tuple[int, ...]) -> Column:
    """The nearest candidate, the larger of two as near."""
    best = F.array_min(F.array(*(F.named_struct(F.lit("d"), F.abs(c - v), F.lit("v"), F.lit(-v)) for v in candidates)))
    return F.when(c.isNotNull(), -best["v"])


def rescale(c: Column, from_max: float, to_max: float) -> Column:
    """In proportion, rounded half to even, as integers."""
    return F.bround(c * to_max / from_max).cast("int")


def cagr(first: Column, last: Column, periods: int, places: int = 6) -> Column:
    return F.when((first > 0) & last.isNotNull(), F.round(F.pow(last / first, F.lit(1.0 / periods)) - 1, places))


def cagr_points(c: Column) -> Column:
    out = None
    for least, points in CAGR_POINTS:
        out = F.when(c >= least, points) if out is None else out.when(c >= least, points)
    return out.otherwise(F.when(c.isNotNull(), 0))


def trend_points(a: Column, b: Column, c: Column) -> Column:
    """Over three counts: 10 if all rise, 0 if all fall, 5 if any rises, else 0."""
    return F.when((a < b) & (b < c), 10).when((a > b) & (b > c), 0).when((a < b) | (b < c), 5).otherwise(0)
