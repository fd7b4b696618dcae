"""Counts in date windows, growth and trend."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scores


def shifted(day: date, months: int) -> date:
    """Months later, at the month's end where the day is missing."""
    y, m = divmod(day.year * 12 + day.month - 1 + months, 12)
    last = (date(y + (m == 11), (m + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return date(y, m + 1, min(day.day, last))


def windows(reference: date, n: int = 3, months: int = 12) -> list[tuple[int, date, date]]:
    """Consecutive windows that end at the reference: (number, first day, last day)."""
    ends = [shifted(reference, -months * k) for k in range(n, -1, -1)]
    return [(i + 1, a + timedelta(days=1), b) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]


def window_of(day: Column, spans: list[tuple[int, date, date]]) -> Column:
    return F.coalesce(*(F.when(day.between(F.lit(a), F.lit(b)), i) for i, a, b in spans))


def window_counts(df: DataFrame, day: str, key: str, spans: list[tuple[int, date, date]], by: list[str] | None = None) -> DataFrame:
    """Distinct keys in each window and group; windows without rows count 0. Only rows inside the windows are read on."""
    by = by or []
    low, high = min(a for _, a, _ in spans), max(b for _, _, b in spans)
    hit = df.where(F.col(day).between(F.lit(low), F.lit(high + timedelta(days=1)))).withColumn("_w", window_of(F.to_date(day), spans)).where("_w IS NOT NULL")
    distinct = hit.select(*by, "_w", key).where(F.col(key).isNotNull()).distinct()
    wide = distinct.groupBy(*by).agg(*(F.count_if(F.col("_w") == i).alias(f"c{i}") for i, _, _ in spans))
    return wide


def growth(counts: DataFrame, names: tuple[str, str, str] = ("c1", "c2", "c3")) -> DataFrame:
    """Three counts with cagr or the reason that it has none, its points, the trend's points and their sum."""
    a, b, c = (F.col(n) for n in names)
    known = a.isNotNull() & b.isNotNull() & c.isNotNull()
    reason = F.when(~known, "window_counts_incomplete").when((a == 0) & (b == 0) & (c == 0), "inactive_or_reclassified").when(a <= 0, "cagr_start_count_zero")
    rate = F.when(reason.isNull(), scores.cagr(a.cast("double"), c.cast("double"), len(names) - 1))
    out = counts.withColumn("reason", reason).withColumn("cagr", rate)
    points = F.when(F.col("reason").isNull(), scores.cagr_points(F.col("cagr")))
    trend = F.when(F.col("reason").isNull(), scores.trend_points(a, b, c))
    return out.withColumn("cagr_points", points).withColumn("trend_points", trend).withColumn("growth_points", points + trend)
