"""Filters that say why: each rejected row keeps the reason of the first rule it fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import MAX_NEWS_AGE_DAYS, REPORT_SCORE_LEAST
from ..functions import dates, text


def reasons(df: DataFrame, rules: list[tuple[str, Column]], passed: str = "passed") -> DataFrame:
    """df with reason: the name of the first rule whose condition holds (null counts as not), else passed."""
    out = F.lit(passed)
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return df.withColumn("reason", out)


def news_key(url: Column, title: Column, published: Column) -> Column:
    return F.coalesce(F.lower(text.present(url)), F.concat_ws(":", title, published))


def news(df: DataFrame, target: Column, now: Column, *, preview: int = 100, most: int = 5_000, days: int = MAX_NEWS_AGE_DAYS) -> DataFrame:
    """Rows of seq, url, title, content, published_at, source with matched, reason, truncated and date_missing.

    target: the keywords to meet. A key is used up by its first row even if that is rejected for its age, so later
    copies of a stale row are duplicates. Rows of localised foreign news need no keyword; without target keywords none does.
    """
    published = dates.iso(F.col("published_at"))
    first = F.row_number().over(Window.partitionBy(news_key(F.col("url"), F.col("title"), F.col("published_at"))).orderBy("seq"))
    near = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.substring(F.coalesce("content", F.lit("")), 1, preview))
    matched = F.array_sort(F.array_intersect(text.keywords(near), target))
    rows = df.withColumn("_n", first).withColumn("matched", matched).withColumn("date_missing", published.isNull()).withColumn("truncated", F.length(F.coalesce("content", F.lit(""))) > most)
    rules = [
        ("duplicate", F.col("_n") > 1),
        ("too_old", dates.older_than(published, now, days)),
        ("no_keyword_match", (F.size(target) > 0) & (F.size("matched") == 0) & (F.coalesce("source", F.lit("")) != "domestic_news")),
    ]
    return reasons(rows, rules).withColumn("content", F.when(F.col("truncated"), F.substring("content", 1, most)).otherwise(F.col("content"))).drop("_n")


def route(df: DataFrame, source: str = "source_type", score: str = "score", least: float = REPORT_SCORE_LEAST) -> DataFrame:
    """df with route: which rows a model compresses, which pass as they are, which are no targets."""
    kind = F.col(source)
    chosen = F.when(kind.isin("news", "company_disclosure"), "candidate").when((kind == "industry_report") & (F.col(score).isNull() | (F.col(score) >= least)), "candidate").when(kind == "competitor_patent", "passthrough")
    return df.withColumn("route", chosen.otherwise("non_target"))


def quality(df: DataFrame, words: Column, target: Column) -> DataFrame:
    """df with match_count and quality: no_match, weak_match (one word) or match."""
    n = F.size(F.array_intersect(words, target))
    return df.withColumn("match_count", n).withColumn("quality", F.when(n == 0, "no_match").when(n == 1, "weak_match").otherwise("match"))


def candidates(df: DataFrame, *, seq: str, number: str, country: str, date: str, filed: Column, home: str, own: Column, status: tuple[str, ...], state: str, years: int = 10, most: int = 50) -> DataFrame:
    """The first `most` rows that are at home, numbered, not the target itself, first of their number, within so many years before filing, and of a status."""
    ok = (F.col(country) == home) & text.present(F.col(number)).isNotNull() & (F.col(number) != own) & (F.col(date) >= F.add_months(filed, -12 * years)) & (F.col(date) < filed) & F.col(state).isin(*status)
    first = F.row_number().over(Window.partitionBy(number).orderBy(seq))
    return df.where(ok).withColumn("_n", first).where("_n = 1").drop("_n").orderBy(seq).limit(most)
