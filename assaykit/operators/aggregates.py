"""Counts, statistics, ensembles and valuations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Valuation
from ..functions import scores, text


def counts_by(df: DataFrame, column: str, unknown: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(text.present(F.col(column)), F.lit(unknown)).alias(column)).agg(F.count("*").alias("n"))


def labels(df: DataFrame, columns: list[str], excluded: tuple[str, ...]) -> DataFrame:
    """The distinct values of each column, sorted, without the excluded ones: rows of column, labels."""
    kept = [df.where(~F.col(c).isin(*excluded)).select(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns]
    rows = kept[0]
    for k in kept[1:]:
        rows = rows.unionByName(k)
    return rows.distinct().groupBy("column").agg(F.array_sort(F.collect_list("v")).alias("labels"))


def claim_stats(df: DataFrame, *, by: str, number: str, independent: Column, deleted: Column) -> DataFrame:
    """Of each document: active, independent, dependent and deleted numbers, and the gaps of 1..largest (deleted ones count for the largest)."""
    active = ~F.coalesce(deleted, F.lit(False))
    listed = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col(number))))
    out = df.groupBy(by).agg(listed(active).alias("active"), listed(active & independent).alias("independent"), listed(active & ~independent).alias("dependent"), listed(~active).alias("deleted"), F.max(number).alias("largest"))
    every = F.when(F.col("largest") >= 1, F.sequence(F.lit(1), F.col("largest").cast("int"))).otherwise(F.array().cast("array<int>"))
    gaps = F.filter(every, lambda x: ~F.array_contains(F.transform("active", lambda a: a.cast("int")), x))
    return out.withColumn("gaps", gaps).withColumn("has_gaps", F.size("gaps") > 0).drop("largest")


def ensemble(df: DataFrame, *, by: list[str], score: str, seq: str, confidence: str) -> DataFrame:
    """Of each group's runs the one at the upper median of the score (stable by seq), the number of runs, and the mean confidence at two places."""
    w = Window.partitionBy(*by)
    placed = df.withColumn("_r", F.row_number().over(w.orderBy(score, seq))).withColumn("runs", F.count("*").over(w)).withColumn("mean_confidence", F.round(F.avg(confidence).over(w), 2))
    return placed.where(F.col("_r") == F.floor(F.col("runs") / 2) + 1).drop("_r")


def valuation(axes: DataFrame, *, by: str, axis: str = "axis", score: str = "score", missing: str | None = None, config: Valuation = Valuation()) -> DataFrame:
    """Long axis scores to one row for each subject: core total, weighted mean, grade and recommendation.

    A missing core axis counts as 0. business_fit at the threshold or more lifts the recommendation to keep."""
    of = lambda name: F.coalesce(F.max(F.when(F.col(axis) == name, F.col(score))), F.lit(0))
    out = axes.groupBy(by).agg(*(of(a).alias(a) for a in (*config.weights, "business_fit")))
    core = {a: F.col(a) for a in config.weights}
    out = out.withColumn("total", sum(core.values(), F.lit(0))).withColumn("mean", scores.weighted_mean(core, config.weights)).withColumn("grade", scores.grade(F.col("mean"), config))
    lifted = F.col("business_fit") >= config.override
    return out.withColumn("overridden", lifted & (F.col("grade") != "A")).withColumn("recommendation", F.when(lifted, "keep").otherwise(scores.recommendation(F.col("grade"))))


def extremes(axes: DataFrame, *, by: str, axis: str = "axis", score: str = "score", order: str = "rank") -> DataFrame:
    """The strongest and the weakest axis, the first in order of equals."""
    return axes.groupBy(by).agg(F.max_by(axis, F.struct(F.col(score), -F.col(order))).alias("strongest"), F.min_by(axis, F.struct(F.col(score), F.col(order))).alias("weakest"))


def accuracy(df: DataFrame, pairs: dict[str, tuple[Column, Column]], confidence: Column | None = None) -> DataFrame:
    """The share of exact matches of each pair and of all at once, over rows where all are known; null when there is none."""
    scored = F.lit(True)
    for a, b in pairs.values():
        scored &= a.isNotNull() & b.isNotNull()
    right = {n: F.coalesce(a == b, F.lit(False)) for n, (a, b) in pairs.items()}
    both = F.lit(True)
    for r in right.values():
        both &= r
    share = lambda c: F.round(F.try_divide(F.count_if(scored & c), F.count_if(scored)), 4)
    out = [F.count_if(scored).alias("scored"), F.count_if(~scored).alias("errors"), *(share(r).alias(n) for n, r in right.items()), share(both).alias("all_right")]
    if confidence is not None:
        out.append(F.round(F.avg(F.when(scored, confidence)), 4).alias("mean_confidence"))
    return df.agg(*out)


def evidence_gate(df: DataFrame, by: str, *, news: Column, relevant: Column, complete: Column, items: int = 3, news_items: int = 3, relevant_items: int = 2) -> DataFrame:
    """Whether each group has enough items, news and relevant ones, and all are complete; issues says what is missing."""
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(news).alias("n_news"), F.count_if(relevant).alias("n_relevant"), F.count_if(~F.coalesce(complete, F.lit(False))).alias("n_incomplete"))
    rules = [("too_few_items", F.col("n") < items), ("too_few_news", F.col("n_news") < news_items), ("too_few_relevant", F.col("n_relevant") < relevant_items), ("incomplete_items", F.col("n_incomplete") > 0)]
    issues = F.filter(F.array(*(F.when(r, name) for name, r in rules)), lambda x: x.isNotNull())
    return out.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0)
