"""Sorts and top-k with ties that are always settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import CITATION_TYPE_TIERS
from ..functions import vectors


def top_cosine(df: DataFrame, query: list[float], *, vector: str, key: str, k: int, where: Column | None = None, places: int | None = 4) -> DataFrame:
    """The k rows nearest to one query vector: a filter, a projection and a limited sort."""
    rows = df if where is None else df.where(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    score = vectors.cosine(F.col(vector), q)
    return rows.withColumn("similarity", score if places is None else F.round(score, places)).orderBy(F.desc("similarity"), key).limit(max(1, int(k)))


def citation_order(df: DataFrame, *, types: str, home: str) -> list[Column]:
    """Sort keys: standardised, kind B, type tier, home country, display number."""
    tier = F.lit(len(CITATION_TYPE_TIERS))
    for i, codes in reversed(list(enumerate(CITATION_TYPE_TIERS))):
        tier = F.when(F.arrays_overlap(F.col(types), F.array(*map(F.lit, codes))), i).otherwise(tier)
    return [F.desc("standard"), F.desc(F.col("kind").startswith("B")), tier, F.desc(F.col("country") == home), F.col("display")]


def tiers(df: DataFrame, tier: Column, score: str, order: str, unscored: int, k: int | None = None) -> DataFrame:
    """Rows by tier, then score downward (tiers from `unscored` on keep their order), then order; with their tier. k: only the first so many, which a limited sort finds."""
    rows = df.withColumn("tier", tier).orderBy("tier", F.when(F.col("tier") < unscored, -F.col(score)), order)
    return rows if k is None else rows.limit(k)


def first_sources(df: DataFrame, by: str, identity: str, source_rank: str, order: str, most: int) -> DataFrame:
    """Of each group the first `most` distinct identities, one source after the other."""
    n = F.row_number().over(Window.partitionBy(by, identity).orderBy(source_rank, order))
    one = df.withColumn("_n", n).where("_n = 1").drop("_n")
    place = F.row_number().over(Window.partitionBy(by).orderBy(source_rank, order))
    return one.withColumn("place", place).where(F.col("place") <= most)
