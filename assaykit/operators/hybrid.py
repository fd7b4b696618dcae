"""Comparison documents from two lists: cited ones first, similar ones where those don't suffice; and labels voted by neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from .neighbours import nearest


def guarded(targets: DataFrame, *, abroad: Column, code: Column, filed: Column, claims: Column) -> DataFrame:
    """targets with skip: why no similar documents can be looked for, or null."""
    blank = lambda c: text.present(c.cast("string")).isNull()
    why = F.when(F.coalesce(abroad, F.lit(False)), "foreign_target_unsupported").when(blank(code), "classification_not_found").when(filed.isNull(), "filing_date_not_found").when(blank(claims), "claims_not_found")
    return targets.withColumn("skip", why)


def context(targets: DataFrame, cited: DataFrame, rows: DataFrame, *, key: str, vector: str, by: str, goal: int = 3) -> DataFrame:
    """target, place, identity, origin, similarity, policy: up to `goal` documents of each target, each identity once.

    targets: key, vector, by, skip. cited: target, place, identity, has_text; those with a text come first, by place. Only targets that
    have fewer than `goal` of them and aren't skipped are compared with rows, by vectors within their group. policy says which lists were
    used: prior_art_only, prior_art_first_then_similar, or the reason for a skip."""
    whole = cited.where(F.col("has_text") & text.present(F.col("identity")).isNotNull()).groupBy("target", "identity").agg(F.min("place").alias("place"))
    first = whole.withColumn("_n", F.row_number().over(Window.partitionBy("target").orderBy("place", "identity"))).where(F.col("_n") <= goal)
    enough = first.where(F.col("_n") == goal).select(F.col("target").alias(key))
    open_ = targets.join(enough, key, "left_anti")
    alike = nearest(rows, open_.where("skip IS NULL"), vector=vector, key=key, k=goal, by=by)
    prior = first.select("target", "identity", F.lit(0).alias("_list"), F.col("_n").alias("_at"), F.lit("prior_art").alias("origin"), F.lit(None).cast("double").alias("similarity"))
    similar = alike.select(F.col("query").alias("target"), F.col("match").cast("string").alias("identity"), F.lit(1).alias("_list"), F.col("rank").alias("_at"), F.lit("similar").alias("origin"), "similarity")
    both = prior.unionByName(similar).groupBy("target", "identity").agg(F.min(F.struct("_list", "_at", "origin", "similarity")).alias("_f"))
    placed = both.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy("_f._list", "_f._at", "identity"))).where(F.col("place") <= goal)
    policy = targets.select(F.col(key).alias("target"), "skip").join(enough.select(F.col(key).alias("target"), F.lit(True).alias("_enough")), "target", "left")
    policy = policy.select("target", F.when(F.col("_enough"), "prior_art_only").otherwise(F.coalesce(F.concat(F.lit("similar_skipped:"), F.col("skip")), F.lit("prior_art_first_then_similar"))).alias("policy"))
    return placed.join(policy, "target").select("target", "place", "identity", "_f.origin", "_f.similarity", "policy")


def confidence_text(c: Column) -> Column:
    """The words for a confidence."""
    return F.when(c >= 0.7, "높음").when(c >= 0.4, "보통").otherwise("낮음")


def voted(neighbours: DataFrame, labels: DataFrame, taxonomy: DataFrame, *, k: int) -> DataFrame:
    """query, label, votes, confidence, confidence_text, accepted: the label that most of a query's k neighbours have.

    neighbours: query, match. labels: match, label. taxonomy: label, parent, a row for each label that may be recommended or has a
    parent; `known` tells which may. Ties go to the smaller label. Confidence is the votes' share of k. A label that the taxonomy
    doesn't let be recommended gives its parent instead (null where it has none), with a confidence of 0.3 at most."""
    counted = neighbours.join(labels, "match").groupBy("query", "label").agg(F.count("*").alias("votes"))
    top = counted.groupBy("query").agg(F.max(F.struct("votes", (-F.col("label")).alias("less"))).alias("t")).select("query", F.col("t.votes").alias("votes"), (-F.col("t.less")).alias("label"))
    known = F.coalesce("known", F.lit(False))
    share = F.least(F.col("votes") / k, F.lit(1.0))
    rows = top.join(taxonomy, "label", "left").withColumn("confidence", F.round(F.when(known, share).otherwise(F.least(share, F.lit(0.3))), 4))
    return rows.select("query", F.when(known, F.col("label").cast("string")).otherwise(F.col("parent")).alias("label"), "votes", "confidence", confidence_text(F.col("confidence")).alias("confidence_text"), known.alias("accepted"))
