"""Checks that send what they flag back, for so many rounds at most."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import delete, shared_dir, stored


def rework(rows: DataFrame, flagged: Column, again: Callable[[DataFrame], DataFrame], most: int = 2) -> DataFrame:
    """rows with retries, checked (how often the check saw them) and status: passed, or exhausted where they are still flagged after `most` retries.

    Only flagged rows are made anew by `again` (a function of rows that keeps their columns) and checked again; the others keep their
    check. Each round is stored before the next; the loop ends when nothing is flagged or no retries are left."""
    spark = rows.sparkSession
    done, paths = [], []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(shared_dir(spark, "round"))
        return stored(df, paths[-1])

    check = F.coalesce(flagged, F.lit(True))
    open_ = keep(rows.withColumns({"retries": F.lit(0), "checked": F.lit(1), "_flag": check}))
    for n in range(most + 1):
        done.append(open_.where("NOT _flag").withColumn("status", F.lit("passed")))
        left = open_.where("_flag")
        if n == most or not left.limit(1).count():
            done.append(left.withColumn("status", F.lit("exhausted")))
            break
        made = again(left.drop("_flag"))
        open_ = keep(made.withColumns({"retries": F.col("retries") + 1, "checked": F.col("checked") + 1}).withColumn("_flag", check))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    result = stored(out.drop("_flag"), shared_dir(spark, "reworked"))
    for p in paths:
        delete(spark, p)
    return result


def next_step(passed: Column, evidence: Column, score: Column, report: Column) -> Column:
    """What a record lacks first: the step that a supervisor sends it to."""
    return F.when(~F.coalesce(passed, F.lit(False)), "structuring").when(~F.coalesce(evidence, F.lit(False)), "evidence").when(score.isNull(), "valuation").when(~F.coalesce(report, F.lit(False)), "writing").otherwise("done")


def gaps(checks: DataFrame, key: str, order: str, issues: str = "issues") -> DataFrame:
    """By key the distinct issues of flagged rows, in the order in which they first come."""
    flagged = checks.where(F.size(issues) > 0).select(key, order, F.posexplode(issues).alias("_i", "issue"))
    first = flagged.groupBy(key, "issue").agg(F.min(F.struct(order, "_i")).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "issue"))), lambda x: x["issue"]).alias("gaps"))


def citation_rules(results: DataFrame, evidence: DataFrame, key: str, allowed: dict[str, tuple[int, ...]]) -> DataFrame:
    """key, status and issues of axis results against the evidence that they cite.

    results: key, cited (array of ids), score, subscores (map of name to score). evidence: key, evidence_id, official, context (flags).
    Without official evidence at all the queries must be rewritten; else the result is wrong if it cites none of it, cites what is
    neither official nor context, has a subscore that isn't allowed, or a score that isn't their sum."""
    cited = results.select(key, F.explode("cited").alias("evidence_id")).distinct()
    known = evidence.select(key, "evidence_id", F.coalesce("official", F.lit(False)).alias("official"), F.coalesce("context", F.lit(False)).alias("context"))
    there = known.groupBy(key).agg(F.max("official").alias("_some"))
    used = cited.join(known, [key, "evidence_id"]).groupBy(key).agg(F.max("official").alias("_used"), F.array_sort(F.collect_set(F.when(~F.col("official") & ~F.col("context"), F.col("evidence_id").cast("string")))).alias("_improper"))
    rows = results.join(there, key, "left").join(used, key, "left")
    bad = F.filter(F.array(*map(F.lit, allowed)), lambda n: n.isNull())
    for name, values in allowed.items():
        held = F.try_element_at("subscores", F.lit(name))
        bad = F.concat(bad, F.when(F.coalesce(held.isin(*values), F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit(f"subscore_not_allowed:{name}"))))
    good = [F.when(F.coalesce(F.try_element_at("subscores", F.lit(n)).isin(*v), F.lit(False)), F.try_element_at("subscores", F.lit(n))).otherwise(0) for n, v in allowed.items()]
    total = good[0]
    for g in good[1:]:
        total = total + g
    one = lambda when, what: F.when(when, F.array(what)).otherwise(F.array().cast("array<string>"))
    issues = F.concat(
        one(~F.coalesce("_used", F.lit(False)), F.lit("official_evidence_unused")),
        one(F.size(F.coalesce("_improper", F.array().cast("array<string>"))) > 0, F.concat(F.lit("improper_citations:"), F.array_join("_improper", ","))),
        bad, one(F.coalesce(total != F.col("score"), F.lit(True)), F.lit("score_is_not_the_sum")),
    )
    none = ~F.coalesce("_some", F.lit(False))
    return rows.select(key, F.when(none, "query_rewriting").when(F.size(issues) > 0, "valuation_retry").otherwise("passed").alias("status"), F.when(none, F.array(F.lit("no_official_evidence"))).otherwise(issues).alias("issues"))
