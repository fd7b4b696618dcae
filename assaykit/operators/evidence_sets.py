"""Sets of evidence by target: samples, identifiers, warnings, and what a filter kept of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text


def samples(evidence: DataFrame, by: str, order: str, cited: Column, most: int = 5) -> DataFrame:
    """All cited rows of each target, then the first `most` others, with their place; each in the given order."""
    flag = F.coalesce(cited, F.lit(False))
    rows = evidence.withColumn("_cited", flag)
    nth = F.row_number().over(Window.partitionBy(by, "_cited").orderBy(order))
    kept = rows.withColumn("_n", nth).where(F.col("_cited") | (F.col("_n") <= most))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_cited"), order))
    return kept.withColumn("place", place).withColumnRenamed("_cited", "cited").drop("_n")


def identifiers(rows: DataFrame, by: str, order: str, fields: list[str]) -> DataFrame:
    """by, identifiers: the distinct non-blank values of some fields, row after row and field after field, in the order in which they first come.

    Rows are dealt by target before their values are rows of their own, so each travels once and both groupings need nothing else."""
    values = F.array(*(F.struct(F.lit(i).alias("field"), text.present(F.trim(F.col(f).cast("string"))).alias("value")) for i, f in enumerate(fields)))
    every = rows.select(by, order, *(f for f in fields if f not in (by, order))).repartition(by).select(by, order, F.inline(values)).where("value IS NOT NULL")
    first = every.groupBy(by, "value").agg(F.min(F.struct(order, "field")).alias("at"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("identifiers"))


def warnings(sources: list[Column], empty: Column, when_empty: str = "evidence_bundle_empty") -> Column:
    """The distinct warnings of some arrays, one after the other; blank ones go, and one more where there is no evidence."""
    none = F.array().cast("array<string>")
    every = F.flatten(F.array(*(F.coalesce(s, none) for s in sources), F.when(F.coalesce(empty, F.lit(True)), F.array(F.lit(when_empty))).otherwise(none)))
    return F.array_distinct(F.filter(every, lambda x: text.present(x).isNotNull()))


def filter_stats(judged: DataFrame, by: str, reason: str = "reason", passed: str = "passed") -> DataFrame:
    """by, input_count, kept_count, rejected_count, and rejected: how often each reason, by name."""
    counts = judged.groupBy(by, reason).agg(F.count("*").alias("n"))
    kept = F.when(F.col(reason) == passed, F.col("n")).otherwise(0)
    why = F.array_sort(F.collect_list(F.when(F.col(reason) != passed, F.struct(F.col(reason).alias("reason"), "n"))))
    return counts.groupBy(by).agg(F.sum("n").alias("input_count"), F.sum(kept).alias("kept_count"), why.alias("rejected")).select(by, "input_count", "kept_count", (F.col("input_count") - F.col("kept_count")).alias("rejected_count"), "rejected")


def quality_counts(evidence: DataFrame, by: str, key: str, of_kind: Column, good: Column) -> DataFrame:
    """by, found, good, ids: how many rows are of a kind, how many of these are good, and the distinct keys of those in order."""
    kind, both = F.coalesce(of_kind, F.lit(False)), F.coalesce(of_kind & good, F.lit(False))
    return evidence.groupBy(by).agg(F.count_if(kind).alias("found"), F.count_if(both).alias("good"), F.array_sort(F.collect_set(F.when(both, F.col(key)))).alias("ids"))


def rewritten_queries(reply: Column, previous: Column, limits: dict[str, int]) -> Column:
    """A model's reply as lists of queries by channel: a list as it is, a mapping's lists one after the other; stripped, distinct, capped, then without those asked before.

    A reply may have text around its outermost braces. Without any JSON object all lists are empty."""
    whole = F.try_parse_json(reply)
    cut = F.try_parse_json(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1))
    value = F.coalesce(F.when(F.schema_of_variant(whole).startswith("OBJECT"), whole), cut)
    none = F.array().cast("array<string>")
    asked = F.coalesce(previous, none)

    def channel(name: str, most: int) -> Column:
        listed = F.try_variant_get(value, f"$.{name}", "array<string>")
        mapped = F.flatten(F.filter(F.transform(F.map_values(F.try_variant_get(value, f"$.{name}", "map<string,variant>")), lambda v: F.try_variant_get(v, "$", "array<string>")), lambda x: x.isNotNull()))
        plain = F.filter(F.transform(F.coalesce(listed, mapped, none), lambda q: text.present(F.regexp_replace(F.trim(q), r"\s+", " "))), lambda q: q.isNotNull())
        return F.filter(F.slice(F.array_distinct(plain), 1, most), lambda q: ~F.array_contains(asked, q)).alias(name)

    return F.struct(*(channel(n, k) for n, k in limits.items()))


def either(*frames: DataFrame | None) -> DataFrame:
    """The union of those that are there; each has the columns of the first."""
    some = [f for f in frames if f is not None]
    return reduce(lambda a, b: a.unionByName(b.select(*a.columns)), some)
