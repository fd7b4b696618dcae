"""Rules as violations: each check gives rows of rule, key and detail; none means that all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text


def violations(df: DataFrame, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """rules: name to (holds, detail). A null condition counts as broken. One pass over df."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail"))) for name, (ok, detail) in rules.items())), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("b")).select("b.rule", "key", "b.detail")


def required(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """df's keys with the fields that are missing or blank, in the given order."""
    missing = F.filter(F.array(*(F.when(text.present(F.col(f).cast("string")).isNull(), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return df.select(key, missing.alias("missing")).withColumn("is_valid", F.size("missing") == 0)


def precedence(df: DataFrame, rules: list[tuple[str, Column]], default: str, name: str = "action") -> DataFrame:
    """df with the first action whose condition holds."""
    out = F.lit(default)
    for action, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), action).otherwise(out)
    return df.withColumn(name, out)


def totals_agree(df: DataFrame, key: str, parts: list[str], total: str) -> DataFrame:
    """Rows whose total is not the sum of its parts."""
    s = reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0)) for p in parts])
    return violations(df, key, {"total_is_sum": (F.col(total) == s, s)})


def retry_limit(df: DataFrame, by: list[str], order: str, wants: Column, most: int = 1) -> DataFrame:
    """df with attempt (requests so far in the group) and decision: retry up to the limit, then fallback, pass where none is wanted."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_w", F.coalesce(wants, F.lit(False))).withColumn("attempt", F.sum(F.col("_w").cast("int")).over(w))
    return rows.withColumn("decision", F.when(~F.col("_w"), "pass").when(F.col("attempt") <= most, "retry").otherwise("fallback")).drop("_w")
