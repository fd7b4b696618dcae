"""First per key, merge per key, and joins against what is known. `seq` fixes which row is first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text


def first_per_key(df: DataFrame, key: Column | list[Column], *order: str, keep_blank: bool = False) -> DataFrame:
    """The first row of each key; keep_blank: rows without a key all stay."""
    keys = key if isinstance(key, list) else [key]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = df.withColumn("_n", n)
    keep = F.col("_n") == 1
    if keep_blank:
        keep |= reduce(lambda a, b: a & b, [text.present(k.cast("string")).isNull() for k in keys])
    return rows.where(keep).drop("_n")


def ordered_distinct(df: DataFrame, by: list[str], value: str, order: str, name: str) -> DataFrame:
    """Each group's distinct non-blank values in the order in which they first come: aggregated by value first, so no row list is ever held."""
    firsts = df.where(text.present(F.col(value).cast("string")).isNotNull()).groupBy(*by, value).agg(F.min(order).alias("_o"))
    return firsts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias(name))


def union_sources(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Sources in their order as one table with origin and rank of origin."""
    rows = [df.select(*columns, F.lit(name).alias("origin"), F.lit(i).alias("origin_rank")) for i, (name, df) in enumerate(parts.items())]
    return reduce(DataFrame.unionByName, rows)


def unknown(new: DataFrame, known: DataFrame, identities: list[str]) -> DataFrame:
    """Rows of new that share none of the identities with a known row; blank identities match nothing. One anti join for each identity."""
    out = new
    for name in identities:
        seen = known.select(text.present(F.col(name)).alias("_k")).where("_k IS NOT NULL").distinct()
        out = out.join(seen, text.present(F.col(name)) == F.col("_k"), "left_anti")
    return out


def merge_keyed(old: DataFrame, new: DataFrame, key: str, fields: list[str], *, stamp: Column | None = None) -> DataFrame:
    """Upsert: new values win where they are there; created stays, updated is stamp for rows that new has."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    status = F.when(F.col(f"o.{key}").isNull(), "inserted").when(F.col(f"n.{key}").isNull(), "kept").otherwise("updated")
    out = [F.coalesce(f"n.{key}", f"o.{key}").alias(key), *(F.coalesce(f"n.{f}", f"o.{f}").alias(f) for f in fields), status.alias("status")]
    if stamp is not None:
        out.append(F.when(status != "kept", stamp).otherwise(F.col("o.updated_at") if "updated_at" in old.columns else F.lit(None)).alias("updated_at"))
    return joined.select(*out)


def citations(df: DataFrame) -> DataFrame:
    """Citations (patent, seq, original, country, number, kind, standard, type) to one row for each document.

    A row that is not standardised joins the standardised one with the same original number; types are an ordered union.
    """
    original = F.upper(F.regexp_replace("original", r"\s+", ""))
    rows = df.withColumn("_original", original).where(F.coalesce(text.present(F.col("number")), text.present(F.col("original"))).isNotNull())
    standard = rows.where("standard").groupBy("patent", "_original").agg(F.min(F.struct("seq", F.concat_ws("|", "country", "number", "kind").alias("k"))).alias("s"))
    keyed = rows.join(standard, ["patent", "_original"], "left").withColumn("key", F.when(F.col("standard"), F.concat_ws("|", "country", "number", "kind")).otherwise(F.coalesce("s.k", "_original"))).drop("s")
    by_type = keyed.groupBy("patent", "key", "type").agg(F.min("seq").alias("_o"), F.bool_or("standard").alias("_s"))
    named = F.collect_list(F.when(text.present(F.col("type").cast("string")).isNotNull(), F.struct("_o", "type")))
    types = F.transform(F.array_sort(named), lambda x: x["type"])
    merged = by_type.groupBy("patent", "key").agg(F.min("_o").alias("seq"), F.bool_or("_s").alias("standard"), types.alias("types"))
    return merged.withColumn("types", F.when(F.size("types") > 0, F.col("types")))


def citation_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("patent").agg(F.count("*").alias("total"), F.count_if("standard").alias("standardised"), F.count_if(~F.col("standard")).alias("other"))
