"""Logic by position: running numbers, values carried forward, islands, and merging of short neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def numbered(df: DataFrame, by: list[str], *order: str, name: str = "no") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def carried(df: DataFrame, by: list[str], order: str, values: dict[str, Column]) -> DataFrame:
    """df with the last non-null value so far of each expression."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({n: F.last(c, ignorenulls=True).over(w) for n, c in values.items()})


def islands(df: DataFrame, by: list[str], order: str, starts: Column, name: str = "island") -> DataFrame:
    """df with a number that grows by one at each row that starts an island; rows before the first are island 0."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def runs(df: DataFrame, by: list[str], order: str, same: list[str], name: str = "run") -> DataFrame:
    """df with a number that changes whenever one of the columns does."""
    w = Window.partitionBy(*by).orderBy(order)
    changed = F.lit(False)
    for c in same:
        changed |= ~F.lag(c).over(w).eqNullSafe(F.col(c))
    first = F.row_number().over(w) == 1
    marked = df.withColumn("_s", F.when(first | changed, 1).otherwise(0))
    return marked.withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def ranges(df: DataFrame, by: list[str], start: str, offset: int = 0) -> DataFrame:
    """Distinct starts with the end before the next one; the last is open."""
    w = Window.partitionBy(*by).orderBy("start")
    return df.select(*by, (F.col(start) + offset).alias("start")).distinct().withColumn("end", F.lead("start").over(w) - 1)


def merge_short(df: DataFrame, by: list[str], order: str, text: str, least: int) -> DataFrame:
    """Sections shorter than least join the one before if the columns in by are the same. A chain of short ones all joins the last long one."""
    w = Window.partitionBy(*by).orderBy(order)
    starts = (F.row_number().over(w) == 1) | (F.length(text) >= least)
    grouped = df.withColumn("_s", F.when(starts, 1).otherwise(0)).withColumn("_g", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return grouped.groupBy(*by, "_g").agg(F.min(order).alias(order), F.array_join(F.transform(parts, lambda x: x[text]), "\n").alias(text), F.count("*").alias("merged")).drop("_g")
