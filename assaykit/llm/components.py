"""Connected components of an edge table by alternating large-star and small-star steps, each stored before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import delete, shared_dir, stored


def components(edges: DataFrame) -> DataFrame:
    """edges: two long columns. Returns id, component (the smallest id in reach) of all ids in edges. Loops and repeats do no harm."""
    a, b = edges.columns
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    spark, path = edges.sparkSession, shared_dir(edges.sparkSession, "edges")
    now, before = stored(now, "edges", path), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        last, path = path, shared_dir(spark, "edges")
        now = stored(small, "edges", path)
        delete(spark, last)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    # every edge now leads to the smallest id
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
