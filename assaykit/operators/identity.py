"""Rows that are one thing under several names: by address, number or title, and by chains of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..sources.shared import delete, shared_dir, stored


def identity_values(**names: Column) -> Column:
    """The identities of a row, as kind:value; blank ones are none."""
    every = F.array(*(F.when(text.present(c.cast("string")).isNotNull(), F.concat(F.lit(f"{kind}:"), F.trim(c.cast("string")))) for kind, c in names.items()))
    return F.filter(every, lambda x: x.isNotNull())


def first_identity(title: Column, day: Column, **numbers: Column) -> Column:
    """The first number that is there, with its kind; else title and day."""
    return F.coalesce(F.get(identity_values(**numbers), F.lit(0)), F.concat_ws(":", F.coalesce(title, F.lit("")), F.coalesce(day.cast("string"), F.lit(""))))


def composite_identity(*fields: Column) -> Column:
    """All fields joined by bars; missing ones are empty."""
    return F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields))


def entities(df: DataFrame, key: str, identities: str) -> DataFrame:
    """key and entity: the smallest key that can be reached over shared identities, itself included. key is unique and not null.

    Each round takes for every identity the smallest label among its rows, for every row the smallest among its identities', and then
    that label's own label, which doubles the steps. An identity that most rows have is one row of each task after partial sums; its
    label goes back by a join in which adaptive execution splits the large side. Rounds end when nothing changes."""
    spark = df.sparkSession
    links_path, path = shared_dir(spark, "identities"), shared_dir(spark, "entities")
    pairs = df.select(F.col(key).alias("id"), F.explode(F.array_distinct(identities)).alias("identity"))
    shared = pairs.groupBy("identity").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("identity")
    links = stored(pairs.join(shared, "identity", "left_semi"), links_path)
    labels, moved = stored(links.select("id").distinct().withColumn("label", F.col("id")).withColumn("moved", F.lit(True)), path), True
    while moved:
        held = labels.select("id", "label")
        of_identity = links.join(held, "id").groupBy("identity").agg(F.min("label").alias("label"))
        near = links.join(of_identity, "identity").groupBy("id").agg(F.min("label").alias("label"))
        jump = held.select(F.col("id").alias("label"), F.col("label").alias("next"))
        step = near.join(jump, "label", "left").select("id", F.least("label", "next").alias("label"))
        last, path = path, shared_dir(spark, "entities")
        labels = stored(step.join(held.withColumnRenamed("label", "was"), "id").select("id", "label", (F.col("label") != F.col("was")).alias("moved")), path)
        moved = labels.where("moved").limit(1).count() > 0
        delete(spark, last)
    delete(spark, links_path)
    return df.select(F.col(key)).join(labels.select(F.col("id").alias(key), "label"), key, "left").select(key, F.coalesce("label", key).alias("entity"))
