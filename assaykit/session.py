"""Sessions with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, name: str = "assaykit", **conf: str) -> SparkSession:
    """UTC time zone and adaptive execution; on a cluster leave master out and let spark-submit decide."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
