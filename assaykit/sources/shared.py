"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application: the folder of a session on one machine that sets none.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under spark.checkpoint.dir; only a session on one machine may leave that unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _local:
            _local[app] = f"file://{tempfile.mkdtemp(prefix='assaykit-')}"
        base = _local[app]
    return f"{base.rstrip('/')}/assaykit-{app}/{purpose}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df and read it back: cuts the lineage, and lost executors take nothing with them."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
