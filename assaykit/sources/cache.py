"""A store of results by their inputs' content: what was computed once is looked up.

Entries are immutable Parquet parts in folders of their own, so any number of writers add to a store at once and none loses an entry;
readers see a part when its folder is renamed into place, which is one step on HDFS and local disks (object stores need a put on
condition instead). Of several entries under one key the last one written counts. Parts that can't be read and values that are no JSON
object are misses, which the next fill mends.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import delete

_ENTRY = "key string, value string, written long"
_USE = "key string, used long"


def content_key(*inputs: Column, model: str = "", effort: str = "") -> Column:
    """sha256 of the inputs, the model and its effort, joined by NUL; a null input is empty. Other contents or another model give another key, whatever the row's id."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in inputs]
    return F.sha2(F.concat_ws("\x00", *parts, F.lit(model), F.lit(effort)), 256)


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.lit(False))


class ResultCache:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self, kind: str) -> list[str]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/{kind}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(x.getPath().toString() for x in fs.listStatus(root)) if fs.exists(root) else []

    def _read(self, kind: str, schema: str) -> DataFrame:
        folders = self._folders(kind)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(*folders)

    def _add(self, kind: str, rows: DataFrame) -> None:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/_writing/{name}")
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(hadoop.Path(f"{self.path}/{kind}"))
        if not fs.rename(hadoop.Path(f"{self.path}/_writing/{name}"), hadoop.Path(f"{self.path}/{kind}/{name}")):
            raise OSError(f"could not add {name} to {self.path}/{kind}")

    def entries(self) -> DataFrame:
        """key, value, written: the last whole entry of each key."""
        whole = self._read("entries", _ENTRY).where(_is_object(F.col("value")))
        return whole.groupBy("key").agg(F.max(F.struct("written", "value")).alias("e")).select("key", "e.value", "e.written")

    def lookup(self, df: DataFrame, key: str) -> DataFrame:
        """df with cached: the value under its key, or null. Rows keep their number whatever the store holds."""
        return df.join(self.entries().select(F.col("key").alias(key), F.col("value").alias("cached")), key, "left")

    def put(self, rows: DataFrame, key: str, value: str) -> None:
        self._add("entries", rows.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("value"), F.lit(time.time_ns()).alias("written")))

    def fill(self, df: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], value: str = "reply") -> DataFrame:
        """df with `value` from the store; what misses is computed once for each key, stored, and read from there.

        compute gets one row of df for each key that misses and returns them with `value`; null values stay misses. Keys that were asked for are marked as used."""
        wanted = df.where(F.col(key).isNotNull()).dropDuplicates([key])
        misses = wanted.join(self.entries().select(F.col("key").alias(key)), key, "left_anti")
        if misses.limit(1).count():
            self.put(compute(misses), key, value)
        self._add("uses", wanted.select(F.col(key).alias("key"), F.lit(time.time_ns()).alias("used")))
        return self.lookup(df, key).withColumnRenamed("cached", value)

    def evict(self, keep: int) -> None:
        """Keep the `keep` entries that were used or written last. Entries that others add meanwhile stay."""
        entries, uses = self._folders("entries"), self._folders("uses")
        used = self._read("uses", _USE).groupBy("key").agg(F.max("used").alias("used"))
        rows = self.entries().join(used, "key", "left").withColumn("last", F.greatest("written", F.coalesce("used", "written")))
        kept = rows.orderBy(F.desc("last"), "key").limit(keep)
        self._add("entries", kept.select("key", "value", "written"))
        self._add("uses", self.entries().join(used, "key").select("key", "used"))
        for folder in [*entries, *uses]:
            delete(self.spark, folder)
