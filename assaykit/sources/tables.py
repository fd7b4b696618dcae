"""Sources and sinks. Everything is read by Spark, so any store that it knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import dedupe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a given schema; a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_with_errors(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the text of bad lines; blank lines are neither."""
    bad = "_corrupt_record"
    full = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", parsed.alias("row"))
    return rows.where(f"row.{bad} IS NULL").select(*(F.col(f"row.`{f.name}`") for f in schema)), rows.where(f"row.{bad} IS NOT NULL").select(F.col("value").alias(bad))


def xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """XML rows with a given schema: arrays are arrays even with one element."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A database query; filters and columns are pushed into it."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def lookup(df: DataFrame, *, order: tuple[str, ...] = (), **identifiers: object) -> DataFrame:
    """At most one row by the first identifier that is given, in the order of the arguments; of several rows the first by order, else by all columns."""
    for column, value in identifiers.items():
        if value not in (None, ""):
            return df.where(F.col(column) == F.lit(value)).orderBy(*(order or df.columns)).limit(1)
    raise ValueError("no identifier given")


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def shuffled(df: DataFrame, seed: int, limit: int) -> DataFrame:
    """A random order that the seed repeats on equal partitions."""
    return df.orderBy(F.rand(seed)).limit(limit)


def checked(df: DataFrame, code: str = "code", message: str = "message") -> DataFrame:
    """df with ok: a response's code is blank or one of those that mean success."""
    good = F.coalesce(F.upper(F.trim(F.col(code))), F.lit("")).isin("", "00", "0", "000", "SUCCESS") & ((F.coalesce(F.trim(F.col(code)), F.lit("")) != "") | (F.coalesce(F.trim(F.col(message)), F.lit("")) == ""))
    return df.withColumn("ok", good)


def _filesystem(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the last version that `upsert` wrote under path, or None."""
    fs, pointer = _filesystem(spark, f"{path.rstrip('/')}/_current")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return f"{path.rstrip('/')}/{bytes(stream.readAllBytes()).decode().strip()}"
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, version: str) -> None:
    fs, pointer = _filesystem(spark, f"{path.rstrip('/')}/_current")
    stream = fs.create(pointer, True)
    stream.write(version.encode())
    stream.close()


def replace(spark: SparkSession, path: str, new: DataFrame, version: str) -> str:
    """Write rows as a version of their own under path and point to it; versions before stay readable."""
    out = f"{path.rstrip('/')}/{version}"
    new.write.mode("errorifexists").parquet(out)
    _point(spark, path, version)
    return out


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str, fields: list[str], version: str) -> str:
    """Merge new rows into the last version under path by key, write that as a version of its own and point to it; versions before stay readable.

    One writer at a time: the pointer is replaced, not compared."""
    last, schema = current(spark, path), new.select(key, *fields).schema
    old = spark.read.parquet(last) if last else spark.createDataFrame([], schema)
    out = f"{path.rstrip('/')}/{version}"
    dedupe.merge_keyed(old, new, key, fields).drop("status").write.mode("errorifexists").parquet(out)
    _point(spark, path, version)
    return out


def write_runs(df: DataFrame, path: str, by: str) -> None:
    """One folder of JSON lines for each run."""
    df.write.mode("append").partitionBy(by).json(path)
