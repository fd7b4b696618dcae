"""From raw documents to token counts: five stages, each stored as Parquet and read back before the next.

Every stage works on all that the one before kept, and all but the last return the columns of documents. Other columns come
through as they are, whatever their names. Empty tables give empty ones; texts of any length are read whole; rows with null ids
are kept and dropped like others:

1. language: documents whose language can't be told (no text, no letters) go; of the rest, rows without a label get the prediction.
2. near copies: rows are grouped by their texts alone, with the n-gram Jaccard join over numbers of rows. One row of each group
   stays, the one with the smallest id (null ids come last; rows of one id by a hash of their columns, then by number). So repeated rows and
   copies under null ids become one, and different texts under one id stay apart. Texts without words all stay.
3. decontamination: documents that contain a benchmark item go; null and empty texts contain none. Repeated rows go or stay alike.
4. secrets: secrets in texts are replaced by a mark, and n_chars is counted anew where a text changed. Null texts stay null.
5. tokens: byte-level BPE, encoded and decoded; the digests of the operator's query. A null text counts as empty. One row for each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assaykit.llm import bpe, decontaminate, jaccard, langid, secrets
from assaykit.llm.common import stored, table
from assaykit.llm.queries import byte_codec

#: SQL has no suffix automata, CRFs or BPE; tests hold the stages against brute force instead.
ORACLE_SQL = None


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under column names that no operator uses, and these names by the real ones."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, c = _plain(docs)
    sample = langid.labelled_sample(plain, langid.crc_remainder(c["doc_id"]) != 2, doc_id=c["doc_id"], text=c["text"], lang=c["lang"])
    found = langid.identify(plain, sample, text=c["text"]).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn(c["lang"], F.coalesce(c["lang"], "lang_pred")).select(*c.values()).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, c = _plain(docs)
    numbered = stored(plain.withColumn("row", F.monotonically_increasing_id()), "numbered")
    key = F.col(c["doc_id"])
    order = numbered.select("row", F.struct(key.isNull().alias("unnamed"), key.alias("doc_id"), F.xxhash64(*c.values()).alias("hash"), "row").alias("order"))
    groups = stored(jaccard.groups(numbered, doc_id="row", text=c["text"]).select(F.col("doc_id").alias("row"), "component_id"), "groups")
    kept = groups.join(order, "row").groupBy("component_id").agg(F.min("order")["row"].alias("kept"), F.count("*").alias("rows")).where("rows > 1")
    dropped = stored(groups.join(kept, "component_id").where("row != kept").select(F.col("row").alias("id")), "dropped")
    return jaccard.without(numbered.withColumnRenamed("row", "id"), dropped).select(*c.values()).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, c = _plain(docs)
    marked = secrets.redact(plain.withColumn("before", F.col(c["text"])), text=c["text"])
    length = F.length(c["text"]).cast(docs.schema["n_chars"].dataType)
    changed = ~F.col(c["text"]).eqNullSafe(F.col("before"))
    return marked.withColumn(c["n_chars"], F.when(changed, length).otherwise(F.col(c["n_chars"]))).select(*c.values()).toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, byte_codec()).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("near_copies", near_copies), ("decontamination", decontamination), ("secrets", secret_scan), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
