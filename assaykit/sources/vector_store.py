"""A store of embedded chunks in versions: built from JSON lines, upserted by chunk, searched by cosine under filters.

Vectors are columns; a search is a filter, a projection and a limited sort that Spark distributes. Each write is a version of its own
(`tables.upsert`), so a reader of the last one is never in its way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text, vectors
from ..operators import ranking
from . import tables

_FIELDS = ["text", "industry", "heading", "source_name", "metadata", "embedding"]
CHUNKS = "chunk_id string, text string, metadata map<string,string>"


def embedding_text(body: Column, industry: Column, heading: Column) -> Column:
    """What is embedded: industry, heading and text on lines of their own, blank ones left out."""
    return F.concat_ws("\n", F.nullif(industry, F.lit("")), F.nullif(heading, F.lit("")), F.nullif(body, F.lit("")))


def embedding_tokens(c: Column) -> Column:
    """Words of two characters or more, then all runs of three Hangul syllables of the text without the rest; repeats stay."""
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("([0-9a-zA-Z가-힣]{2,})"), 1)
    hangul = F.regexp_replace(low, "[^가-힣]", "")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(hangul) - 2, F.lit(1))), lambda i: i <= F.length(hangul) - 2)
    return F.concat(words, F.transform(starts, lambda i: F.substring(hangul, i, F.lit(3))))


def literal(vector: Column) -> Column:
    """A vector as text for a database, to length 1, ten significant digits."""
    number = lambda x: F.regexp_replace(F.format_string("%.10g", x), r"(\.[0-9]*?)0+$", "$1")
    return F.concat(F.lit("["), F.array_join(F.transform(vectors.normalised(vector), lambda x: F.regexp_replace(number(x), r"\.$", "")), ","), F.lit("]"))


def dimension(rows: DataFrame, column: str = "embedding") -> int:
    """The vectors' one dimension; raises where there is none, an empty vector or several."""
    low, high = rows.agg(F.min(F.coalesce(F.size(column), F.lit(0))), F.max(F.coalesce(F.size(column), F.lit(0)))).first()
    if low is None:
        raise ValueError("no embeddings to index")
    if low <= 0:
        raise ValueError("an embedding vector is empty")
    if low != high:
        raise ValueError("all embeddings must have the same dimension")
    return low


class VectorStore:
    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column], model: str):
        """embed: from a column of texts to one of vectors; model: its name, which each chunk's metadata holds."""
        self.spark, self.path, self.embed, self.model = spark, path, embed, model

    def prepared(self, chunks: DataFrame) -> DataFrame:
        """chunks (chunk_id, text, metadata) with their vectors and with chunk_id and model in the metadata; of repeated ids the one whose text sorts first."""
        one = chunks.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.min(F.struct("text", F.to_json("metadata").alias("m"))).alias("c")).select("chunk_id", "c.text", F.from_json("c.m", "map<string,string>").alias("metadata"))
        own = F.create_map(F.lit("chunk_id"), F.col("chunk_id"), F.lit("embedding_model"), F.lit(self.model))
        held = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("chunk_id", "embedding_model"))
        rows = one.withColumn("metadata", F.map_concat(held, own))
        rows = rows.withColumns({n: F.try_element_at("metadata", F.lit(n)) for n in ("industry", "heading", "source_name")})
        return rows.withColumn("embedding", self.embed(embedding_text(F.col("text"), F.col("industry"), F.col("heading")))).withColumn("metadata", F.to_json("metadata"))

    def upsert(self, chunks: DataFrame, version: str, *, reset: bool = False) -> int:
        """Add or replace chunks; reset: only these stay. Returns how many there were."""
        rows = self.prepared(chunks).select("chunk_id", *_FIELDS)
        n = rows.count()
        if not n:
            return 0
        dimension(rows)
        if reset:
            tables.replace(self.spark, self.path, rows, version)
        else:
            tables.upsert(self.spark, self.path, rows, "chunk_id", _FIELDS, version)
        return n

    def build(self, jsonl: str, version: str) -> int:
        """The store anew from JSON lines of chunks; a bad line fails the job."""
        return self.upsert(tables.jsonl(self.spark, jsonl, CHUNKS), version, reset=True)

    def rows(self) -> DataFrame:
        path = tables.current(self.spark, self.path)
        if path is None:
            raise ValueError("nothing was stored yet")
        return self.spark.read.parquet(path)

    def search(self, query: list[float], *, k: int = 5, industry: str | None = None, industries: list[str] | None = None, source_name: str | None = None) -> DataFrame:
        """chunk_id, text, metadata, similarity of the k nearest chunks. industries wins over industry; an empty list finds nothing."""
        where = F.lit(True)
        if industries is not None:
            where = F.col("industry").isin(*industries) if industries else F.lit(False)
        elif industry is not None:
            where = F.col("industry") == industry
        if source_name is not None:
            where = where & (F.col("source_name") == source_name)
        return ranking.top_cosine(self.rows(), query, vector="embedding", key="chunk_id", k=k, where=where, places=None).select("chunk_id", "text", "metadata", "similarity")


def as_evidence(hits: DataFrame) -> DataFrame:
    """Search hits as evidence rows: title of source and heading, published_at from the metadata's year, the text as context."""
    of = lambda n: F.get_json_object("metadata", f"$.{n}")
    title = F.concat_ws(" - ", text.present(of("source_name")), text.present(of("heading")))
    return hits.select(F.lit("industry_report").alias("source_type"), title.alias("title"), of("published_year").alias("published_at"), F.col("text").alias("context"), of("industry").alias("industry"), "chunk_id", "similarity")
