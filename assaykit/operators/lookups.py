"""Lookups by keys in order of preference, and evidence by the ids that cite it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text


def probe(rows: DataFrame, key: str, candidates: Column, table: DataFrame, at: str, values: list[str]) -> DataFrame:
    """rows with the values of the first of their candidate keys that table knows, and found_key; null where none is known.

    Candidates are exploded with their place and meet the table in one equi-join; the smallest place wins. Of several rows under one key the smallest values win."""
    tried = rows.select(key, F.posexplode(candidates).alias("place", "_k"))
    known = table.groupBy(F.col(at).alias("_k")).agg(F.min(F.struct(*values)).alias("v"))
    best = tried.join(known, "_k").groupBy(key).agg(F.min(F.struct("place", "_k", "v")).alias("b"))
    return rows.join(best, key, "left").select(*rows.columns, F.col("b._k").alias("found_key"), *(F.col(f"b.v.{v}").alias(v) for v in values))


def probe_loosely(rows: DataFrame, key: str, country: str, number: str, kind: str, table: DataFrame, at: str) -> DataFrame:
    """For rows without an exact key: the smallest key of table that begins with the country and holds the digits and the kind.

    Both sides meet on country and on the digits' last six, which any key that holds the digits has somewhere: its runs of six are its join keys."""
    tight = F.upper(F.regexp_replace(at, "-", ""))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("_t") - 5, F.lit(1))), lambda i: F.substring(F.col("_t"), i, F.lit(6)))
    keys = table.select(F.col(at).alias("_key"), tight.alias("_t")).distinct().select("_key", "_t", F.substring("_t", 1, 2).alias("_c"), F.explode(F.array_distinct(runs)).alias("_r"))
    digits = F.regexp_replace(F.coalesce(number, F.lit("")), "[^0-9]", "")
    asked = rows.select(key, F.upper(country).alias("_c"), digits.alias("_d"), F.upper(F.coalesce(kind, F.lit(""))).alias("_kind")).where(F.length("_d") >= 6)
    hit = asked.withColumn("_r", F.substring("_d", -6, 6)).join(keys, ["_c", "_r"]).where(F.contains("_t", "_d") & F.contains("_t", "_kind"))
    return rows.join(hit.groupBy(key).agg(F.min("_key").alias("found_key")), key, "left")


def first_of_kinds(matches: DataFrame, key: str, kind: str, order: list[str], *columns: str) -> DataFrame:
    """Of each key only the matches of the first search kind that found anything, in that kind's order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(kind))
    ranked = matches.where(place > 0).withColumn("_p", place)
    best = ranked.groupBy(key).agg(F.min("_p").alias("_p"))
    return ranked.join(best, [key, "_p"]).select(key, kind, *columns)


def search_order(kind_code: Column) -> Column:
    """Search kinds to try for a document by its kind code: publications first for A, registrations first for B."""
    code = F.upper(F.coalesce(kind_code, F.lit("")))
    a, b = ["open_number", "publication_number", "register_number"], ["register_number", "publication_number", "open_number"]
    lists = lambda x: F.array(*map(F.lit, x))
    return F.when(code.startswith("A"), lists(a)).when(code.startswith("B"), lists(b)).otherwise(lists(["application_number", *a]))


def cited_details(cited: DataFrame, evidence: DataFrame, *, by: str, ids: str, most: int = 5, chars: int = 500) -> DataFrame:
    """For each row the first `most` of its cited ids that evidence knows, in their order: place, evidence_id, text, source and url.

    evidence: evidence_id, seq, title, summary, context, content, source, url; the first row of an id counts."""
    one = evidence.groupBy("evidence_id").agg(F.min_by(F.struct("title", "summary", "context", "content", "source", "url"), "seq").alias("e"))
    words = text.first_present(*(F.col(f"e.{c}") for c in ("title", "summary", "context", "content", "source")), F.col("evidence_id"))
    asked = cited.select(by, F.posexplode(ids).alias("_at", "evidence_id")).join(one, "evidence_id")
    place = F.row_number().over(Window.partitionBy(by).orderBy("_at"))
    out = asked.select(by, place.alias("place"), "evidence_id", F.substring(words, 1, chars).alias("text"), text.first_present(F.col("e.title"), F.col("e.source")).alias("source"), F.col("e.url").alias("url"))
    return out.where(F.col("place") <= most)


def external_sources(references: DataFrame, *, by: str, order: str) -> DataFrame:
    """Distinct (title, url) of references, in the order in which they first come; a missing title is the source's name."""
    firsts = references.groupBy(by, "title", "url").agg(F.min(F.struct(order, "source")).alias("f"))
    return firsts.select(by, F.coalesce(text.present(F.col("title")), F.col("f.source")).alias("title"), "url", F.col(f"f.{order}").alias(order))


def references(evidence: DataFrame, cited: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Evidence of the given kinds that any axis cites, with the axes that do. cited: evidence_id, axis."""
    axes = cited.groupBy("evidence_id").agg(F.array_sort(F.collect_set("axis")).alias("cited_by_axes"))
    return evidence.where(F.col("source_type").isin(*kinds)).join(axes, "evidence_id")
