"""Nested records: raw payloads to common rows, paths, merges that ignore blanks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, text


def evidence(df: DataFrame, items: str, *, kind: str, url: Column, title: Column, content: Column, published: Column, source: Column, **more: Column) -> DataFrame:
    """Explode an array of provider items to common evidence rows, rank from 1. The columns are expressions over `item`."""
    rows = df.select("*", F.posexplode_outer(items).alias("_p", "item")).where("item IS NOT NULL")
    out = {"source_type": F.lit(kind), "url": text.present(url), "title": text.strip_html(title), "content": text.strip_html(content), "published_at": published, "source": source, "rank": F.col("_p") + 1, **more}
    return rows.select(*(c for c in df.columns if c != items), *(c.alias(n) for n, c in out.items()))


def news_search(df: DataFrame, items: str = "items") -> DataFrame:
    """Items of title, originallink, link, description, pubDate (RFC 2822)."""
    i = F.col("item")
    return evidence(df, items, kind="news", url=text.first_present(i["originallink"], i["link"]), title=i["title"], content=text.first_present(i["description"], i["title"]), published=dates.rfc2822(i["pubDate"]), source=F.lit("news_search"))


def news_articles(df: DataFrame, items: str = "articles") -> DataFrame:
    """Articles of title, url, description, content, publishedAt (ISO), source{name}."""
    i = F.col("item")
    return evidence(df, items, kind="news", url=i["url"], title=i["title"], content=text.first_present(i["content"], i["description"], i["title"]), published=dates.iso(i["publishedAt"]), source=text.present(i["source"]["name"]))


def web_results(df: DataFrame, items: str = "results") -> DataFrame:
    """Results of title, url, content, raw_content, published_date (RFC 2822 or ISO), score."""
    i = F.col("item")
    return evidence(df, items, kind="news", url=i["url"], title=i["title"], content=text.first_present(i["raw_content"], i["content"], i["title"]), published=F.coalesce(dates.rfc2822(i["published_date"]), dates.iso(i["published_date"])), source=F.lit("web"), score=i["score"])


def evidence_id(prefix: str, position: Column, *fields: Column) -> Column:
    """A stable id: prefix, three-digit position, eight hex digits of a digest of the fields joined by bars."""
    joined = F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields))
    return F.concat(F.lit(f"{prefix}_"), F.lpad(position.cast("string"), 3, "0"), F.lit("_"), F.substring(F.sha2(joined, 256), 1, 8))


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """base with the values of over where those are not blank; columns that only over has come along."""
    b, o = base.alias("b"), over.alias("o")
    joined = b.join(o, F.col(f"b.{key}") == F.col(f"o.{key}"), "left")

    def merged(name: str) -> Column:
        if name == key or name not in over.columns:
            return F.col(f"b.{name}")
        if name not in base.columns:
            return F.col(f"o.{name}").alias(name)
        new, kind = F.col(f"o.{name}"), over.schema[name].dataType.typeName()
        if kind == "string":
            new = text.present(new)
        elif kind == "array":
            new = F.when(F.size(new) > 0, new)
        return F.coalesce(new, F.col(f"b.{name}")).alias(name)

    return joined.select(*map(merged, [*base.columns, *(c for c in over.columns if c not in base.columns)]))


def union_lists(*lists: Column) -> Column:
    """Distinct values of some arrays in order; null arrays count as empty."""
    return F.array_distinct(F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists))))


def path(c: Column, *keys: str) -> Column:
    """A value of JSON text by path, as text; null where anything is missing or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(c), "$." + ".".join(keys), "string")


def compact(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """df with long texts and arrays cut to their limits."""
    cut = lambda n, k: F.slice(n, 1, k) if df.schema[n].dataType.typeName() == "array" else F.substring(n, 1, k)
    return df.withColumns({n: cut(n, k) for n, k in limits.items()})
