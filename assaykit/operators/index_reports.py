"""A yearly index report: titles within pages, pages of figures and notes left out, short sections merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import FRONT_SECTIONS, INDEX_CHUNK, INDEX_LAST_PAGE, INDEX_LEAST_CHARS, INDEX_NOISE_MARKERS, INDEX_TITLE
from ..functions import reports
from ..functions.patents import let
from . import documents, reports as report_rows


def title_of(heading: Column, text: Column) -> Column:
    """The heading; for a mere page, the first title in its first eight lines: a numbered one, what stands before a bar beside the report's name, or a line in capitals."""

    def one(line: Column) -> Column:
        parts = F.filter(F.transform(F.split(line, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
        named = F.contains(line, F.lit(INDEX_TITLE)) & F.contains(line, F.lit("|"))
        shouted = (F.upper(line) == line) & line.rlike(r"\p{L}")
        found = F.coalesce(reports.numbered_heading(line), F.when(named & (F.size(parts) >= 2), F.substring(F.get(parts, F.lit(0)), 1, 100)), F.when(shouted, F.substring(line, 1, 100)))
        return F.when(F.length(line) >= 8, found)

    titles = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 8), lambda x: let(F.trim(x), one)), lambda x: x.isNotNull())
    return F.when(F.lower(heading).startswith("page "), F.coalesce(F.get(titles, F.lit(0)), heading)).otherwise(heading)


def is_noise(heading: Column, text: Column, page: Column) -> Column:
    """A section behind the body, of a kind that is no text, or with nothing but figures, notes or running heads."""
    head = F.lower(F.concat_ws("\n", heading, F.substring(text, 1, 1_200)))
    marked = F.exists(F.array(*map(F.lit, INDEX_NOISE_MARKERS)), lambda m: F.contains(head, m))
    return F.coalesce(page > INDEX_LAST_PAGE, F.lit(False)) | marked | reports.is_no_prose(text, INDEX_TITLE)


def merged(rows: DataFrame, key: str, least: int = INDEX_LEAST_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sections shorter than `least` joined to the one before, where heading and page are the same. keep: more columns, of each the first section's."""
    own = Window.partitionBy(key).orderBy("section_no")
    joins = (F.length("text") < least) & (F.col("heading") == F.lag("heading").over(own)) & F.col("page").eqNullSafe(F.lag("page").over(own)) & (F.row_number().over(own) > 1)
    grouped = rows.withColumn("_joins", F.coalesce(joins, F.lit(False))).withColumn("_g", F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(own))
    held = grouped.groupBy(key, "_g").agg(F.min(F.struct("section_no", "heading", "page", "industry", *keep)).alias("_h"), F.array_sort(F.collect_list(F.struct("section_no", "text"))).alias("_t"))
    text = documents.clean_section(F.array_join(F.transform("_t", lambda x: x["text"]), "\n"))
    return held.select(key, *(f"_h.{c}" for c in keep), "_h.section_no", "_h.heading", "_h.page", "_h.industry", text.alias("text"))


def sections(df: DataFrame, key: str, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to keep, section_no, heading, page, industry, text of the sections worth keeping."""
    cut = report_rows.kept(report_rows.sections(df, key, column, keep=keep))
    rows = cut.withColumn("heading", title_of(F.col("heading"), F.col("text"))).withColumn("industry", F.lit("AI"))
    rows = rows.where(~F.coalesce(is_noise(F.col("heading"), F.col("text"), F.col("page")), F.lit(False))).withColumn("text", reports.without_chart_tail(F.col("text")))
    return merged(rows, key, keep=keep)


def chunks(df: DataFrame, key: str, column: str, source: str, year: str) -> DataFrame:
    """Chunks of 500 tokens that are prose, with ids."""
    rows = sections(df, key, column, (source, year))
    out = report_rows.chunks(rows, key, source, year, size=INDEX_CHUNK[0], overlap=INDEX_CHUNK[1])
    return out.where(~F.coalesce(reports.is_no_prose(F.col("text"), INDEX_TITLE), F.lit(False)))


def front_section(text: Column) -> Column:
    """The first part of the front matter that a page names, or null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(F.contains(low, F.lit(n.lower())), n) for n in FRONT_SECTIONS))


def source_name(name: Column, known: dict[str, tuple[str, ...]]) -> Column:
    """A report's name: the known one whose words are all in it; else of a file its stem as a title; else as it is."""
    low = F.lower(name)
    out = F.when(F.lit(False), name)
    for title, words in known.items():
        hit = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            hit = hit & F.contains(low, F.lit(w))
        out = out.when(hit, F.lit(title))
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)\.[^./]*$", 1), "[-_]", " ")
    return out.when(low.endswith(".pdf"), F.initcap(F.trim(stem))).otherwise(name)
