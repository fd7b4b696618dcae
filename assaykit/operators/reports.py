"""Industry reports cut to chunks: sections with page, heading and industry carried forward, filtered, windowed, numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import CHAPTER_LINE, COMMON_INDUSTRY, REPORT_FIRST_PAGE
from ..functions import reports
from ..functions.arrays import scan
from ..functions.patents import let
from . import documents


def chapters(c: Column) -> Column:
    """Chapters of a report's table of contents: an array of page (one after the printed one) and industry, by page. Chapters of no known industry are left out."""
    lines = F.transform(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\x00"), F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    part = lambda x, i: F.regexp_extract(x, "(?U)" + CHAPTER_LINE, i)
    found = F.transform(F.filter(lines, lambda x: x.rlike("(?U)" + CHAPTER_LINE)), lambda x: F.struct((part(x, 2).cast("int") + 1).alias("page"), reports.industry_of(part(x, 1)).alias("industry")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x["industry"].isNotNull())))


def industry_at(chapters: Column, page: Column) -> Column:
    """The industry of the chapter that a page is in: the last that begins by then; null before the first."""
    return F.try_element_at(F.filter(chapters, lambda x: x["page"] <= page), F.lit(-1))["industry"]


def chapter_ranges(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, industry, first_page, last_page of each chapter; the last is open."""
    rows = df.select(key, F.posexplode(chapters(F.col(column))).alias("_n", "_c"), F.size(chapters(F.col(column))).alias("_all"))
    after = F.lead("_c.page").over(Window.partitionBy(key).orderBy("_n"))
    return rows.select(key, "_c.industry", F.col("_c.page").alias("first_page"), (after - 1).alias("last_page"))


def sections(df: DataFrame, key: str, column: str, first_page: int = REPORT_FIRST_PAGE, by_chapters: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, section_no, heading, page, industry, text of each report. A page mark and a heading each open a section; the page and the industry hold until the next one.

    An industry named in a heading counts from first_page on, or where no page is known. by_chapters: pages have the industry of their
    chapter in the table of contents, which wins over headings'. keep: more columns of df. All within the row."""
    mark = lambda line: let(F.trim(line), lambda x: F.coalesce(F.concat(F.lit("\x01"), reports.page_mark(x).cast("string")), F.when(x != "", reports.report_heading(x))))

    def carried(parts: Column, ranges: Column | None = None) -> Column:
        page_of = lambda p: F.when(p["heading"].startswith("\x01"), F.substring(p["heading"], 2, 9).cast("int"))

        def step(held: Column, p: Column) -> Column:
            own = page_of(p)
            page = F.coalesce(own, held["page"])
            named = F.when(own.isNull() & (page.isNull() | (page >= first_page)), reports.industry_of(p["heading"]))
            if ranges is not None:
                named = F.coalesce(F.when(own.isNotNull(), industry_at(ranges, page)), named)
            return F.struct(page.alias("page"), F.coalesce(named, held["industry"]).alias("industry"))

        def section(p: Column, held: Column) -> Column:
            heading = F.when(page_of(p).isNotNull(), F.concat(F.lit("Page "), page_of(p).cast("string"))).otherwise(F.coalesce(p["heading"], F.lit("문서 개요")))
            body = F.when(p["heading"].isNull(), p["lines"]).otherwise(F.slice(p["lines"], F.lit(2), F.greatest(F.size(p["lines"]), F.lit(1))))
            text = documents.clean_section(F.array_join(F.transform(body, lambda x: F.trim(x)), "\n"))
            industry = held["industry"] if ranges is None else F.coalesce(industry_at(ranges, held["page"]), held["industry"])
            return F.struct(p["section_no"].alias("section_no"), heading.alias("heading"), held["page"].alias("page"), industry.alias("industry"), text.alias("text"))

        none = F.struct(F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("industry"))
        return let(scan(parts, none, "struct<page:int,industry:string>", step), lambda held: F.transform(parts, lambda p, i: section(p, F.get(held, i))))

    parts = documents.marked_parts(F.col(column), mark)
    told = let(chapters(F.col(column)), lambda ranges: let(parts, lambda p: carried(p, ranges))) if by_chapters else let(parts, lambda p: carried(p))
    # outer: of an inner one Spark would ask the size first, and cut each report twice
    rows = df.select(key, *keep, F.explode_outer(told).alias("s"))
    return rows.select(key, *keep, "s.*").where("text != ''")


def kept(df: DataFrame, first_page: int = REPORT_FIRST_PAGE) -> DataFrame:
    """Sections worth keeping: from first_page on, below a table's heading from their body's start, without table lines, long enough."""
    table = reports.is_table_heading(F.col("heading"))
    body = F.when(table, reports.from_body_start(F.col("text"))).otherwise(F.col("text"))
    rows = df.where(F.col("page").isNull() | (F.col("page") >= first_page)).withColumn("text", body)
    rows = rows.withColumn("heading", F.when(table, F.coalesce(reports.body_heading(F.col("text")), F.lit("본문"))).otherwise(F.col("heading")))
    # a generator holds the text, since a filter on a plain column would move before it and clean it once more
    return rows.withColumn("text", F.explode_outer(F.array(documents.clean_section(reports.without_table_lines(F.col("text")))))).where(reports.keeps(F.col("text")))


def chunks(df: DataFrame, key: str, source: str, year: str, *, size: int = 1_000, overlap: int = 150) -> DataFrame:
    """Chunks of kept sections with ids; numbers grow within each report and industry in the order of sections."""
    industry = F.coalesce("industry", reports.industry_of(F.col("heading")), F.lit(COMMON_INDUSTRY))
    cut = documents.chunks(df.withColumn("industry", industry), "text", size, overlap).where(reports.keeps(documents.clean_section(reports.without_table_lines(F.col("chunk")))))
    number = F.row_number().over(Window.partitionBy(key, "industry").orderBy("section_no", "chunk_no"))
    return cut.withColumn("chunk_id", reports.chunk_id(F.col(source), F.col(year), F.col("industry"), F.col("page"), number)).withColumn("text", F.col("chunk")).drop("chunk")
