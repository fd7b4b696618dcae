"""Long documents: lines, headings, sections, claims, chunks, HTML."""

from __future__ import annotations

import html.parser
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import patents, text
from . import positional


def lines(df: DataFrame, key: str, column: str) -> DataFrame:
    """A row for each line: key, line_no from 1, line."""
    return df.select(key, F.posexplode(F.split(F.coalesce(column, F.lit("")), r"\r\n|\r|\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def marked_parts(column: Column, heading: Callable[[Column], Column]) -> Column:
    """The lines of a text as an array of (section_no, heading, first_line, last_line, lines): a line with a heading opens a section; lines before the first are section 0. Within the row, without a shuffle."""
    lines = patents.lines_of(column)

    def of(marked: Column) -> Column:
        starts = F.filter(F.transform(marked, lambda x, i: F.when(x["h"].isNotNull() | (i == 0), i)), lambda i: i.isNotNull())
        titled = lambda at: F.get(marked, at)["h"].isNotNull()

        def part(at: Column, starts: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(marked))
            number = k + F.when(titled(F.lit(0)), 1).otherwise(0)
            own = F.transform(F.slice(marked, at + 1, end - at), lambda x: x["line"])
            return F.struct(number.cast("long").alias("section_no"), F.get(marked, at)["h"].alias("heading"), (at + 1).alias("first_line"), end.alias("last_line"), own.alias("lines"))

        return patents.let(starts, lambda s: F.transform(s, lambda at, k: part(at, s, k)))

    return patents.let(F.transform(lines, lambda x: F.struct(x.alias("line"), heading(x).alias("h"))), of)


def markdown_heading(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, "^#{1,6}[ \t]+(.+)$", 1), F.lit(""))


def sections(df: DataFrame, key: str, column: str, heading: Callable[[Column], Column] = markdown_heading) -> DataFrame:
    """Lines gathered under the heading before them: key, section_no, heading, text. Text before the first heading has none.

    heading: gives a line's heading or null; by default Markdown headings."""
    rows = df.select(key, F.explode_outer(marked_parts(F.col(column), heading)).alias("s")).where("s IS NOT NULL")
    body = F.when(F.col("s.heading").isNull(), F.col("s.lines")).otherwise(F.slice("s.lines", 2, F.greatest(F.size("s.lines"), F.lit(1))))
    out = rows.select(key, "s.section_no", "s.heading", F.trim(F.array_join(body, "\n")).alias("text"))
    return out.where((F.col("section_no") > 0) | (F.col("text") != ""))


def named_sections(df: DataFrame, key: str, column: str, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """A column for each name with the text under a line that is one of its aliases; the last of repeats wins."""

    def name(line: Column) -> Column:
        bare = F.lower(F.trim(F.regexp_replace(line, r"^[#\s\[【]+|[\]】:\s]+$", "")))
        return patents.let(bare, lambda x: F.coalesce(*(F.when(x.isin(*(a.lower() for a in words)), n) for n, words in aliases.items())))

    found = sections(df, key, column, name).where("heading IS NOT NULL")
    return found.groupBy(key).agg(*(F.max_by(F.when(F.col("heading") == n, F.col("text")), F.when(F.col("heading") == n, F.col("section_no"))).alias(n) for n in aliases))


def claims(df: DataFrame, key: str, column: str) -> DataFrame:
    """Numbered claims `n. text` at line starts: claim_no, text, dependency (the first claim named), is_independent, is_deleted."""
    starts = F.col("line").rlike(r"^\s*(?:【?청구항\s*)?[0-9]{1,3}\s*[.】)]")
    numbered = lines(df, key, column).withColumn("_no", F.when(starts, F.regexp_extract("line", "([0-9]{1,3})", 1).cast("int")))
    grouped = positional.islands(numbered, [key], "line_no", F.col("_no").isNotNull(), "_claim").where("_claim > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    out = grouped.groupBy(key, "_claim").agg(F.max("_no").alias("claim_no"), body.alias("text")).drop("_claim")
    out = out.withColumn("text", F.trim(F.regexp_replace("text", r"^\s*(?:【?청구항\s*)?[0-9]{1,3}\s*[.】)]\s*", "")))
    return out.withColumn("dependency", claim_dependency(F.col("text"))).withColumn("is_independent", F.col("dependency").isNull()).withColumn("is_deleted", F.col("text").rlike(r"^\[?\s*(삭제|deleted|cancell?ed)"))


def claim_dependency(c: Column) -> Column:
    """The number of the first other claim that a claim refers to, in four languages, or null."""
    found = F.regexp_extract(c, r"(?iu)(?:제\s*([0-9]{1,3})\s*항|claims?\s+([0-9]{1,3})|請求項\s*([0-9]{1,3})|权利要求\s*([0-9]{1,3}))", 0)
    return F.nullif(F.regexp_extract(found, "([0-9]{1,3})", 1), F.lit("")).cast("int")


def chunks(df: DataFrame, column: str, size: int = 1_000, overlap: int = 150) -> DataFrame:
    """df with chunk_no from 1 and chunk: windows of size tokens, each starting size - overlap after the one before; the last one ends with the text. A text of one window keeps its spacing."""
    step = size - min(max(overlap, 0), size - 1)
    rows = df.withColumn("_t", text.tokens(F.col(column)))
    n = F.when(F.size("_t") <= size, 1).otherwise(F.ceil((F.size("_t") - size) / F.lit(step)).cast("int") + 1)
    rows = rows.withColumn("chunk_no", F.explode_outer(F.sequence(F.lit(1), n))).where("chunk_no IS NOT NULL")
    cut = F.array_join(F.slice("_t", (F.col("chunk_no") - 1) * step + 1, size), " ")
    return rows.withColumn("chunk", F.when(F.size("_t") <= size, F.col(column)).otherwise(cut)).drop("_t")


def clean_section(c: Column) -> Column:
    """NULs away, lines trimmed, at most one blank line, broken lines joined, runs of spaces squeezed."""
    c = F.replace(c, F.lit("\x00"), F.lit(""))
    c = F.regexp_replace(c, r"[ \t]*\r?\n[ \t]*", "\n")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    c = F.regexp_replace(c, "([가-힣A-Za-z0-9,;:.])\n(?=[가-힣A-Za-z0-9])", "$1 ")
    return F.trim(F.regexp_replace(c, r"\s{2,}", " "))


class _Reader(html.parser.HTMLParser):
    """One open paragraph at a time: the next block's start ends it, whether it was closed or not."""

    hidden = frozenset({"script", "style", "svg", "noscript", "header", "footer", "nav"})
    blocks = frozenset({"p", "h1", "h2", "h3", "li", "title"})

    def __init__(self):
        super().__init__()
        self.title, self.metas, self.paragraphs, self.head, self.skip, self.tag, self.parts = [], {}, [], [], 0, None, []

    def flush(self):
        value = " ".join("".join(self.parts).split())
        if self.tag == "title":
            self.title.append(value)
        elif self.tag:
            self.paragraphs.append(value)
            if self.tag == "h1":
                self.head.append(value)
        self.tag, self.parts = None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        name = a.get("property") or a.get("name")
        if tag == "meta" and name in ("og:title", "twitter:title", "title"):
            self.metas.setdefault(name, a.get("content") or "")
        if tag in self.hidden:
            self.flush()
            self.skip += 1
        if tag in self.blocks and (not self.skip or tag == "title"):
            self.flush()
            self.tag = tag

    def handle_endtag(self, tag):
        if tag in self.hidden and self.skip:
            self.skip -= 1
        if tag in self.blocks or tag in ("ul", "ol", "body", "html"):
            self.flush()

    def handle_data(self, data):
        if self.tag and (not self.skip or self.tag == "title"):
            self.parts.append(data)

    def close(self):
        super().close()
        self.flush()


def read_html(df: DataFrame, column: str, least: int = 20) -> DataFrame:
    """df with title (og, twitter or title meta, else h1, else title) and paragraphs of p, h1-h3 and li that are long enough, outside scripts, styles, headers, footers and navigation."""

    @F.pandas_udf("struct<title:string,paragraphs:array<string>>")
    def parse(pages: pd.Series) -> pd.DataFrame:
        out = []
        for page in pages:
            r = _Reader()
            r.feed(page or "")
            r.close()
            names = [r.metas.get(k) for k in ("og:title", "twitter:title", "title")] + r.head[:1] + r.title[:1]
            out.append((next((n.strip() for n in names if n and n.strip()), None), list(dict.fromkeys(p for p in r.paragraphs if len(p) >= least))))
        return pd.DataFrame(out, columns=["title", "paragraphs"])

    return df.withColumn("_h", parse(column)).withColumns({"title": F.col("_h.title"), "paragraphs": F.col("_h.paragraphs")}).drop("_h")
