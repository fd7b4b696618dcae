"""Words and boxes on pages: which words lie in tables, and the text of the rest.

Words have x0, x1, top and bottom; boxes x0, top, x1 and bottom; `page` names the columns that tell pages apart. Both are dealt to the
cells of a grid, so containment is an equi-join with an exact test after it. A box is on the level of the grid whose cells are as
large as itself, where it touches four cells at most, so one box over a whole page costs no more than a small one.

Nulls: a word or box with a null coordinate contains nothing and is in nothing; a null text is left out of lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import reports

#: Side of the smallest cells, in points.
CELL = 32.0
#: Boxes of a page that go along with its words; a page with more of them has a grid.
TOGETHER = 64


def _levels(boxes: DataFrame) -> DataFrame:
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top"), F.lit(CELL))
    whole = boxes.where("x0 <= x1 AND top <= bottom")
    return whole.withColumn("_level", F.ceil(F.log2(side / CELL)).cast("int"))


def _side(level: int) -> float:
    return CELL * 2.0**level


def _cell(c: Column, level: int) -> Column:
    return F.floor(c / F.lit(_side(level)))


def outside(words: DataFrame, boxes: DataFrame, page: list[str]) -> DataFrame:
    """The words whose centre lies in no box of their page (edges are inside).

    Words are dealt once, by page, where they meet the boxes of pages that have few. For the boxes of other pages there is one anti join
    for each level that they have; levels are powers of two of a cell, so there are few of them."""
    sides = ("x0", "top", "x1", "bottom")
    whole = boxes.select(*page, *(F.col(c).cast("double") for c in sides)).where("x0 <= x1 AND top <= bottom")
    held = whole.groupBy(*(F.col(p).alias(f"_b_{i}") for i, p in enumerate(page))).agg(F.collect_list(F.struct(*sides)).alias("_boxes"))
    frames = _levels(held.where(F.size("_boxes") > TOGETHER).select(*(F.col(f"_b_{i}").alias(p) for i, p in enumerate(page)), F.inline("_boxes")))
    levels = [r["_level"] for r in frames.select("_level").distinct().collect()]
    middle = lambda a, b: (F.col(a).cast("double") + F.col(b).cast("double")) / 2
    out = words.withColumns({"_x": middle("x0", "x1"), "_y": middle("top", "bottom")})
    own = reduce(lambda a, b: a & b, [F.col(p) == F.col(f"_b_{i}") for i, p in enumerate(page)])
    holds = F.exists("_boxes", lambda b: F.col("_x").between(b["x0"], b["x1"]) & F.col("_y").between(b["top"], b["bottom"]))
    met = out.join(held.where(F.size("_boxes") <= TOGETHER), own, "left")
    out = met.where(~F.coalesce(holds, F.lit(False))).drop("_boxes", *(f"_b_{i}" for i in range(len(page))))
    for level in sorted(levels):
        spans = lambda a, b: F.explode(F.sequence(_cell(F.col(a), level), _cell(F.col(b), level)))  # noqa: B023, E731
        some = frames.where(F.col("_level") == level).withColumn("_cx", spans("x0", "x1")).withColumn("_cy", spans("top", "bottom"))
        some = some.select(*(F.col(p).alias(f"_b_{i}") for i, p in enumerate(page)), "_cx", "_cy", *(F.col(c).alias(f"_b_{c}") for c in ("x0", "top", "x1", "bottom")))
        same = [F.col(p) == F.col(f"_b_{i}") for i, p in enumerate(page)]
        same += [_cell(F.col("_x"), level) == F.col("_cx"), _cell(F.col("_y"), level) == F.col("_cy")]
        inside = F.col("_x").between(F.col("_b_x0"), F.col("_b_x1")) & F.col("_y").between(F.col("_b_top"), F.col("_b_bottom"))
        on = inside
        for s in same:
            on = s & on
        out = out.join(some, on, "left_anti")
    return out.drop("_x", "_y")


def page_lines(words: Column, apart: float = 3.0) -> Column:
    """The text of a page's array of struct<x0, top, text>: a line holds what is at most so far from its first word, left to right."""
    return reports.lines_from_words(F.transform(words, lambda w: F.struct(w["text"].alias("text"), w["top"].alias("top"), w["x0"].alias("x"))), apart)


def page_texts(words: DataFrame, page: list[str]) -> DataFrame:
    """The text of each page's words."""
    held = words.where("x0 IS NOT NULL AND top IS NOT NULL AND text IS NOT NULL").groupBy(*page).agg(F.collect_list(F.struct("x0", "top", "text")).alias("_words"))
    return held.select(*page, page_lines(F.col("_words")).alias("text"))


def second_reader(pages: DataFrame, other: DataFrame, page: list[str], least: int = 120) -> DataFrame:
    """pages (text) with the other reader's text where the first found fewer characters than `least` and the other more; pages that only the other has come along."""
    squeezed = lambda c: F.length(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    both = pages.join(other.select(*page, F.col("text").alias("_other")), page, "full")
    return both.select(*page, F.when((squeezed("text") < least) & (squeezed("_other") > squeezed("text")), F.col("_other")).otherwise(F.coalesce("text", F.lit(""))).alias("text"))


def documents(pages: DataFrame, boxes: DataFrame, doc: str, number: str) -> DataFrame:
    """One Markdown text a document: its pages under headings, and how many tables were left out at the end."""
    part = F.concat(F.lit("\n# Page "), F.col(number).cast("string"), F.lit("\n\n"), F.trim(F.coalesce("text", F.lit(""))))
    texts = pages.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("_n"), part.alias("_part")))), lambda p: p["_part"]), "\n\n").alias("text"))
    tables = boxes.groupBy(doc).agg(F.count("*").alias("removed_tables"))
    whole = texts.join(tables, doc, "left").withColumn("removed_tables", F.coalesce("removed_tables", F.lit(0)))
    return whole.withColumn("text", F.concat(F.regexp_replace("text", r"^\s+|\s+$", ""), F.lit("\n\n<!-- removed_tables: "), F.col("removed_tables").cast("string"), F.lit(" -->\n")))
