"""Chapters, a yearly index, and claims out of running texts, against fixtures."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from assaykit.functions import foreign_claims
from assaykit.operators import index_reports, matching, reports


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c"))).first()[0]


# --- chapters ---------------------------------------------------------------------------------------

CONTENTS = "차례\n제1장 자동차 산업 ········ 17\n제2장 무엇 산업 ······ 20\n\x00제4장 반도체 산업 ... ... 31\n제3장 조선 산업·····25\n제3장 조선 산업·····25\n제5장 철강 산업 9\n"


def test_chapters_come_from_the_contents(spark):
    rows = spark.createDataFrame([("r", CONTENTS), ("none", "text"), ("null", None)], "id string, text string")
    got = [(r["id"], r["industry"], r["first_page"], r["last_page"]) for r in reports.chapter_ranges(rows, "id", "text").collect()]
    assert got == [("r", "자동차", 18, 25), ("r", "조선", 26, 31), ("r", "반도체", 32, None)]


def test_sections_take_their_chapter(spark):
    body = "".join(f"# Page {p}\n\n1. 이차전지 전망 {p}\n{'가나다라 ' * 40}\n" for p in (17, 18, 26, 40))
    rows = spark.createDataFrame([("r", CONTENTS + body)], "id string, text string")
    plain = {r["page"]: r["industry"] for r in reports.sections(rows, "id", "text").where("heading LIKE '1.%'").collect()}
    by_chapters = {r["page"]: r["industry"] for r in reports.sections(rows, "id", "text", by_chapters=True).where("heading LIKE '1.%'").collect()}
    assert set(plain.values()) == {"이차전지"} and by_chapters == {17: "이차전지", 18: "자동차", 26: "조선", 40: "반도체"}


# --- a yearly index ---------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "heading,text,want",
    [
        ("Page 4", "short\n3.2 Benchmarks of Reasoning The models", "3.2 Benchmarks of Reasoning"), ("Page 4", "Chapter 3 | AI INDEX REPORT 2025", "Chapter 3"), ("Page 4", "lower case\nRESPONSIBLE AI", "RESPONSIBLE AI"),
        ("Page 4", "nothing of this kind here", "Page 4"), ("A heading", "RESPONSIBLE AI", "A heading"), ("page 9", "\n".join(["only prose here"] * 8 + ["RESPONSIBLE AI"]), "page 9"),
    ],
)
def test_titles_within_pages(spark, heading, text, want):
    row = spark.createDataFrame([(heading, text)], "h string, t string").select(index_reports.title_of(F.col("h"), F.col("t"))).first()
    assert row[0] == want


def test_short_sections_are_merged(spark):
    rows = [("r", 1, "H", 5, "AI", "a" * 400), ("r", 2, "H", 5, "AI", "short"), ("r", 3, "H", 5, "AI", "again"), ("r", 4, "H", 6, "AI", "other page"), ("r", 5, "I", 6, "AI", "other heading"), ("r", 6, "I", 6, "AI", "b" * 400), ("s", 1, "H", None, "AI", "x"), ("s", 2, "H", None, "AI", "y")]
    got = index_reports.merged(spark.createDataFrame(rows, "id string, section_no int, heading string, page int, industry string, text string"), "id").orderBy("id", "section_no").collect()
    assert [(r["id"], r["section_no"], len(r["text"])) for r in got] == [("r", 1, 412), ("r", 4, 10), ("r", 5, 13), ("r", 6, 400), ("s", 1, 3)]


def test_index_reports_are_cut(spark):
    prose = "The models of this year do far better than those of the last. " * 12
    pages = [(20, f"2.1 Technical Performance\n{prose}"), (21, f"Appendix\n{prose}"), (390, f"2.9 Behind The body\n{prose}"), (22, "Figure 1 Figure 2 Figure 3"), (23, f"CHAPTER PREVIEW\n{prose}")]
    text = "".join(f"# Page {p}\n\n{t}\n\n" for p, t in pages)
    df = spark.createDataFrame([("r", text, "index 2025.pdf", 2025)], "id string, text string, source string, year int")
    got = index_reports.sections(df, "id", "text").orderBy("section_no").collect()
    assert [r["page"] for r in got] == [20, 23] and all(r["industry"] == "AI" for r in got)
    chunks = index_reports.chunks(df, "id", "text", "source", "year").collect()
    assert chunks and all("2025_AI" in c["chunk_id"] for c in chunks)


def test_names_of_sources_and_front_matter(spark):
    known = {"Top Trends 2025": ("top", "trends"), "Outlook": ("outlook",)}
    names = ["my-TOP_trends.pdf", "a/b/some-report_2024.pdf", "plain name", None]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(index_reports.source_name(F.col("n"), known)).collect()] == ["Top Trends 2025", "Some Report 2024", "plain name", None]
    assert [one(spark, index_reports.front_section, t) for t in ("the FOREWORD by", "text", None, "Introduction and contents")] == ["Foreword", None, None, "Contents"]


# --- claims out of running texts --------------------------------------------------------------------


def numbers(claims):
    return [(c["claim_no"], c["text"], c["is_independent"], c["dependency"]) for c in claims]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Prose 1. not a claim\nWhat is claimed is:\n1. A device that has a wheel on it.\n2) The device of claim 1,\nwherein it is round.\n2. A second of this number, twice", [(1, "A device that has a wheel on it.", True, None), (2, "The device of claim 1, wherein it is round.", False, 1)]),
        ("Claim 3: A method of doing the first thing\nClaims 1 - Another method of doing a thing\n1. not this way of numbering, as claims are named", [(1, "Another method of doing a thing 1. not this way of numbering, as claims are named", True, None), (3, "A method of doing the first thing", True, None)]),
        ("权利要求书\n权利要求 1 一种装置，其特征在于包括一个轮子和一个轴以及其他部件\n权利要求 2 根据权利要求 l 所述的装置，其特征在于轮子是圆的而且很大", [(1, "一种装置，其特征在于包括一个轮子和一个轴以及其他部件", True, None), (2, "根据权利要求 1 所述的装置，其特征在于轮子是圆的而且很大", False, 1)]),
        ("【第1項】一種裝置，包括一個輪子與一個軸，其中輪子可以轉動並且很大\n【 第 2 項 】如申請專利範圍第1項所述之裝置，其中該輪子為圓形且很大很大", [(1, "一種裝置，包括一個輪子與一個軸，其中輪子可以轉動並且很大", True, None), (2, "如申請專利範圍第1項所述之裝置，其中該輪子為圓形且很大很大", False, 1)]),
        ("1、請求項１又は２に記載の装置であって、車輪が丸いことを特徴とするもの", [(1, "請求項１又は２に記載の装置であって、車輪が丸いことを特徴とするもの", False, 1)]),
        ("1. A claim with noise in it\n## 페이지 3\n12\n```text\n![x](y)\nand the rest of it\n## 페이지 4\nbehind the last page", [(1, "A claim with noise in it", True, None)]),
        ("1. A claim with noise in it\n## OCR 텍스트\n12\n```\n![x](y)\nand the rest of it\n2. Another that ends the first one", [(1, "A claim with noise in it and the rest of it", True, None), (2, "Another that ends the first one", True, None)]),
        ("no claims at all", []), ("1. short", []), ("", []), (None, []),
    ],
)
def test_foreign_claims(spark, text, want):
    assert numbers(one(spark, foreign_claims.foreign_claims, text)) == want


def test_long_claims_and_sections(spark):
    text = "We claim:\n" + "\n".join(f"{i}. {'word ' * (2_000 if i == 7 else 5)}of claim {i - 1}" for i in range(1, 901))
    got = one(spark, foreign_claims.foreign_claims, text)
    assert len(got) == 900 and len(got[6]["text"]) == 5_000 and [c["claim_no"] for c in got] == list(range(1, 901))
    assert one(spark, foreign_claims.claims_section, "x\nCLAIMS\ny we claim: z") == "\ny we claim: z" and one(spark, foreign_claims.claims_section, "none") == "none"
    row = spark.createDataFrame([("a" * 13_000, " b "), (None, "b"), (" ", None)], "c string, r string").select(foreign_claims.claims_and_representative(F.col("c"), F.col("r")).alias("t")).collect()
    assert [len(r["t"]) for r in row] == [12_000, 1, 0]


# --- siblings ---------------------------------------------------------------------------------------


def test_sibling_groups_and_bounds(spark):
    rows = [(i, "p" if i < 500 else None, f"f{i % 2}" if i < 20 else " ", "m" if i in (1, 700) else "") for i in range(800)]
    df = spark.createDataFrame(rows, "id int, product string, family string, management string")
    names = {"key": "id", "product": "product", "family": "family", "management": "management"}
    groups = {(r["kind"], r["value"]): (r["n"], r["first"]) for r in matching.sibling_groups(df, **names).collect()}
    assert groups == {("same_product", "p"): (500, 0), ("same_family", "f0"): (10, 0), ("same_family", "f1"): (10, 1), ("same_management", "m"): (2, 1)}
    got = matching.siblings(df, df.where("id IN (1, 700)"), most=3, **names)
    assert sorted((r["id"], r["sibling"], r["priority"], tuple(r["reasons"])) for r in got.collect()) == [(1, 0, 0, ("same_product",)), (1, 2, 0, ("same_product",)), (1, 3, 0, ("same_product", "same_family")), (700, 1, 2, ("same_management",))]
    assert not re.search("Cartesian|NestedLoop", got._jdf.queryExecution().toString())
