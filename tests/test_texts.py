"""Articles, queries, market linkage, noise of reports, scanned pages, structured records."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assaykit.functions import articles, reports
from assaykit.operators import linkage, search


@pytest.fixture(scope="module")
def value(spark):
    return lambda c: spark.range(1).select(c.alias("v")).first()["v"]


def L(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


def strings(*x):
    return F.array(*map(F.lit, x)).cast("array<string>")


LONG = "This sentence of an article tells something about the market and is long enough to stay."


def test_articles(value):
    assert [value(articles.is_boilerplate(L(x))) for x in ("short", LONG, LONG + " All Rights Reserved", "홍길동 기자 gildong.hong@news.co.kr", "jane doe reports from a long way")] == [True, False, True, True, True]
    assert value(articles.clean_article(L(f"  {LONG}\n광고 {LONG}\n\nx\n{LONG}"))) == f"{LONG}\n{LONG}"
    assert value(articles.joined_paragraphs(strings(LONG, f" {LONG} ", "short"))) == LONG
    assert value(articles.is_article(L("\n".join([LONG] * 5)))) and not value(articles.is_article(L(LONG))) and not value(articles.is_article(L("\n".join([LONG] * 5 + ["login " + LONG] * 2)))) and not value(articles.is_article(L(None)))
    assert [value(articles.clean_title(L(x))) for x in ("새로운 배터리 공장 - 네이버 뉴스", "x" * 44 + " - My Daily", "abcd", None, "  a  title here ")] == ["새로운 배터리 공장", "x" * 44, None, None, "a title here"]


def test_search_queries(value):
    assert [value(search.company(L(x))) for x in (" 가나  주식회사 ", "N/A", "해당 사항 없음", None)] == ["가나 주식회사", "", "", ""]
    assert [value(search.is_individual(L(x))) for x in ("홍길동", "(주)가나", "Acme Inc", None, "한국전자통신연구원")] == [True, False, False, True, False]
    assert [value(search.is_joint(L(x))) for x in ("Y", "공동", "0", None)] == [True, True, False, False]
    assert value(search.company_query(L("Co"), L(None), L(" "), L("AI"))) == "Co AI" and value(search.company_query(L("Co"), L(None))) == "Co"
    assert value(search.english(strings("robo advisor!", "한글 query", "robo  advisor", "x-y"))) == ["robo advisor", "x y"]
    assert value(search.with_product(strings("a Robo b"), L("Robo"), strings())) == ["a Robo b"]
    assert value(search.with_product(strings("a", "b"), L("Robo"), strings("Robo 시장 동향"), 2)) == ["a", "Robo 기술 적용"]
    every = strings("R 시장 동향", "R 기술 적용", "R 기업 동향", "R")
    assert value(search.with_product(strings(), L("R"), every)) == ["R 시장 동향"] and value(search.with_product(strings("x"), L("R"), every)) == ["x"] and value(search.with_product(strings("x"), L(None), strings())) == ["x"]
    assert value(search.with_applicants(strings("a", "b", "c", "d", "e"), strings(), L("Own"), L("Own AI"), L("Joint"), L("Joint AI"))) == ["a", "b", "c", "Own AI", "Joint AI"]
    assert value(search.with_applicants(strings("Own x", "b"), strings("Joint AI"), L("Own"), L("Own AI"), L("Joint"), L("Joint AI"))) == ["Own x", "b"]
    assert value(search.rewritten(strings("Robo", "x", "x", "y", "z"), L("robo"), strings("y"))) == ["x", "z"]
    assert value(search.industries(L("반도체 웨이퍼와 AI"), L(None))) == ["반도체", "공통"] and value(search.industries(L("없음"))) is None
    assert value(search.industries(L("AI 배터리"))) == ["이차전지", "공통"] and value(search.industries(L("email and a daily"))) is None


ELEMENTS = [("통신부", "데이터 비교", []), ("예측부", "값을 예측하고 최적화한다", [("과제 해결 수단", "배분 비율을 산출"), ("효과", "빠르다")]), ("저장부", "그냥 둔다", [("발명의 효과", "빠르다"), ("효과", "싸다")]), ("비교부", "둘을 비교한다", None)]


def test_market_linkage(spark):
    df = spark.createDataFrame([(ELEMENTS,), ([],)], "e array<struct<name:string,why:string,supports:array<struct<section:string,content:string>>>>")
    e = F.col("e")
    got = df.select(F.transform(linkage.prioritised(e), lambda x: x["name"]).alias("order"), linkage.core_functions(e).alias("core"), linkage.problem(e).alias("problem"), linkage.effects(e).alias("effects"), linkage.hints(e, linkage.core_functions(e), linkage.effects(e)).alias("hints")).collect()
    assert got[0]["order"] == ["예측부", "비교부", "통신부", "저장부"] and got[0]["core"] == ["값을 예측하고 최적화한다", "배분 비율을 산출", "둘을 비교한다", "데이터 비교"]
    assert got[0]["problem"] == "값을 예측하고 최적화한다" and got[0]["effects"] == ["빠르다", "싸다"] and got[0]["hints"][:2] == ["예측부: 값을 예측하고 최적화한다", "비교부: 둘을 비교한다"] and "기대 효과: 빠르다" in got[0]["hints"]
    assert got[1]["order"] == got[1]["core"] == got[1]["effects"] == got[1]["hints"] == [] and got[1]["problem"] == ""


def test_shortened_texts(value):
    assert value(linkage.shortened(L("짧은  글"))) == "짧은 글"
    long = "가" * 100
    assert value(linkage.shortened(L(f"{long} 따라서 {long}"))) == long
    assert value(linkage.shortened(L("나" * 200))) == "나" * 140 + "..."


def test_noise_of_reports(value):
    chart = " ".join("a b c d e f g h".split() * 3)
    assert value(reports.is_chart_noise(L(chart))) and not value(reports.is_chart_noise(L(LONG))) and value(reports.is_chart_tail(L("Chart: " + chart + " x y"))) and not value(reports.is_chart_tail(L(chart + " x y")))
    assert value(reports.is_figures_only(L("Figure 1 Figure 2 Table 3"))) and not value(reports.is_figures_only(L(LONG)))
    assert value(reports.is_source_note(L("12 Data source: x"))) and value(reports.is_source_note(L("3 figures may not add up"))) and not value(reports.is_source_note(L("figures may not add up")))
    assert value(reports.is_footnote(L("7 Due to x"))) and not value(reports.is_footnote(L("7 Dues"))) and value(reports.is_running_head(L("AI INDEX REPORT 3"), "AI INDEX REPORT")) and not value(reports.is_running_head(L("AI INDEX REPORT. Then more"), "AI INDEX REPORT"))
    assert value(reports.is_no_prose(L(chart), "RUNNING TITLE")) and not value(reports.is_no_prose(L(LONG), "RUNNING TITLE"))
    assert value(reports.numbered_heading(L("see 1.2 Research and Growth The number grew"))) == "1.2 Research and Growth" and value(reports.numbered_heading(L("none"))) is None
    prose = "First sentence here. Second one"
    assert value(reports.without_chart_tail(L(f"{prose} ends. Label Source: Figure {chart} z"))) == f"{prose} ends." and value(reports.without_chart_tail(L(f"{prose} Source: a table"))) == f"{prose} Source: a table"


def test_lines_of_words(spark):
    words = [("b", 10.2, 50.0), ("a", 10.0, 5.0), ("c", 12.9, 90.0), ("d", 14.0, 1.0), ("e", 30.0, 2.0)]
    df = spark.createDataFrame([(words,), ([],)], "w array<struct<text:string,top:double,x:double>>")
    assert [r["v"] for r in df.select(reports.lines_from_words(F.col("w")).alias("v")).collect()] == ["a b c\nd\ne", ""]


def test_scanned_pages(value):
    assert [value(reports.has_text(L(x))) for x in ("An Abstract", "claim 1", "1. A thing", "![image 1](<x>)", "x " * 50, "word " * 100, None)] == [True, True, True, False, False, True, False]
    sheet = "FIG. 1\nFIG. 2\n12 14 16"
    assert [value(reports.is_drawing_sheet(L(x))) for x in ("", None, "Sheet 1 of 3", sheet, "\n".join([LONG] * 12), "U.S. Patent\nU.S. Patent 2020")] == [True, True, True, True, False, True]
    assert value(reports.without_front_matter(L("cover\nTECHNICAL FIELD\nbody\nBACKGROUND\nmore"))) == "TECHNICAL FIELD\nbody\nBACKGROUND\nmore" and value(reports.without_front_matter(L(" plain "))) == "plain"


def test_structured_records(value):
    kinds = [("독립항", None), ("independent claim", "1"), ("从属权利要求", None), ("dependent", None), ("odd", "null"), (None, "청구항 1")]
    assert [value(linkage.claim_type(L(a), L(b))) for a, b in kinds] == ["independent", "independent", "dependent", "dependent", "independent", "dependent"]
    assert [value(linkage.element_key(L(x))) for x in (" e 001 ", "E-010", "k0", None)] == ["E1", "E-10", "K0", ""]
    assert value(linkage.axis_issues(L("x"), L(50), L("A"), L("y"), L(0.5))) == [] and value(linkage.axis_issues(L(" "), L(101), L("D"), L(None), L(None).cast("double"))) == ["label", "score", "grade", "rationale", "confidence"]
    scores = lambda **k: F.create_map(*(F.lit(y) for p in k.items() for y in p))
    weights = {"legal": 34.0, "technology": 33.0, "market": 33.0}
    assert value(linkage.result_issues(scores(legal=60, technology=50, market=40, business_fit=1), L(150), L(50.1), weights)) == []
    assert value(linkage.result_issues(scores(legal=60, technology=50, extra=1), L(1), L(50.1), weights)) == ["missing_axis:market", "missing_axis:business_fit", "unknown_axis", "total", "average"]
