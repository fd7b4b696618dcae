"""Rules on literal rows: axes, numbers, lookups, sites, reports, gates, nested JSON."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from assaykit.functions import json_search, numbers, reports
from assaykit.operators import axes, gates, lookups, site
from assaykit.operators import reports as report_rows


@pytest.fixture(scope="module")
def value(spark):
    return lambda c: spark.range(1).select(c.alias("v")).first()["v"]


def L(x):
    return F.lit(x)


def strings(*x):
    return F.array(*map(F.lit, x)).cast("array<string>")


def ints(**x):
    return F.create_map(*(F.lit(y) for p in x.items() for y in p)).cast("map<string,int>") if x else F.expr("cast(map() as map<string,int>)")


def nested(**x):
    return F.create_map(*(y for k, v in x.items() for y in (F.lit(k), ints(**v)))) if x else F.expr("cast(map() as map<string,map<string,int>>)")


# --- axes -----------------------------------------------------------------------------------------


def test_legal_axis(value):
    got = value(axes.legal(ints(right_stability=99, claim_protection=30, portfolio_defensive_value=50), nested(), L(False), L(False)))
    assert got.asDict(True) == {"subscores": {"right_stability": 40, "claim_protection": 30, "portfolio_defensive_value": 20}, "score": 90, "grade": "A"}
    details = nested(right_stability={"prior_art_overlap": 20, "validity": 15}, portfolio_defensive_value={"follow_on_right_signal": 4, "family": 9})
    got = value(axes.legal(ints(claim_protection=-3), details, L(True), L(True)))
    assert got["subscores"].asDict() == {"right_stability": 15, "claim_protection": 0, "portfolio_defensive_value": 9} and got["score"] == 24 and got["grade"] == "C"
    scaled = value(axes.legal(ints(right_stability=20, claim_protection=40), nested(), L(False), L(False), ints(right_stability=20, claim_protection=60, portfolio_defensive_value=20)))
    assert scaled["subscores"].asDict() == {"right_stability": 10, "claim_protection": 60, "portfolio_defensive_value": 0} and scaled["score"] == 70
    cut = value(axes.legal(ints(right_stability=40), nested(), L(True), L(False)))
    assert cut["subscores"]["right_stability"] == 20
    assert value(axes.detail_sum(ints(a=3, b=4), strings("b"))) == 3 and value(axes.detail_sum(ints())) is None
    assert value(axes.unknown_details(ints(a=3, b=4), strings("b"))) == {"a": 3, "b": None}


def test_business_fit_axis(value):
    got = value(axes.business_fit(ints(official_business_evidence=45, product_function_direct_match=40)))
    assert got.asDict(True) == {"subscores": {"official_business_evidence": 30, "product_function_direct_match": 40, "business_context_fit": 0}, "score": 70, "grade": "A"}
    half = value(axes.business_fit(ints(official_business_evidence=10), ints(official_business_evidence=10, product_function_direct_match=10, business_context_fit=0)))
    assert half["score"] == 50


def test_market_axis(value):
    full = ints(industry_marketability=25, global_business=20, competitiveness=20, invention_market_linkage=20)
    got = value(axes.market(full, L(20), L(0.9)))
    assert got["score"] == 100 and got["grade"] == "A" and got["confidence"] == 0.9
    got = value(axes.market(ints(industry_marketability=-5, global_business=12), L(None).cast("int"), L(0.9)))
    assert got["score"] == 12 and got["confidence"] == 0.49 and got["subscores"]["market_growth"] is None and got["subscores"]["industry_marketability"] == 0


def test_technology_axis(value):
    details = nested(technical_differentiation={"configuration_operation_differentiation": 25, "effect_differentiation": 13, "imitation_avoidance_difficulty": 1})
    got = value(axes.technology(details, ints(implementation_specificity=55)))
    assert got["subscores"].asDict() == {"technical_differentiation": 30 + 12 + 0, "implementation_specificity": 40} and got["score"] == 82
    assert value(axes.max_score_conflict(strings(" "), strings("표현이 제한적이다"), ("제한적",))) and not value(axes.max_score_conflict(strings(), strings("clear"), ("제한적",))) and value(axes.max_score_conflict(strings("x"), strings(), ()))


def test_evidence_classes(value):
    assert [value(axes.right_state(L(s), L("등록"))) for s in ("소멸", "등록유지", "심사중", None, "")] == ["inactive", "registered_or_active", "unclear", "registered_or_active", "registered_or_active"]
    assert value(axes.right_state(L(None).cast("string"))) == "unknown"
    assert value(axes.url_path(L("https://www.mine.com/Finance/x?y=/insight"), ("mine.com",))) == "/finance/x"
    assert [value(axes.is_weak_page(L(p))) for p in ("/finance/x", "/insight/finance", "/about")] == [False, True, True]
    got = [tuple(value(axes.presence_score(*map(L, x)))) for x in ((0, 0, 0), (0, 0, 1), (0, 0, 2), (2, 2, 0), (1, 0, 5), (2, 1, 0), (3, 2, 0))]
    assert got == [(0, "no_official_evidence"), (8, "owned_media_only"), (16, "owned_media_only"), (8, "broad_or_weak_only"), (16, "official_1"), (24, "official_2"), (30, "official_3_or_more")]
    assert value(axes.relevance(L(None).cast("string"), L("0.4"), L("0.9"))) == 0.4 and value(axes.relevance(L("x"))) == 0.0
    hints = {"US": ("united states", "u.s."), "CN": ("china",)}
    signal = lambda country, t: value(axes.abroad_signal(L(country), hints, L(t)))
    assert [signal("US", t) for t in ("launch in the United States", "launch in the U.S. and China", "global launch in the U.S.", "launch somewhere", "nothing")] == [False, True, True, True, False]
    assert value(axes.evidence_groups(L("news"), L("Global_News"))) == ["global_news", "competition"] and value(axes.evidence_groups(L("industry_report"), L(None))) == ["industry_report"] and value(axes.evidence_groups(L("x"), L("y"))) == []
    assert [value(axes.confidence_of(L(n))) for n in (0, 2, 3)] == ["LOW", "MEDIUM", "HIGH"] and [value(axes.confidence_text(L(x))) for x in (0.7, 0.4, 0.1)] == ["high", "medium", "low"]
    assert value(axes.has_tag(("a",), L("x"), L(" a "))) and not value(axes.has_tag(("a",), L(None).cast("string")))


# --- numbers --------------------------------------------------------------------------------------


@pytest.mark.parametrize(("given", "want"), [("US 2010/0123456 A1", "US-20100123456-A1"), ("jp-2017-12345", "JP-201712345"), ("US-9123456-B2", "US-9123456B2"), ("no number", None), (None, None)])
def test_publication_keys(value, given, want):
    assert value(numbers.publication_key(L(given).cast("string"))) == want


def test_number_forms(value):
    assert value(numbers.publication_keys(L("US"), L("123"), L("B2"), L("US 123 B2"), L(None).cast("string"))) == ["US-123-B2", "US-123"]
    assert tuple(value(numbers.reference_parts(L("see EP 1 234 567 A1".replace("1 234 567", "1234567"))))) == ("EP", "1234567", "A1") and value(numbers.reference_parts(L("EP 1234567"))) is None
    assert value(numbers.display_number(L("US"), L("12"), L("B2"), L("x"))) == "US12 B2" and value(numbers.display_number(L(None).cast("string"), L("12"), L("B2"), L("x"))) == "x"
    assert value(numbers.padded(L("US 9,123 B2".replace(",", "")))) == "000000009123B2"
    assert [value(numbers.era_number(L("JP"), L("29012345"), L(d))) for d in ("2017-05-01", "2018-05-01", "1980")] == ["2017012345", None, None]
    assert value(numbers.literature_numbers(L("JP"), L("29012345"), L("a"), L("2017"), L("JP 1 B"))) == ["000029012345A", "002017012345A", "000000000001B", "000029012345"]
    pairs = [tuple(x) for x in value(numbers.target_numbers(L("CN"), L("CN 104 B"), L("201780067437.9")))]
    assert pairs == [("201780067437", "A0", "application_number"), ("104", "B", "registration_number"), ("104", "A0", "registration_number"), ("104", "B0", "registration_number")]
    assert [x["kind"] for x in value(numbers.target_numbers(L("US"), L("9123456"), L(None).cast("string")))] == ["B2", "B1", "B"]
    ids = lambda c, r, a: value(numbers.publication_id(L(c), L(r).cast("string"), L(a).cast("string")))
    assert [ids("US", "9,123,456", None), ids("US", None, "US 2010/123456 A1"), ids("US", None, "2010123456 A1"), ids("TW", "I123456", None), ids("EP", "1234567 B1", None), ids("", "1", None), ids("DE", None, "102")] == [
        "US9123456B2", "US20100123456A1", "US20101234561A1", "TWI123456", "EP12345671B1", None, "DE102",
    ]
    assert [value(numbers.without_register_suffix(L(x))) for x in ("10-0309314-0001", "1003093140000", "US123", "")] == ["10-0309314", "100309314", "US123", None]
    assert value(numbers.application_spellings(L(" 10-2019  1 "))) == ["1020191", "10-2019 1"] and [value(numbers.int_or_null(L(x))) for x in ("12", " 7 ", "1a", "-1")] == [12, 7, None, None]


# --- lookups --------------------------------------------------------------------------------------


def test_ordered_probing(spark):
    rows = spark.createDataFrame([(1, ["x", "b", "a"]), (2, ["z"]), (3, [])], "id int, keys array<string>")
    table = spark.createDataFrame([("a", 10), ("b", 21), ("b", 20)], "k string, v int")
    got = {r["id"]: (r["found_key"], r["v"]) for r in lookups.probe(rows, "id", F.col("keys"), table, "k", ["v"]).collect()}
    assert got == {1: ("b", 20), 2: (None, None), 3: (None, None)}
    asked = spark.createDataFrame([(1, "us", "9123456", "B2"), (2, "US", "9123456", "A"), (3, "JP", "9123456", ""), (4, "US", "12", "")], "id int, c string, n string, k string")
    known = spark.createDataFrame([("US-9123456-B2",), ("US-009123456-B2",), ("KR-9123456-B2",)], "p string")
    loose = {r["id"]: r["found_key"] for r in lookups.probe_loosely(asked, "id", "c", "n", "k", known, "p").collect()}
    assert loose == {1: "US-009123456-B2", 2: None, 3: None, 4: None}
    found = spark.createDataFrame([(1, "b", "x"), (1, "a", "y"), (1, "a", "z"), (2, "b", "w"), (3, "q", "v")], "id int, kind string, v string")
    assert sorted(tuple(r) for r in lookups.first_of_kinds(found, "id", "kind", ["a", "b"], "v").collect()) == [(1, "a", "y"), (1, "a", "z"), (2, "b", "w")]
    order = spark.createDataFrame([("A1",), ("b",), (None,)], "k string").select(lookups.search_order(F.col("k"))[0].alias("v")).collect()
    assert [r["v"] for r in order] == ["open_number", "register_number", "application_number"]


def test_cited_evidence(spark):
    evidence = spark.createDataFrame([("e1", 1, "T1", None, None, None, "s", "u1", "news"), ("e1", 0, " ", "sum", None, None, "s0", None, "news"), ("e2", 2, None, None, None, None, "src", "u2", "report"), ("e3", 3, None, None, None, None, None, None, "x")], "evidence_id string, seq int, title string, summary string, context string, content string, source string, url string, source_type string")
    cited = spark.createDataFrame([("legal", ["e9", "e2", "e1", "e3"])], "axis string, ids array<string>")
    got = [(r["place"], r["evidence_id"], r["text"], r["source"]) for r in lookups.cited_details(cited, evidence, by="axis", ids="ids", most=2).orderBy("place").collect()]
    assert got == [(1, "e2", "src", "src"), (2, "e1", "sum", "s0")]
    refs = spark.createDataFrame([("r", 2, "a", "u", "s"), ("r", 1, "a", "u", "s"), ("r", 3, None, "w", "src")], "k string, seq int, title string, url string, source string")
    assert sorted(tuple(r) for r in lookups.external_sources(refs, by="k", order="seq").collect()) == [("r", "a", "u", 1), ("r", "src", "w", 3)]
    axes_ = spark.createDataFrame([("e1", "market"), ("e1", "legal"), ("e3", "legal")], "evidence_id string, axis string")
    assert {(r["seq"], tuple(r["cited_by_axes"])) for r in lookups.references(evidence, axes_, ("news", "report")).collect()} == {(0, ("legal", "market")), (1, ("legal", "market"))}


# --- sites ----------------------------------------------------------------------------------------


def test_site_queries(value):
    assert value(site.title_keywords(L("강화학습 기반 자산배분 방법 및 시스템(AI)"))) == ["강화학습", "자산배분", "AI"]
    assert [value(site.without_particle(L(w))) for w in ("학습으로", "자산을", "을", "가을", "모델")] == ["학습", "자산", "을", "가을", "모델"]
    assert value(site.without_site(L(" site:a.com x  SITE:b y "))) == "x y" and value(site.compact(L("a"), L(None).cast("string"), L("a"), L(" b "))) == "a b"
    got = value(site.queries(L("Robo"), L("자산배분 예측 모델"), L("금융"), L("AI"), domain="mine.com", brand="My Co", most=5))
    assert got == ["site:mine.com Robo", "site:mine.com My Co Robo", "site:mine.com Robo 금융 AI", "site:mine.com 금융 투자 자산관리 AI 예측", "site:mine.com Robo 자산배분 예측 AI"]
    none = L(None).cast("string")
    assert value(site.queries(none, none, none, none, domain="mine.com", brand="My")) == ["site:mine.com"]
    assert value(site.queries(L("P"), none, none, none, domain="mine.com", brand="My", given=strings("site: mine.com  a", "a", " "), most=2)) == ["site:mine.com a", "site:mine.com P"]
    assert value(site.media_queries(strings("site:mine.com x", "site:mine.com My Co y", "site:mine.com x"), domain="mine.com", brand="My Co")) == ["My Co x", "My Co y"]


def test_site_candidates(spark):
    urls = ["", "mailto:x", "https://other.com/a", "https://mine.com/a.pdf", "https://mine.com/a", "https://MINE.com/a#x", "https://sub.mine.com", "https://mine.com/c", "https://mine.com/d"]
    rows = spark.createDataFrame([("q", i, f"t{i}", u, "text") for i, u in enumerate(urls)], "query string, seq int, title string, url string, content string")
    got = {r["seq"]: (r["skip_reason"], r["content"]) for r in site.candidates(rows, by="query", order="seq", domains=("mine.com",), most=3, chars=2).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "empty_url", 1: "invalid_url", 2: "external_domain", 3: "file_url", 4: None, 5: "duplicate_url", 6: None, 7: None} and got[4][1] == "te"


def test_site_scores(value):
    none = L(None).cast("string")
    run = lambda title, url, product="Robo", area=None, name="자산배분 방법", snippet=None: value(site.score(L(title), none, L(url), L(product).cast("string"), L(name), L(None).cast("string"), L(area).cast("string"), snippet=snippet))
    got = run("Robo for 자산배분", "https://mine.com/finance/x")
    assert got["relevance_score"] == 0.5 + 2 * 0.16 + 0.1 and got["is_relevant"] and got["score_reasons"] == ["matched_related_product", "matched_strong_term:Robo", "matched_strong_term:자산배분", "matched_preferred_path:/finance"]
    weak = run("nothing at all", "https://mine.com/x")
    assert weak["relevance_score"] == 0 and weak["score_reasons"] == ["insufficient_specific_match"]
    assert "penalty_unrelated_keyword:AICC" in run("Robo", "https://mine.com/aicc")["score_reasons"]
    assert run(None, "https://mine.com/x", snippet=L("Robo for 자산배분"))["relevance_score"] == 0.82
    hinted = run("금융 투자 서비스", "https://mine.com/finance", product=None)
    assert hinted["is_relevant"] and hinted["relevance_score"] == 0.26


def test_final_choice(spark):
    found = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", None), ("e", "file_url"), ("f", None)], "normalized_url string, skip_reason string")
    scored = spark.createDataFrame([("a", 0.9), ("b", 0.2), ("c", 0.7), ("f", 0.6)], "normalized_url string, relevance_score double")
    chosen = spark.createDataFrame([("a",), ("f",)], "normalized_url string")
    evidence = spark.createDataFrame([("a",)], "normalized_url string")
    got = {r["normalized_url"]: (r["final_selected"], r["final_skip_reason"]) for r in site.final_reasons(found, scored, chosen, evidence).collect()}
    keyed = lambda df: df.withColumn("q", F.lit(1)).unionByName(df.withColumn("q", F.lit(2)))
    other = keyed(chosen).where("q = 1 OR normalized_url = 'a'")
    by_query = {(r["q"], r["normalized_url"]): r["final_skip_reason"] for r in site.final_reasons(keyed(found), keyed(scored), other, keyed(evidence), by="q").collect()}
    assert by_query[1, "c"] == "max_evidence_limit" and by_query[2, "c"] == by_query[2, "f"] == "lower_relevance_than_selected" and by_query[2, "a"] is None
    assert got == {"a": (True, None), "b": (False, "lower_relevance_than_selected"), "c": (False, "max_evidence_limit"), "d": (False, "insufficient_specific_match"), "e": (False, "file_url"), "f": (False, "empty_content")}


# --- reports --------------------------------------------------------------------------------------


def test_report_lines(value):
    assert [value(reports.page_mark(L(x))) for x in ("- 12 -", "## Page 7", "페이지 3", "12", "page x")] == [12, 7, 3, None, None]
    heads = ["# One", "<표 1-2> x", "자동차 산업", "1. 개요입니다", "Ⅱ. 전망 보기", "가. 현황 보기", "주: 참고", "⋅ 자동차", "그냥 문장"]
    assert [value(reports.report_heading(L(x))) for x in heads] == ["One", "<표 1-2> x", "자동차 산업", "개요입니다", "전망 보기", "현황 보기", None, None, None]
    assert value(reports.industry_of(L("석유 화학과 반도체"))) == "석유화학" and value(reports.published_year(L("report_2023_v2025.pdf"))) == 2025 and value(reports.published_year(L("x"))) is None
    assert value(reports.without_footers(L("a\n12 KIET 경제\n제1장 자동차 12\nb"))) == "a\nb"
    assert value(reports.without_table_lines(L("<표 1-1>\n주: x\n☂ ☼\n\n본문 문장\n자료: 통계"))) == "\n본문 문장"
    assert value(reports.body_heading(L("x\n□ 둘\n(1) 셋"))) == "□ 둘" and value(reports.body_heading(L("  \n하나"))) == "하나"
    assert value(reports.from_body_start(L("표\n○ 시작\n끝"))) == "○ 시작\n끝" and value(reports.from_body_start(L("표"))) == ""
    assert [value(reports.keeps(L(x))) for x in ("문장 " * 60, "짧다", "<표 1-1> <표 1-2> <표 1-3>" + "x" * 150, "발 행 인 ISSN" + " x" * 100)] == [True, False, False, False]
    kinds = ["KIET 2026.pdf", "AI_index.pdf", "McKinsey technology trends", "WEF Top 10 emerging technologies", "KPMG AI", "KPMG x", "기계산업 백서", "other"]
    assert [value(reports.report_kind(L(x))) for x in kinds] == ["kiet", "ai_index", "technology_trends", "emerging_technologies", "consulting_ai", "consulting_fintech", "machine_whitepaper", "generic"]
    assert value(reports.chunk_id(L("My report!.pdf"), L(2025), L("이차전지"), L(7), L(3))) == "My_report_2025_이차전지_p7_003"


def test_report_chunks(spark):
    body = "이 문장은 충분히 길어서 남는다 " * 12
    text = f"머리말 {body}\n- 3 -\n일찍 {body}\n- 20 -\n# 자동차 산업 전망\n{body}\n- 21 -\n<표 1-1> 표\n1\n○ 본문 시작 {body}\n# 반도체\n{body}"
    rows = report_rows.sections(spark.createDataFrame([("r", text)], "k string, t string"), "k", "t")
    got = [(r["heading"], r["page"], r["industry"]) for r in rows.orderBy("section_no").collect()]
    assert got == [("문서 개요", None, None), ("Page 3", 3, None), ("자동차 산업 전망", 20, "자동차"), ("<표 1-1> 표", 21, "자동차"), ("반도체", 21, "반도체")]
    kept = report_rows.kept(rows)
    assert [r["page"] for r in kept.orderBy("section_no").collect()] == [None, 20, 21, 21]
    cut = report_rows.chunks(kept.withColumns({"src": F.lit("R.pdf"), "year": F.lit(2025)}), "k", "src", "year", size=40, overlap=5)
    ids = [r["chunk_id"] for r in cut.orderBy("section_no", "chunk_no").collect()]
    assert ids[0] == "R_2025_공통_p000_001" and len(ids) == len(set(ids)) and any("자동차_p20_001" in x for x in ids) and any("자동차_p21_" in x for x in ids)


def test_written_reports(value):
    text = "## 1. 개요\n내용\n## 2) 범위\n둘\n### 2.1 아래\n셋\n## 2. 다시\n넷\n| 종합 검토 의견 | 유지 |"
    assert value(reports.numbered_sections(L(text))) == {"1": "내용", "2": "넷\n| 종합 검토 의견 | 유지 |"} and value(reports.numbered_sections(L(None).cast("string"))) == {}
    assert value(reports.sanitized_report(L("a\n(세부 점수 반영: 1)\n[참고 근거] x\n참고 근거 y\nb"))) == "a\nb"
    every = strings("legal", "technology", "market", "business_fit")
    whole = "\n".join(f"## {i}. x\ny" for i in range(1, 7)) + "\n| 종합 검토 의견 | 유지 |"
    assert value(reports.report_issues(L(whole), every, L("유지"), L("KR"))) == []
    assert value(reports.report_issues(L(text + " 국내 특허"), strings("legal", "strategy"), L("포기"), L("US"))) == ["missing_axis:technology", "missing_axis:market", "missing_axis:business_fit", "deprecated_axis:strategy", "missing_sections:3,4,5,6", "other_recommendation", "domestic_wording"]
    assert value(reports.report_issues(L(None).cast("string"), every, L(""), L(""))) == ["missing_report"]


# --- gates ----------------------------------------------------------------------------------------


def test_gates(value):
    state = lambda *x: value(gates.axis_state(*(L(v).cast("string") for v in x)))
    assert state("market", "query_rewriting", None, None, "passed") == "query_rewriting" and state("legal", "query_rewriting", None, None, "passed") == "valuation_retry"
    assert state("market", "odd", "valuation_retry", "true", "passed") == "valuation_retry" and state("market", None, None, "TRUE", "valuation_retry") == "passed"
    assert state("market", None, None, "false", "passed") == "passed" and state("market", None, None, None, "valuation_retry") == "valuation_retry" and state("market", None, None, None, "odd") == "passed"
    assert tuple(value(gates.flags(L("valuation_retry")))) == (False, True, False)
    assert [value(gates.next_team(strings(*s))) for s in (("passed", "query_rewriting", "valuation_retry"), ("passed", "valuation_retry"), ("passed",))] == ["research", "valuation", "writing"]
    assert value(gates.retry_axes(strings("a", "b", "c"), strings("valuation_retry", "valuation_retry", "passed"), ints(a=2), L(2))) == ["b"]
    assert [value(gates.writing_step(L(a), L(b))) for a, b in ((False, False), (False, True), (True, False), (True, True))] == ["writing_team", "summary", "final_report", "final_merge"]
    assert [value(gates.degraded(*x)) for x in ((L(None).cast("boolean"), L(4), L(3), strings("x")), (L(True), L(4), L(3), strings()), (L(False), L(0), L(3), strings()), (L(False), L(4), L(0), strings()), (L(False), L(4), L(1), strings("technology_comparison_empty")))] == [False, True, True, True, True]
    assert [value(gates.empty_reason(*x)) for x in ((strings("KEY is not set"), L(True), L("m")), (strings(), L(False), L("timeout")), (strings(), L(None).cast("boolean"), L(None).cast("string")))] == ["missing_config", "calls_failed", "no_results"]
    issues = F.array(strings("x", "y"), strings("z"), strings("y", "w"))
    assert value(gates.joined_gaps(strings("y"), strings("valuation_retry", "passed", "query_rewriting"), issues)) == ["y", "x", "w"]


# --- nested JSON ----------------------------------------------------------------------------------


def test_json_search(value):
    tree = {"a": {"IPC": ["G06Q", " ", None], "b": [{"ipc": "H04L", "path": ""}, {"deep": {"Path": "/x", "n": 1}}]}, "inventorInfo": [{"name": "Kim", "engName": "KIM"}, {"name": "Kim"}, {"name": {"x": 1}}], "agent": {"name": "Lee"}}
    c = L(json.dumps(tree))
    assert value(json_search.values_of(c, "ipc")) == ["G06Q", "H04L"] and value(json_search.first_value(c, "path", "n")) == "/x"
    assert json.loads(value(json_search.first_mapping(c, "path"))) == {"Path": "/x", "n": 1}
    assert tuple(value(json_search.people(c, ("name",), ("engName",), ("inventor",)))) == (["Kim"], ["KIM"])
    for bad in (None, "", "{", "3"):
        assert value(json_search.values_of(L(bad).cast("string"), "x")) == [] and value(json_search.first_mapping(L(bad).cast("string"), "x")) is None
