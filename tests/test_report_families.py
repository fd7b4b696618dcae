"""Reports cut page by page."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.operators import report_families as families

BODY = "A sentence of the body that is long enough to stay in a chunk of its own. " * 3


def made(spark, text: str, family: str):
    df = spark.createDataFrame([("r", text, "My Report.pdf", 2025)], "k string, t string, src string, year int")
    rows = families.chunks(df, "k", "t", "src", "year", families.FAMILIES[family])
    return [(r["page"], r["heading"], r["industry"], r["chunk_id"]) for r in rows.orderBy("page", "chunk_id").collect()]


def test_phrases_name_headings(spark):
    text = f"- 2 -\nExecutive Summary {BODY}\n- 3 -\nContents {BODY}\n- 4 -\nAI 시장과 기술, 어디까지 왔나 {BODY}\n- 5 -\nContact us {BODY}\n- 6 -\n{BODY}\n- 7 -\n금융 산업 {BODY}"
    assert made(spark, text, "consulting_ai") == [(4, "AI 시장과 기술, 어디까지 왔나", "AI", "My_Report_2025_AI_p4_001"), (6, "Page 6", "AI", "My_Report_2025_AI_p6_002"), (7, "금융 산업", "AI", "My_Report_2025_AI_p7_003")]
    assert [x[1] for x in made(spark, f"- 9 -\n디지털자산 {BODY}\n- 10 -\n글로벌핀테크투자동향 {BODY}\n- 11 -\nMethodology {BODY}", "consulting_fintech")] == ["디지털자산", "글로벌 핀테크 투자 동향"]


def test_topics_hold_until_the_next(spark):
    text = f"- 5 -\nAgentic AI {BODY}\n- 12 -\n{BODY}\n- 13 -\n{BODY}\n- 14 -\nQuantum Technologies: Key uncertainties {BODY}\n- 15 -\n{BODY}\n- 30 -\nResearch methodology {BODY}\n- 31 -\nFuture of mobility {BODY}"
    got = made(spark, text, "technology_trends")
    assert [(p, h, i) for p, h, i, _ in got] == [(13, "Agentic AI", "AI"), (14, "Quantum technologies - Key uncertainties", "정보통신기기"), (15, "Quantum technologies", "정보통신기기"), (31, "Future of mobility", "자동차")]
    assert got[2][3] == "My_Report_2025_Quantum_technologies_p15_002"
    emerging = made(spark, f"- 8 -\nNanozymes {BODY}\n- 9 -\n{BODY}\n- 13 -\nNanozymes Strategic outlook {BODY}\n- 39 -\n{BODY}", "emerging_technologies")
    assert [(p, h) for p, h, _, _ in emerging] == [(9, "Structural battery composites"), (13, "Nanozymes - Strategic outlook")]


def test_chapters_of_white_papers(spark):
    text = f"- 10 -\n{BODY}\n- 11 -\n제 2 장 산업 동향과 전망, {BODY}\n- 12 -\n표 목차 {BODY}\n- 13 -\n{BODY}"
    assert [(p, h) for p, h, _, _ in made(spark, text, "machine_whitepaper")] == [(11, "2 장 산업 동향과 전망"), (13, "Page 13")]
    df = spark.createDataFrame([(None,), ("",), ("no page " + BODY,)], "t string").withColumn("k", F.monotonically_increasing_id())
    assert [(r["page"], r["text"][:7]) for r in families.pages(df, "k", "t").collect()] == [(None, "no page")]
