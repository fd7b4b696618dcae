"""Patent documents and reports laid out from the standard tables, and what is read out of them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import patents
from ..operators import linkage, reports
from ..sources.tables import table
from .registry import query

_HEADS = (("ABSTRACT", "SUMMARY OF THE INVENTION", "DETAILED DESCRIPTION"), ("요약", "과제의 해결 수단", "발명을 실시하기 위한 구체적인 내용"), ("摘要", "发明内容", "具体实施方式"), ("要約", "課題を解決するための手段", "発明を実施するための形態"))


@query("""SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS language, sha256(coalesce(text, '')) || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'ends' ELSE '' END AS abstract, 'from ' || coalesce(source, 'nowhere') AS solution, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'part ' || doc_id END AS detailed_description FROM documents""")
def patent_sections_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of records in four languages: each document's digest, source and number stand under that language's headings, some with Markdown marks, some missing."""
    language = F.col("doc_id") % 4
    head = lambda k: F.coalesce(*(F.when(language == i, h[k]) for i, h in enumerate(_HEADS)))
    line = F.lit("\n")
    last = F.when(F.col("doc_id") % 5 != 0, F.concat(head(2), line, F.lit("part "), F.col("doc_id").cast("string"))).otherwise("")
    first = F.concat(F.sha2(F.coalesce("text", F.lit("")), 256), F.when(F.col("doc_id") % 3 == 0, "\nends").otherwise(""))
    laid = F.concat(F.lit("cover\n"), head(0), line, first, line, F.lit("## "), head(1), F.lit("  \nfrom "), F.coalesce("source", F.lit("nowhere")), line, last)
    s = F.col("s")
    rows = table(spark, sf_dir, "documents").select("doc_id", language.cast("int").alias("language"), patents.section_map(laid).alias("s"))
    return rows.select("doc_id", "language", s["abstract"].alias("abstract"), s["solution"].alias("solution"), s["detailed_description"].alias("detailed_description"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("l_linenumber", "l_partkey", "l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))


_NUMBERED = "SELECT l_orderkey, l_linenumber AS n, l_partkey AS part, l_linenumber > 1 AND l_returnflag <> 'R' AS leans, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS k FROM lineitem"


@query(f"""SELECT l_orderkey, CAST(n AS INTEGER) AS claim_no, NOT leans AS is_independent, CAST(CASE WHEN leans THEN n - 1 END AS INTEGER) AS dependency,
  CASE WHEN leans THEN '제' || (n - 1) || '항에 있어서, 부품 ' || part || '를 더 포함하는 장치' ELSE '부품 ' || part || '를 포함하는 장치' END AS text FROM ({_NUMBERED})""")
def korean_claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims out of claim sections: each order's lines as claims, some of which refer to the one before."""
    n = lambda x: x["l_linenumber"].cast("string")
    leans = lambda x: (x["l_linenumber"] > 1) & (x["l_returnflag"] != "R")
    body = lambda x: F.when(leans(x), F.concat(F.lit("제"), (x["l_linenumber"] - 1).cast("string"), F.lit("항에 있어서, 부품 "), x["l_partkey"].cast("string"), F.lit("를 더 포함하는 장치"))).otherwise(F.concat(F.lit("부품 "), x["l_partkey"].cast("string"), F.lit("를 포함하는 장치")))
    text = F.concat(F.array_join(F.transform("lines", lambda x: F.concat(F.lit("청구항 "), n(x), F.lit("\n"), body(x))), "\n"), F.lit("\n# 발명의 설명\n청구항 99\n아니다"))
    rows = _claims(spark, sf_dir).select("l_orderkey", F.explode_outer(patents.claim_list(text)).alias("c")).where("c IS NOT NULL")
    return rows.select("l_orderkey", "c.claim_no", "c.is_independent", "c.dependency", "c.text")


@query("""SELECT o_orderkey, '10-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS registration_number, '10-2001-' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS application_number, 'Device of ' || c_mktsegment AS title,
  '2001-' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || '-09' AS filing_date, 'Firm' || c_nationkey || ' Inc.' AS assignee, 'G06F ' || (o_custkey % 90 + 10) || '/' || (o_orderkey % 90 + 10) AS cpc, CAST(o_orderkey % 20 + 1 AS INTEGER) AS claim_count
FROM orders JOIN customer ON o_custkey = c_custkey""")
def cover_page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover pages by their field numbers: an order with its customer is laid out as one."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = lambda c: F.col(c).cast("string")
    L = F.lit
    page = F.concat(
        L("(19) 대한민국특허청(KR)\n(12) 등록특허공보(B1)\n(45) 공고일자 2002년01월05일\n(11) 등록번호 10-"), F.lpad(s("o_orderkey"), 7, "0"), L("\n(24) 등록일자 2001년12월30일\n(51) 국제특허분류\nCPC특허분류\nG06F "),
        (F.col("o_custkey") % 90 + 10).cast("string"), L("/"), (F.col("o_orderkey") % 90 + 10).cast("string"), L(" (2013.01)\n(21) 출원번호 10-2001-"), F.lpad(s("o_custkey"), 7, "0"), L("\n(22) 출원일자 2001년"),
        (F.col("o_orderkey") % 12 + 1).cast("string"), L("월9일\n(73) 특허권자\nFirm"), s("c_nationkey"), L(" Inc.\n서울특별시 중구\n(72) 발명자\n홍길동\n서울특별시\n전체 청구항 수 : 총 "), (F.col("o_orderkey") % 20 + 1).cast("string"),
        L(" 항\n(54) 발명의 명칭 Device of "), s("c_mktsegment"), L("\n(57) 요 약\nx"),
    )
    laid = rows.select("o_orderkey", page.alias("page"))
    f = patents.cover_fields(F.col("page"))  # fields are taken out of the expression, so that the others aren't computed
    plain = lambda *names: (f[n].alias(n) for n in names)
    lists = (F.array_join(f[n], "|").alias(n) for n in ("assignee", "cpc"))
    return laid.select("o_orderkey", *plain("registration_number", "application_number", "title", "filing_date"), *lists, *plain("claim_count"))


@query("""SELECT o_orderkey, '도' || (o_orderkey % 3 + 1) AS figure_number, 'order' || o_orderkey || '/image' || (o_orderkey % 3 + 1) || '.png' AS image_path, 'drawing_section' AS image_source FROM orders""")
def representative_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representative figure of the cover found among the drawings."""
    key, n = F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 3 + 1).cast("string")
    drawing = lambda k: F.concat(F.lit(f"- 도면 {k}\n![image {k}](<order"), key, F.lit(f"/image{k}.png>)\n"))
    page = F.concat(F.lit("대 표 도 - 도"), n, F.lit("\n![image 0](<cover.png>)\n# 도면\n"), *(drawing(k) for k in (1, 2, 3)))
    found = table(spark, sf_dir, "orders").select("o_orderkey", patents.representative_drawing(page).alias("d"))
    return found.select("o_orderkey", "d.figure_number", "d.image_path", "d.image_source")


@query("""SELECT l_orderkey, l_linenumber, 'KR10' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') || ' B1|US' || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') || ' B2' || CASE WHEN l_returnflag = 'R' THEN '|JP' || (1988 + l_linenumber) || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || ' A' ELSE '' END AS cited
FROM lineitem WHERE l_returnflag <> 'A'""")
def cited_publication_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication numbers named in running text, in three countries' forms and an era's years."""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'")
    padded = lambda c, k: F.lpad(F.col(c).cast("string"), k, "0")
    era = F.when(F.col("l_returnflag") == "R", F.concat(F.lit(" 그리고 特開平"), F.col("l_linenumber").cast("string"), F.lit("-"), padded("l_suppkey", 6), F.lit("号"))).otherwise("")
    said = F.concat(F.lit("선행문헌 KR10"), padded("l_partkey", 7), F.lit(" B1*, ＵＳ"), padded("l_suppkey", 7), F.lit("  B2 및 KR10"), padded("l_partkey", 7), F.lit(" B1"), era)
    return rows.select("l_orderkey", "l_linenumber", F.array_join(patents.cited_publications(said), "|").alias("cited"))


_CHAPTERS = ("자동차", "조선", "반도체", "이차전지", "철강")


@query(f"""WITH c AS (SELECT n_regionkey, n_nationkey + 2 AS first_page, list_element({list(_CHAPTERS)}, n_nationkey % 5 + 1) AS industry FROM nation WHERE n_nationkey % 7 <> 6)
SELECT n_regionkey, industry, CAST(first_page AS INTEGER) AS first_page, CAST(lead(first_page) OVER (PARTITION BY n_regionkey ORDER BY first_page) - 1 AS INTEGER) AS last_page FROM c""")
def report_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges of industries from tables of contents: each region is a report, its nations are chapters; a chapter of no industry has none."""
    industry = F.when(F.col("n_nationkey") % 7 == 6, "알 수 없는 ").otherwise(F.element_at(F.array(*map(F.lit, _CHAPTERS)), (F.col("n_nationkey") % 5 + 1).cast("int")))
    line = F.concat(F.lit(" 제"), F.col("n_nationkey").cast("string"), F.lit("장 "), industry, F.lit("산업 ·········· "), (F.col("n_nationkey") + 1).cast("string"))
    texts = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    return reports.chapter_ranges(texts, "n_regionkey", "text")


_Q = "CAST(l_quantity AS INTEGER) * 3 - 20"


@query(f"""SELECT l_orderkey, l_linenumber, concat_ws('|', CASE WHEN l_linenumber = 3 THEN 'label' END, CASE WHEN NOT ({_Q} BETWEEN 0 AND 100) THEN 'score' END, CASE WHEN l_returnflag NOT IN ('A', 'B', 'C') THEN 'grade' END, CASE WHEN l_linestatus = 'O' THEN 'rationale' END, CASE WHEN NOT (l_discount * 12 BETWEEN 0 AND 1) THEN 'confidence' END) AS issues FROM lineitem""")
def axis_result_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What axis results break; a line's columns stand for a result."""
    n = F.col("l_quantity").cast("int") * 3 - 20
    issues: Column = linkage.axis_issues(F.when(F.col("l_linenumber") != 3, "axis").otherwise(" "), n, F.col("l_returnflag"), F.when(F.col("l_linestatus") != "O", "because"), F.col("l_discount") * 12)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("|", issues).alias("issues"))


@query("""SELECT o_orderkey, 'what it is for ' || o_orderkey AS technical_field, 'what was before' AS background_art, 'a better way by ' || o_custkey AS solution, CASE WHEN o_orderkey % 2 = 0 THEN 'in detail' ELSE '' END AS detailed_description FROM orders""")
def us_specification_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of US specifications between running heads and page numbers."""
    key, by = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    detail = F.when(F.col("o_orderkey") % 2 == 0, "\nDETAILED DESCRIPTION\nin detail\n").otherwise("\n")
    text = F.concat(F.lit("US 12,345 B2\nTECHNICAL FIELD\nwhat it is for "), key, F.lit("\nSheet 1 of 9\nBACKGROUND ART\n17\nwhat was before\nSUMMARY OF THE INVENTION\na better way by "), by, detail, F.lit("What is claimed is:\n1. A thing"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", patents.us_sections(text).alias("s"))
    return found.select("o_orderkey", "s.technical_field", "s.background_art", "s.solution", "s.detailed_description")
