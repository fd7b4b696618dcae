"""Families of industry reports that are cut page by page, each by its own marks.

A family says where its body begins, which pages are no text, which phrases name a heading, and which topics it deals with. Fixed
values: phrases, pages and marks are the reports' own."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import COMMON_INDUSTRY
from ..functions import reports
from ..functions.patents import let
from . import documents, positional


@dataclass(frozen=True)
class Family:
    """topics: (name, first page, industry); a topic named on a page holds until the next, else pages tell it."""

    first_page: int = 1
    last_page: int = 1 << 30
    size: int = 500
    overlap: int = 60
    least: int = 1
    industry: str = COMMON_INDUSTRY
    drop: tuple[str, ...] = ()
    drop_starts: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()
    headings: tuple[str, ...] = ()
    loose: bool = False
    topics: tuple[tuple[str, int, str], ...] = ()
    sections: tuple[str, ...] = field(default=())


_BOILERPLATE = ("Business Contacts", "Contact us", "home.kpmg/kr", "The information contained herein is of a general nature", "무단 배포")
_FOOTER = (r"© 2026 KPMG Samjong Accounting Corp\..*?All rights reserved\.",)
FAMILIES = {
    "consulting_ai": Family(
        first_page=3, industry="AI", drop=_BOILERPLATE, drop_starts=("Contents ",), remove=_FOOTER,
        headings=(
            "Executive Summary", "AI 시장과 기술, 어디까지 왔나", "AI 생태계 및 기술 진화 방향", "AI 활용 목적 및 AI 비즈니스 모델 구조", "AI 활용 목적 및 AI 도입 기업의 AI 활용 목적", "AI를 활용한 수익화 유형",
            "AI로 재편되는 산업별 수익화 전략", "AI가 바꾸는 미래 변화상 및 기업의 기회", "글로벌 주요국의 AI 지원 및 규제 정책", "글로벌 AI 생태계 속 한국의 비즈니스 기회", "빅테크·M7 기업의 경쟁·협력 구도 및 한국의 대응 방안",
            "IT 산업", "통신 산업", "모빌리티 산업", "헬스케어 산업", "유통 산업", "소비재 산업", "광고·미디어 산업", "금융 산업", "Thought Leadership I", "Thought Leadership II", "Thought Leadership III",
        ),
    ),
    "consulting_fintech": Family(
        first_page=3, industry="핀테크", drop=("[Appendix]", "Methodology", *_BOILERPLATE), remove=_FOOTER, loose=True,
        headings=(
            "Executive Summary", "2026년 핀테크 시장 전망", "글로벌 핀테크 투자 동향과 전망", "글로벌 핀테크 투자 동향", "섹터별 핀테크 투자 동향과 전망", "섹터별 핀테크 투자 동향", "지역별 핀테크 투자 동향과 전망",
            "지역별 핀테크 투자 동향", "디지털자산", "지급결제", "인슈어테크", "웰스테크", "사이버보안", "레그테크",
        ),
    ),
    "machine_whitepaper": Family(first_page=11, size=1_000, overlap=150, industry="일반기계", drop_starts=("표 목차", "그림 목차"), remove=(r"제1장 제2장 제3장 제4장 제5장 붙임자료 .{0,80}", r"\d{3}\s+한국기계연구원|DX전략연구단 / 기계정책센터 \d{3}")),
    "technology_trends": Family(
        first_page=11, size=420, overlap=70, least=180, drop=("Copyright © 2025 McKinsey & Company", "No part of this publication may be copied", "The authors wish to thank", "Research methodology", "Introduction 2 Contents"),
        remove=(r"\b\d+\s+Technology Trends Outlook 2025\b",),
        topics=(
            ("Agentic AI", 13, "AI"), ("Artificial intelligence", 20, "AI"), ("Application-specific semiconductors", 29, "반도체"), ("Advanced connectivity", 36, "정보통신기기"), ("Cloud and edge computing", 43, "정보통신기기"),
            ("Immersive-reality technologies", 50, "정보통신기기"), ("Digital trust and cybersecurity", 57, "정보통신기기"), ("Quantum technologies", 65, "정보통신기기"), ("Future of robotics", 72, "일반기계"), ("Future of mobility", 78, "자동차"),
            ("Future of bioengineering", 85, "바이오헬스"), ("Future of space technologies", 92, "정보통신기기"), ("Future of energy and sustainability technologies", 99, "공통"),
        ),
        sections=("Latest developments", "Adoption developments across the globe", "In real life", "Underlying technologies", "Key uncertainties", "Big questions about the future", "Talent and labor markets", "Scoring the trend"),
    ),
    "emerging_technologies": Family(
        first_page=9, last_page=38, size=420, overlap=70, remove=(r"\bTop 10 Emerging Technologies of 2025\s+\d+\b", r"\bJune 2025 Top 10 Emerging Technologies of 2025\b"),
        topics=(
            ("Structural battery composites", 9, "이차전지"), ("Osmotic power systems", 12, "공통"), ("Advanced nuclear technologies", 15, "공통"), ("Engineered living therapeutics", 18, "바이오헬스"), ("GLP-1s for neurodegenerative disease", 21, "바이오헬스"),
            ("Autonomous biochemical sensing", 24, "바이오헬스"), ("Green nitrogen fixation", 27, "공통"), ("Nanozymes", 30, "바이오헬스"), ("Collaborative sensing", 33, "정보통신기기"), ("Generative watermarking", 36, "AI"),
        ),
        sections=("Strategic outlook",),
    ),
}


def _flat(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("‑"), F.lit("-"))


def heading_of(c: Column, family: Family) -> Column:
    """The first of the family's phrases on a page, also without its spaces where the family says so; null without one."""
    if not family.headings:
        return F.lit(None).cast("string")
    has = lambda x, h: F.contains(x, F.lit(h)) | (F.contains(x, F.lit(h.replace(" ", ""))) if family.loose else F.lit(False))
    return let(c, lambda x: F.coalesce(*(F.when(has(x, h), h) for h in family.headings)))


def machine_heading(c: Column) -> Column:
    """A numbered heading, else a chapter's, within a page of running text; null without one."""
    numbered, chapter = (F.trim(F.regexp_extract(c, p, 1)) for p in (r"\b([1-5]\s+[가-힣A-Za-z0-9/･·\s]{4,60})", r"제\s*[0-9]+\s*장\s*[∙·]?\s*([가-힣A-Za-z0-9/･·\s]{2,60})"))
    return F.coalesce(F.nullif(numbered, F.lit("")), F.nullif(chapter, F.lit("")))


def topic_named(c: Column, family: Family) -> Column:
    """The first topic that a page names, whatever the case and the kind of hyphen."""
    return let(_flat(c), lambda x: F.coalesce(*(F.when(F.contains(x, F.lit(n.lower())), n) for n, _, _ in family.topics)))


def topic_at(page: Column, family: Family) -> Column:
    """The topic whose pages hold a page."""
    return F.coalesce(*(F.when(page >= first, n) for n, first, _ in reversed(family.topics)))


def section_of(c: Column, family: Family) -> Column:
    return F.coalesce(*(F.when(F.contains(c, F.lit(s)), s) for s in family.sections), F.lit("Overview"))


def pages(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, page, text of each page by its mark; text before the first mark has no page."""
    mark = lambda line: reports.page_mark(line).cast("string")
    rows = df.select(key, F.explode(documents.marked_parts(reports.clean_report(F.col(column)), mark)).alias("s"))
    body = F.when(F.col("s.heading").isNull(), F.col("s.lines")).otherwise(F.slice("s.lines", F.lit(2), F.greatest(F.size("s.lines"), F.lit(1))))
    out = rows.select(key, F.col("s.section_no").alias("no"), F.col("s.heading").cast("int").alias("page"), documents.clean_section(F.array_join(F.transform(body, lambda x: F.trim(x)), "\n")).alias("text"))
    return out.where("text != ''")


def kept_pages(rows: DataFrame, family: Family) -> DataFrame:
    """Pages of a family's body without their running heads, and without pages that are no text."""
    text = F.col("text")
    for pattern in family.remove:
        text = F.regexp_replace(text, pattern, "")
    rows = rows.withColumn("text", documents.clean_section(text)).where((F.col("page").isNull() | F.col("page").between(family.first_page, family.last_page)) & (F.length("text") >= family.least))
    for words in family.drop:
        rows = rows.where(~F.contains("text", F.lit(words)))
    for words in family.drop_starts:
        rows = rows.where(~F.startswith("text", F.lit(words)))
    return rows


def chunks(df: DataFrame, key: str, column: str, source: str, year: str, family: Family) -> DataFrame:
    """Chunks of a family's reports: key, chunk_id, page, heading, topic, section, industry, text. Numbers grow within each report's topic, or industry where the family has no topics."""
    rows = kept_pages(pages(df, key, column), family)
    if family.topics:
        named = positional.carried(rows.where("page IS NOT NULL").withColumn("_named", topic_named(F.col("text"), family)), [key], "no", {"topic": F.col("_named")}).drop("_named")
        rows = named.withColumn("topic", F.coalesce("topic", topic_at(F.col("page"), family))).where("topic IS NOT NULL")
        industry = F.coalesce(*(F.when(F.col("topic") == n, i) for n, _, i in family.topics))
        rows = rows.withColumns({"section": section_of(F.col("text"), family), "industry": industry})
        rows = rows.withColumn("heading", F.when(F.col("section") == "Overview", F.col("topic")).otherwise(F.concat_ws(" - ", "topic", "section")))
    else:
        told = heading_of(F.col("text"), family) if family.headings else machine_heading(F.col("text"))
        page = F.when(F.col("page").isNotNull(), F.concat(F.lit("Page "), F.col("page").cast("string"))).otherwise("문서 개요")
        rows = rows.withColumns({"topic": F.lit(family.industry), "section": F.lit(None).cast("string"), "industry": F.lit(family.industry), "heading": F.coalesce(told, page)})
    cut = documents.chunks(rows, "text", family.size, family.overlap).where(reports.keeps(documents.clean_section(reports.without_table_lines(F.col("chunk")))))
    number = F.row_number().over(Window.partitionBy(key, "topic").orderBy("no", "chunk_no"))
    named = cut.join(df.select(key, F.col(source).alias("_source"), F.col(year).alias("_year")), key)
    return named.select(key, reports.chunk_id(F.col("_source"), F.col("_year"), F.col("topic"), F.col("page"), number).alias("chunk_id"), "page", "heading", "topic", "section", "industry", F.col("chunk").alias("text"))
