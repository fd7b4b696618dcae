"""Rows in shape: fields by any name, statuses by precedence, selections."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assaykit.operators import shapes


@pytest.fixture(scope="module")
def value(spark):
    return lambda c: spark.range(1).select(c.alias("v")).first()["v"]


def L(x, kind="string"):
    return F.lit(x).cast(kind)


def test_fields_under_any_name(spark):
    df = spark.createDataFrame([(" ", "two", 3), ("one", "two", None)], "`관련제품` string, related_product string, n int")
    assert [tuple(r) for r in shapes.shaped(df, {"p": ("관련제품", "related_product"), "m": ("N",), "x": ("none",)}).collect()] == [("two", "3", None), ("one", None, None)]
    assert [tuple(r) for r in shapes.pick(df, ["n", "y"]).collect()] == [(3, None), (None, None)]
    assert set(shapes.shaped(df, shapes.TARGET_FIELDS).columns) == set(shapes.TARGET_FIELDS)


def test_competitors(spark):
    df = spark.createDataFrame([("q", 2, "T", "A", None, "20200131", None, "77"), ("q", 1, None, "B", "sum", "bad", "2019.03.04", None), ("r", 1, None, None, None, None, "20190231", None)], "q string, seq int, inventionTitle string, applicantName string, astrtCont string, openDate string, applicationDate string, applicationNumber string")
    got = [(r["q"], r["rank"], r["title"], r["published_at"], r["content"], r["application_number"]) for r in shapes.competitor_rows(df, "q", "seq", "kipo").orderBy("q", "rank").collect()]
    assert got == [("q", 1, None, "2019-03-04", "sum", None), ("q", 2, "T", "2020-01-31", "T - A", "77"), ("r", 1, None, None, None, None)]


def test_citations(spark):
    df = spark.createDataFrame([(1, "KR", "123", "B1", "표준화", "E0801", "o1", "20200101"), (2, None, None, None, "표준화", None, "o2", None), (3, "US", "9", None, "x", "E1", "o3", "x")], "seq int, StandardCitationLiteratureCountryCode string, StandardCitationLiteraturenumber string, StandardCitationIdentificationCode string, StandardStatusCodeName string, CitationLiteratureTypeCode string, OriginalcitationLiteraturenumber string, StandardCitationLiteraturePublicationDate string")
    got = [(r["display_number"], r["is_standardized"], r["citation_type_codes"], r["publication_date"]) for r in shapes.citation_rows(df, "seq").orderBy("seq").collect()]
    assert got == [("KR123 B1", True, ["E0801"], "2020-01-01"), ("o2", False, [], None), ("US9", False, ["E1"], None)]
    assert [r["is_standardized"] for r in shapes.citing_rows(df, "seq").orderBy("seq").collect()] == [True, True, False]
    family = spark.createDataFrame([("KR", "10-0309314-0001"), ("", None), (None, "US5")], "c string, r string")
    assert [tuple(r) for r in shapes.family_rows(family, "c", "r").collect()] == [("KR", "10-0309314"), (None, "US5")]


def test_comparison_states(spark, value):
    state = lambda s, n, a, f: value(shapes.comparison_status(L(s), L(n, "int"), L(a), L(f, "boolean")))
    assert [state("comparison_ready", 0, None, None), state(None, 2, None, None), state("abstract_only", 0, None, True), state("", 0, "a", None), state(None, None, " ", True), state(None, None, None, None)] == [
        "claim_comparison_ready", "claim_comparison_ready", "abstract_only", "abstract_only", "fulltext_claims_unparsed", "identifier_only",
    ]
    assert [value(shapes.has_detail(L(s), L(n, "int"), L(a))) for s, n, a in (("identifier_only", 3, "x"), (None, 1, None), ("fulltext_claims_unparsed", 0, None), (None, 0, ""))] == [False, True, True, False]
    df = spark.createDataFrame([("t", "abstract_only"), ("t", "identifier_only"), ("u", "identifier_only"), ("t", "fulltext_claims_unparsed")], "t string, s string")
    got = {r["t"]: r.asDict() for r in shapes.collection_status(df, "t", "s", F.count("*")).collect()}
    assert got["t"]["comparison_status"] == "abstract_only" and got["t"]["identifier_only_count"] == 1 and got["u"]["comparison_status"] == "unknown" and got["u"]["identifier_only_count"] == 1


def test_compressed_evidence(spark):
    schema = "id int, source_type string, title string, heading string, content string, score string, collected_at string, said_relevant boolean, said_related boolean, said_summary string, said_facts array<string>"
    df = spark.createDataFrame([(1, "news", "t", None, "c", "0.5", None, None, None, " s ", [" a", "a", ""]), (2, "company_disclosure", "t", None, "c", None, "then", False, None, None, None), (3, "industry_report", " ", "h", "c", "0.7", None, None, True, None, [])], schema)
    got = {r["id"]: r.asDict() for r in shapes.compressed_rows(df, F.lit("now")).collect()}
    assert (got[1]["is_relevant"], got[1]["is_related"], got[1]["compressed_summary"], got[1]["key_facts"], got[1]["collected_at"], got[1]["retrieval_score"], got[1]["content"]) == (True, False, "s", ["a"], "now", None, None)
    assert (got[2]["is_relevant"], got[2]["is_related"], got[2]["content"], got[2]["collected_at"]) == (False, True, "c", "then")
    assert (got[3]["title"], got[3]["retrieval_score"], got[3]["is_related"]) == ("h", 0.7, True)


def test_selection_and_identity(spark, value):
    df = spark.createDataFrame([("t", i, k) for i, k in enumerate(["news", "x", "news", "report", "news"])], "t string, seq int, source_type string")
    assert [r["seq"] for r in shapes.selected(df, "t", ("news", "report"), "seq", 2).collect()] == [0, 2] and shapes.selected(df, "t", ("news",), "seq", None).count() == 3
    assert [value(shapes.is_domestic(L(c), L(a))) for c, a in (("kr", None), ("US", "10-1"), ("", "10-1"), (None, "US1"), (None, None))] == [True, False, True, False, False]
    assert [value(shapes.is_abroad(L(c))) for c in ("us", "KR", "", None)] == [True, False, False, False]
    names = [tuple(value(shapes.identifier(*(L(x) for x in row)))) for row in ((" m ", "a", "r", "1"), ("", "a", "r", "1"), (None, None, "r", "1"), (None, None, None, "12"), (None, None, None, "P12"))]
    assert names == [("management_number", "m"), ("application_number", "a"), ("registration_number", "r"), ("patent_id", "12"), ("management_number", "P12")]
    claims = spark.createDataFrame([([(1, "a", False), (2, "b", True), (3, " ", True)],), ([],)], "c array<struct<claim_no:int,text:string,is_independent:boolean>>")
    got = claims.select(shapes.claim_context(F.col("c")).alias("x"), shapes.representative_text(F.col("c")).alias("r")).collect()
    assert [c["claim_no"] for c in got[0]["x"]["independent"]] == [2] and [c["claim_no"] for c in got[0]["x"]["dependent"]] == [1] and got[0]["x"]["total"] == 2 and [r["r"] for r in got] == ["b", ""]
    assert shapes.or_empty(None, spark, "a int").count() == 0 and shapes.or_empty(df, spark, "a int") is df
