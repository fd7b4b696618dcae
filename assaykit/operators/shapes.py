"""Rows in the shapes that later steps read: fields under any of their names, statuses by precedence, typed empties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import numbers, text
from ..functions.patents import let

#: Names under which sources give a field, in order of preference.
COMPETITOR_FIELDS = {
    "title": ("inventionTitle", "title", "inventionName"), "applicant": ("applicantName", "applicant", "applicantNameList"), "application_number": ("applicationNumber", "applicationNo"),
    "registration_number": ("registerNumber", "registrationNumber"), "ipc": ("ipcNumber", "ipc"), "summary": ("abstract", "astrtCont", "summary"),
    "opened": ("openDate", "publicationDate"), "applied": ("applicationDate", "applicationDt"),
}
CITATION_FIELDS = {
    "application_number": ("ApplicationNumber",), "original_number": ("OriginalcitationLiteraturenumber",), "original_date": ("OriginalcitationLiteraturenumberDate",), "standard_number": ("StandardCitationLiteraturenumber",),
    "country_code": ("StandardCitationLiteratureCountryCode",), "country_name": ("StandardCitationLiteratureCountryCodeName",), "kind_code": ("StandardCitationIdentificationCode",), "publication_date": ("StandardCitationLiteraturePublicationDate",),
    "standard_status_code": ("StandardStatusCode",), "standard_status_name": ("StandardStatusCodeName",), "citation_type_code": ("CitationLiteratureTypeCode",), "citation_type_name": ("CitationLiteratureTypeCodeName",),
}
CITING_FIELDS = {
    "standard_citation_application_number": ("StandardCitationApplicationNumber",), "citing_application_number": ("ApplicationNumber",), "standard_status_code": ("StandardStatusCode",),
    "standard_status_name": ("StandardStatusCodeName",), "citation_type_code": ("CitationLiteratureTypeCode",), "citation_type_name": ("CitationLiteratureTypeCodeName",),
}
TARGET_FIELDS = {
    "management_number": ("management_number", "관리번호"), "title": ("title", "발명의 명칭"), "title_draft": ("title_draft", "발명의 명칭(가제)"), "title_final": ("title_final", "발명의 명칭(최종)"),
    "business_area": ("business_area", "관련사업 분야"), "technology_area": ("technology_area", "관련기술 분야"), "related_product": ("related_product", "관련제품"),
}
STANDARDISED = "표준화"
READY, ABSTRACT, UNPARSED, IDENTIFIER = "claim_comparison_ready", "abstract_only", "fulltext_claims_unparsed", "identifier_only"


def field(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the named columns that holds anything, as text; null where df has none of them."""
    there = {c.lower(): c for c in df.columns}
    found = [text.present(F.col(f"`{there[n.lower()]}`").cast("string")) for n in names if n.lower() in there]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def shaped(df: DataFrame, fields: dict[str, tuple[str, ...]], *keep: str) -> DataFrame:
    return df.select(*keep, *(field(df, names).alias(name) for name, names in fields.items()))


def pick(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns; those that df lacks are null texts."""
    return df.select(*(F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names))


def day(c: Column) -> Column:
    """yyyymmdd or yyyy.mm.dd as a date's text, else null."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    made = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return F.when(F.length(digits) >= 8, made.try_cast("date").cast("string"))


def competitor_rows(df: DataFrame, by: str, order: str, source: str) -> DataFrame:
    """Search results as evidence: the date is the opening's, else the application's; without an abstract title and applicant stand for it; ranks as they came."""
    rows = shaped(df, COMPETITOR_FIELDS, by, order)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    content = F.coalesce("summary", F.nullif(F.concat_ws(" - ", "title", "applicant"), F.lit("")))
    return rows.select(by, rank.alias("rank"), F.lit("competitor_patent").alias("source_type"), F.lit(source).alias("source"), "title", F.coalesce(day(F.col("opened")), day(F.col("applied"))).alias("published_at"), content.alias("content"), "application_number", "registration_number", "applicant", "ipc")


def citation_rows(df: DataFrame, *keep: str) -> DataFrame:
    """Citations as an archive gives them; standardised are those with its mark and a number."""
    rows = shaped(df, CITATION_FIELDS, *keep)
    standard = F.coalesce((F.col("standard_status_name") == STANDARDISED) & F.col("standard_number").isNotNull(), F.lit(False))
    shown = numbers.display_number(F.col("country_code"), F.col("standard_number"), F.col("kind_code"), F.col("original_number"))
    kinds = F.filter(F.array("citation_type_code"), lambda x: x.isNotNull())
    return rows.withColumns({"original_date": day(F.col("original_date")), "publication_date": day(F.col("publication_date")), "citation_type_codes": kinds, "display_number": shown, "is_standardized": standard})


def citing_rows(df: DataFrame, *keep: str) -> DataFrame:
    rows = shaped(df, CITING_FIELDS, *keep)
    return rows.withColumn("is_standardized", F.coalesce(F.col("standard_status_name") == STANDARDISED, F.lit(False)))


def family_rows(df: DataFrame, country: str, registration: str) -> DataFrame:
    """Members of a family that have a country or a number; numbers without the part of their right."""
    some = text.present(F.col(country)).isNotNull() | text.present(F.col(registration)).isNotNull()
    return df.where(some).withColumn(registration, numbers.without_register_suffix(F.col(registration)))


def comparison_status(status: Column, n_claims: Column, abstract: Column, fulltext: Column) -> Column:
    """How far a document can be compared: by claims, else what was said before, else by its abstract, else a text whose claims were not read, else not at all."""
    said = F.trim(F.coalesce(status, F.lit("")))
    has = text.present(abstract).isNotNull()
    return F.when((said == "comparison_ready") | (F.coalesce(n_claims, F.lit(0)) > 0), READY).when(said != "", said).when(has, ABSTRACT).when(F.coalesce(fulltext, F.lit(False)), UNPARSED).otherwise(IDENTIFIER)


def has_detail(status: Column, n_claims: Column, abstract: Column) -> Column:
    return (F.coalesce(status, F.lit("")) != IDENTIFIER) & ((F.coalesce(n_claims, F.lit(0)) > 0) | text.present(abstract).isNotNull() | (F.coalesce(status, F.lit("")) == UNPARSED))


def collection_status(df: DataFrame, by: str, status: str, candidates: Column) -> DataFrame:
    """Documents of each target by status, and its best one; candidates (an aggregate) that none resolved are identifiers only."""
    n = {s: F.count_if(F.col(status) == s) for s in (READY, ABSTRACT, UNPARSED)}
    rows = df.groupBy(by).agg(candidates.alias("candidate_count"), *(c.alias(f"{s}_count") for s, c in n.items()))
    best = F.coalesce(*(F.when(F.col(f"{s}_count") > 0, s) for s in n), F.lit("unknown"))
    left = F.greatest(F.lit(0), F.col("candidate_count") - sum((F.col(f"{s}_count") for s in n), F.lit(0)))
    return rows.withColumn(f"{IDENTIFIER}_count", left).withColumn("comparison_status", best)


def compressed_rows(df: DataFrame, now: Column) -> DataFrame:
    """Evidence with a model's answer on it (said_relevant, said_related, said_summary, said_facts): relevant unless it says otherwise, related only where it says so, but a company's own pages also without a word."""
    own = F.col("source_type") == "company_disclosure"
    facts = F.array_distinct(F.filter(F.transform(F.coalesce("said_facts", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    out = {
        "is_relevant": F.coalesce("said_relevant", F.lit(True)), "is_related": F.coalesce("said_related", own), "compressed_summary": F.trim(F.coalesce("said_summary", F.lit(""))), "key_facts": facts,
        "collected_at": F.coalesce("collected_at", now), "retrieval_score": F.when(F.col("source_type") == "industry_report", F.col("score").cast("double")),
        "title": F.coalesce(text.present(F.col("title")), F.when(F.col("source_type") == "industry_report", F.col("heading"))), "content": F.when(own, F.col("content")),
    }
    return df.withColumns(out).drop("said_relevant", "said_related", "said_summary", "said_facts", "heading", "score")


def selected(df: DataFrame, by: str, kinds: tuple[str, ...], order: str, most: int | None = 5) -> DataFrame:
    """Evidence of the given kinds, of each target the first so many."""
    rows = df.where(F.col("source_type").isin(*kinds))
    if most is None:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def is_domestic(country: Column, application: Column, home: str = "KR", prefix: str = "10-") -> Column:
    """By country, or where that is blank by how the application's number begins."""
    at = F.upper(F.trim(F.coalesce(country, F.lit(""))))
    return F.when(at != "", at == home).otherwise(F.coalesce(F.trim(application).startswith(prefix), F.lit(False)))


def is_abroad(country: Column, home: str = "KR") -> Column:
    return ~F.upper(F.trim(F.coalesce(country, F.lit("")))).isin("", home)


def identifier(management: Column, application: Column, registration: Column, own: Column) -> Column:
    """The number by which a record is looked up, with its field: management, application, registration, else its own id, which is a management number unless it is all digits."""
    pair = lambda c, name: F.when(text.present(c).isNotNull(), F.struct(F.lit(name).alias("field"), F.trim(c).alias("value")))
    rest = F.struct(F.when(own.rlike("^[0-9]+$"), "patent_id").otherwise("management_number").alias("field"), own.alias("value"))
    return F.coalesce(pair(management, "management_number"), pair(application, "application_number"), pair(registration, "registration_number"), rest)


def claim_context(claims: Column) -> Column:
    """Claims with texts, parted and counted."""
    some = F.filter(claims, lambda c: text.present(c["text"]).isNotNull())
    parts = lambda x: F.struct(F.filter(x, lambda c: c["is_independent"]).alias("independent"), F.filter(x, lambda c: ~F.coalesce(c["is_independent"], F.lit(False))).alias("dependent"), F.size(x).alias("total"))
    return let(some, parts)


def representative_text(claims: Column) -> Column:
    """The first independent claim's text, else the first one's, else empty."""
    own = F.get(F.filter(claims, lambda c: c["is_independent"] & text.present(c["text"]).isNotNull()), F.lit(0))["text"]
    return F.coalesce(own, F.get(claims, F.lit(0))["text"], F.lit(""))


def or_empty(df: DataFrame | None, spark, schema: T.StructType | str) -> DataFrame:
    """df, or a typed table without rows where a source gave nothing."""
    return df if df is not None else spark.createDataFrame([], schema)
