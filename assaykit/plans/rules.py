"""Scores, numbers, lookups, sites and gates over the standard tables; columns of orders, lines and pages stand for what a model or an archive says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import numbers, reports
from ..functions.patents import section_map
from ..operators import axes, gates, lookups, reports as report_rows, site
from ..sources.tables import table
from .registry import query


def _ints(**columns: Column) -> Column:
    return F.create_map(*(x for k, c in columns.items() for x in (F.lit(k), c.cast("int"))))


_GRADE = "CASE WHEN {0} >= 70 THEN 'A' WHEN {0} >= 50 THEN 'B' ELSE 'C' END"
_Q = "CAST(l_quantity AS INTEGER)"


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, least(30, {_Q}) AS official, least(45, l_linenumber * 9) AS direct, least(25, CAST(floor(l_discount * 300) AS INTEGER)) AS context FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(official AS INTEGER) AS official, CAST(direct AS INTEGER) AS direct, CAST(context AS INTEGER) AS context, CAST(official + direct + context AS INTEGER) AS score, {_GRADE.format('official + direct + context')} AS grade FROM p""")
def axis_business_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business-fit scores clamped to their maxima; the line's numbers stand for a model's."""
    raw = _ints(official_business_evidence=F.col("l_quantity"), product_function_direct_match=F.col("l_linenumber") * 9, business_context_fit=F.floor(F.col("l_discount") * 300))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", axes.business_fit(raw).alias("r"))
    s = "r.subscores."
    return rows.select("l_orderkey", "l_linenumber", F.col(f"{s}official_business_evidence").alias("official"), F.col(f"{s}product_function_direct_match").alias("direct"), F.col(f"{s}business_context_fit").alias("context"), "r.score", "r.grade")


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_discount, least(20, {_Q}) + least(20, l_linenumber * 4) + least(20, greatest(0, {_Q} - 20)) + least(20, greatest(0, 10 - l_linenumber)) AS parts, CASE WHEN l_returnflag <> 'R' THEN l_linenumber * 2 END AS growth FROM lineitem),
t AS (SELECT *, parts + coalesce(growth, 0) AS total FROM p)
SELECT l_orderkey, l_linenumber, CAST(least(100, total) AS INTEGER) AS score, {_GRADE.format('total')} AS grade, CASE WHEN growth IS NULL THEN least(l_discount * 10, 0.49) ELSE least(l_discount * 10, 1.0) END AS confidence FROM t""")
def axis_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market scores of four parts and growth, unknown for returned lines."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    raw = _ints(industry_marketability=q, global_business=n * 4, competitiveness=q - 20, invention_market_linkage=10 - n)
    growth = F.when(F.col("l_returnflag") != "R", n * 2).cast("int")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", axes.market(raw, growth, F.col("l_discount") * 10).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "r.score", "r.grade", "r.confidence")


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'N' AS no_prior, l_linestatus = 'F' AS no_citing, {_Q} AS q, l_linenumber AS n FROM lineitem),
s AS (SELECT *, least(CASE WHEN no_prior THEN 20 ELSE 40 END, CASE WHEN no_prior THEN q ELSE q + n * 3 END) AS stability, least(40, n * 6) AS protection, least(CASE WHEN no_citing THEN 16 ELSE 20 END, CASE WHEN no_citing THEN n * 2 ELSE n * 2 + 4 END) AS defence FROM p)
SELECT l_orderkey, l_linenumber, CAST(stability AS INTEGER) AS stability, CAST(protection AS INTEGER) AS protection, CAST(defence AS INTEGER) AS defence, CAST(stability + protection + defence AS INTEGER) AS score, {_GRADE.format('stability + protection + defence')} AS grade FROM s""")
def axis_legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal scores from details; details that can't be judged are left out and their points taken from the maximum."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int")
    details = F.create_map(F.lit("right_stability"), _ints(prior_art_overlap=n * 3, validity=q), F.lit("portfolio_defensive_value"), _ints(follow_on_right_signal=F.lit(4), family=n * 2))
    scored = axes.legal(_ints(claim_protection=n * 6), details, F.col("l_returnflag") == "N", F.col("l_linestatus") == "F")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scored.alias("r"))
    s = "r.subscores."
    return rows.select("l_orderkey", "l_linenumber", F.col(f"{s}right_stability").alias("stability"), F.col(f"{s}claim_protection").alias("protection"), F.col(f"{s}portfolio_defensive_value").alias("defence"), "r.score", "r.grade")


@query("""WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS official, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority LIKE '5%') AS weak, count(*) FILTER (o_orderstatus = 'P') AS owned FROM orders GROUP BY o_custkey)
SELECT o_custkey, official, owned, CAST(CASE WHEN official = 0 AND owned = 0 THEN 0 WHEN official = 0 THEN CASE WHEN owned = 1 THEN 8 ELSE 16 END WHEN weak >= official THEN 8 WHEN official >= 3 THEN 30 WHEN official = 2 THEN 24 ELSE 16 END AS INTEGER) AS score,
  CASE WHEN official = 0 AND owned = 0 THEN 'no_official_evidence' WHEN official = 0 THEN 'owned_media_only' WHEN weak >= official THEN 'broad_or_weak_only' WHEN official >= 3 THEN 'official_3_or_more' WHEN official = 2 THEN 'official_2' ELSE 'official_1' END AS reason FROM c""")
def evidence_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for official evidence by customer: finished orders stand for official pieces, pending ones for owned media."""
    done = F.col("o_orderstatus") == "F"
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(done).alias("official"), F.count_if(done & F.col("o_orderpriority").startswith("5")).alias("weak"), F.count_if(F.col("o_orderstatus") == "P").alias("owned"))
    return rows.withColumn("p", axes.presence_score(F.col("official"), F.col("weak"), F.col("owned"))).select("o_custkey", "official", "owned", "p.score", "p.reason")


@query("""SELECT o_orderkey, 'US-' || o_orderkey || '-B' || (o_shippri + 1) AS key, 'US2010' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 7, '0') || 'A1' AS application_id, 'US' || o_orderkey || 'B2' AS registration_id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || 'B' || (o_shippri + 1) AS filed_as,
  CAST(o_orderkey AS VARCHAR) AS without_suffix FROM (SELECT o_orderkey, o_custkey % 2 AS o_shippri FROM orders)""")
def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of one number: keys, archive ids, padded forms, registrations without their part."""
    key = F.col("o_orderkey").cast("string")
    kind = F.concat(F.lit("B"), (F.col("o_custkey") % 2 + 1).cast("string"))
    spelled = F.concat_ws(" ", F.lit("us"), key, kind)
    application = F.concat(F.lit("US2010"), (F.col("o_orderkey") % 1_000_000).cast("string"), F.lit("A1"))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", numbers.publication_key(spelled).alias("key"), numbers.publication_id(F.lit("US"), none, application).alias("application_id"), numbers.publication_id(F.lit("US"), key, none).alias("registration_id"),
        numbers.padded(spelled).alias("filed_as"), numbers.without_register_suffix(F.concat(key, F.lit("-0001"))).alias("without_suffix"),
    )


@query("""WITH t AS (SELECT o_orderkey, unnest([o_custkey * 7, o_custkey, o_custkey + 1]) AS k, unnest([1, 2, 3]) AS place FROM orders),
f AS (SELECT o_orderkey, k, c_name, row_number() OVER (PARTITION BY o_orderkey ORDER BY place) AS n FROM t JOIN customer ON c_custkey = k WHERE c_mktsegment <> 'BUILDING')
SELECT o.o_orderkey, f.k AS found_key, f.c_name FROM orders o LEFT JOIN f ON o.o_orderkey = f.o_orderkey AND n = 1""")
def ordered_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several candidate keys that a table knows."""
    known = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lookups.probe(rows, "o_orderkey", F.array(F.col("o_custkey") * 7, F.col("o_custkey"), F.col("o_custkey") + 1), known, "c_custkey", ["c_name"]).drop("o_custkey")


@query("""WITH ids AS (SELECT o_orderkey, unnest([o_custkey * 3, o_custkey, o_custkey + 1, o_custkey + 2]) AS id, unnest([1, 2, 3, 4]) AS pos FROM orders),
k AS (SELECT o_orderkey, id, c_name, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) AS place FROM ids JOIN customer ON c_custkey = id)
SELECT o_orderkey, CAST(place AS INTEGER) AS place, CAST(id AS VARCHAR) AS evidence_id, c_name AS text FROM k WHERE place <= 2""")
def cited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two cited ids that are known, with their titles."""
    none = F.lit(None).cast("string")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("evidence_id"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("title"), *(none.alias(c) for c in ("summary", "context", "content", "source", "url")))
    ids = F.array(*((c).cast("string") for c in (F.col("o_custkey") * 3, F.col("o_custkey"), F.col("o_custkey") + 1, F.col("o_custkey") + 2)))
    cited = table(spark, sf_dir, "orders").select("o_orderkey", ids.alias("ids"))
    return lookups.cited_details(cited, known, by="o_orderkey", ids="ids", most=2).select("o_orderkey", "place", "evidence_id", "text")


_URL = "regexp_extract(url, '^([A-Za-z]+://[^#]*)', 1)"


@query(f"""WITH p AS (SELECT page_id % 10 AS q, page_id, CASE WHEN page_id % 9 = 0 THEN '' WHEN page_id % 9 = 1 THEN 'mailto:x' WHEN page_id % 9 = 2 THEN url || '.pdf' WHEN page_id % 9 > 5 THEN 'https://shop.example.com/' || (page_id % 3) ELSE url END AS url FROM pages),
u AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) AS path FROM p),
r AS (SELECT *, CASE WHEN url = '' THEN 'empty_url' WHEN url LIKE 'mailto:%' THEN 'invalid_url' WHEN NOT (host = 'example.com' OR host LIKE '%.example.com') THEN 'external_domain' WHEN regexp_matches(path, '[.](pdf|png|jpg|jpeg|gif|svg|zip)$') THEN 'file_url' END AS why FROM u),
d AS (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY q, why IS NULL, {_URL} ORDER BY page_id) > 1 THEN 'duplicate_url' ELSE why END AS reason FROM r)
SELECT q, page_id, reason AS skip_reason FROM (SELECT *, count(*) FILTER (reason IS NULL) OVER (PARTITION BY q ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d) WHERE before < 4""")
def site_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results with the first reason for which each is skipped; ten pages' queries of made-up results."""
    n = F.col("page_id") % 9
    url = F.when(n == 0, "").when(n == 1, "mailto:x").when(n == 2, F.concat("url", F.lit(".pdf"))).when(n > 5, F.concat(F.lit("https://shop.example.com/"), (F.col("page_id") % 3).cast("string"))).otherwise(F.col("url"))
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("q"), "page_id", url.alias("url"), F.lit("").alias("content"))
    return site.candidates(rows, by="q", order="page_id", domains=("example.com",), most=4).select("q", "page_id", "skip_reason")


@query("""WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'market' ELSE 'legal' END AS axis, CASE WHEN length(text) < 80 THEN 'query_rewriting' WHEN length(text) < 200 THEN 'valuation_retry' ELSE 'passed' END AS state FROM conversations),
c AS (SELECT conv_id, axis, CASE WHEN state = 'query_rewriting' AND axis = 'legal' THEN 'valuation_retry' ELSE state END AS state FROM s)
SELECT conv_id, CASE WHEN count(*) FILTER (state = 'query_rewriting') > 0 THEN 'research' WHEN count(*) FILTER (state = 'valuation_retry') > 0 THEN 'valuation' ELSE 'writing' END AS next_team FROM c GROUP BY conv_id""")
def gate_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where work goes after all axes' verdicts; lengths of turns stand for verdicts."""
    axis = F.when(F.col("turn") % 2 == 0, "market").otherwise("legal")
    n = F.length("text")
    state = gates.coerced_state(axis, F.when(n < 80, "query_rewriting").when(n < 200, "valuation_retry").otherwise("passed"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(gates.next_team(F.collect_set(state)).alias("next_team"))


@query("""SELECT doc_id, 'report_' || source || '_' || (2000 + doc_id % 26) || '.pdf' AS name, CAST(2000 + doc_id % 26 AS INTEGER) AS year FROM documents WHERE source IS NOT NULL""")
def report_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("report_"), "source", F.lit("_"), (2000 + F.col("doc_id") % 26).cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", name.alias("name"), reports.published_year(name).alias("year"))


@query()
def report_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut as reports are: sections, filters, windows, ids. Headings and filters of hangul have no SQL twin; tests hold them against fixtures."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("src"), F.lit(2025).alias("year"))
    kept = report_rows.kept(report_rows.sections(docs, "doc_id", "text", keep=("src", "year")))
    return report_rows.chunks(kept, "doc_id", "src", "year", size=200, overlap=30).select("doc_id", "section_no", "chunk_no", "chunk_id", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT doc_id, sha256(coalesce(text, '')) || chr(10) || 'of ' || length(coalesce(text, '')) || ' characters' AS abstract, '1. x' AS claims, coalesce(source, '') AS solution, '' AS effect FROM documents""")
def patent_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by their headings, from records laid out as patents are; each text stands in its record by its digest."""
    body = F.coalesce("text", F.lit(""))
    laid = F.concat(F.lit("ABSTRACT\n"), F.sha2(body, 256), F.lit("\nof "), F.length(body).cast("string"), F.lit(" characters\n# CLAIMS\n1. x\nSUMMARY\n"), F.coalesce("source", F.lit("")))
    found = table(spark, sf_dir, "documents").select("doc_id", section_map(laid).alias("s"))
    return found.select("doc_id", F.col("s.abstract").alias("abstract"), F.col("s.claims_text").alias("claims"), F.col("s.solution").alias("solution"), F.col("s.effect").alias("effect"))
