"""Sets of evidence by target, briefs and tables as Markdown, replies as lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import briefs, evidence_sets
from ..sources.tables import table
from . import evidence
from .registry import query

_ORDER = "l_linenumber, l_partkey, l_suppkey"


@query(f"""WITH l AS (SELECT *, l_returnflag = 'R' AS cited, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R' ORDER BY {_ORDER}) AS n FROM lineitem)
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY cited DESC, {_ORDER}) AS INTEGER) AS place, cited, l_linenumber, l_partkey, l_suppkey FROM l WHERE cited OR n <= 2""")
def evidence_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a check is shown of each order's lines: all that are cited, then two others."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("o"), "l_returnflag")
    return evidence_sets.samples(rows, "l_orderkey", "o", F.col("l_returnflag") == "R", most=2).select("l_orderkey", "place", "cited", "o.*")


@query(f"""WITH v AS (SELECT l_orderkey, unnest([ROW({_ORDER}, 0, CAST(l_suppkey AS VARCHAR)), ROW({_ORDER}, 1, CASE WHEN l_returnflag = 'R' THEN ' ' ELSE CAST(l_partkey AS VARCHAR) END), ROW({_ORDER}, 2, l_returnflag)]) AS r FROM lineitem),
f AS (SELECT l_orderkey, r[5] AS value, min(ROW(r[1], r[2], r[3], r[4])) AS spot FROM v WHERE trim(r[5]) <> '' GROUP BY 1, 2)
SELECT l_orderkey, string_agg(value, '|' ORDER BY spot, value) AS identifiers FROM f GROUP BY l_orderkey""")
def reference_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct identifiers of each order's lines, in the order in which they first come."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("o"), "l_suppkey", F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("l_partkey").cast("string")).alias("part"), "l_returnflag")
    found = evidence_sets.identifiers(rows, "l_orderkey", "o", ["l_suppkey", "part", "l_returnflag"])
    return found.select("l_orderkey", F.concat_ws("|", "identifiers").alias("identifiers"))


@query(f"""WITH {evidence._JUDGED}, c AS (SELECT source, reason, count(*) AS n FROM judged GROUP BY 1, 2)
SELECT source, CAST(sum(n) AS BIGINT) AS input_count, CAST(coalesce(sum(n) FILTER (reason = 'passed'), 0) AS BIGINT) AS kept_count, CAST(coalesce(sum(n) FILTER (reason <> 'passed'), 0) AS BIGINT) AS rejected_count, coalesce(string_agg(reason || ':' || n, '|' ORDER BY reason) FILTER (reason <> 'passed'), '') AS rejected FROM c GROUP BY source""")
def filter_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the evidence filter kept and rejected of each source, and why."""
    judged = evidence.judged(table(spark, sf_dir, "documents"), evidence.target(spark, sf_dir))
    stats = evidence_sets.filter_stats(judged, "source")
    return stats.withColumn("rejected", F.array_join(F.transform("rejected", lambda r: F.concat(r["reason"], F.lit(":"), r["n"].cast("string"))), "|"))


_NL = "chr(10)"


@query(f"""WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS n FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n, string_agg('- part ' || l_partkey, {_NL} ORDER BY n) FILTER (n <= 6) AS parts, string_agg(n || '. by ' || l_suppkey, {_NL} ORDER BY n) FILTER (n <= 5) AS steps FROM l GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN n >= 3 THEN '' ELSE 'key_components,operation_steps' END AS missing, CASE WHEN n >= 3 THEN sha256('# 특허 이해 요약' || {_NL} || {_NL} || '## 한 줄 요약' || {_NL} || {_NL} || 'Order ' || l_orderkey || {_NL} || {_NL} || '## 해결하려는 문제' || {_NL} || {_NL} || 'why' || {_NL} || {_NL} || '## 핵심 아이디어' || {_NL} || {_NL} || 'how it works'
  || {_NL} || {_NL} || '## 주요 기술/구성' || {_NL} || {_NL} || parts || {_NL} || {_NL} || '## 작동 방식 ' || least(n, 5) || '단계' || {_NL} || {_NL} || steps || {_NL} || {_NL} || '## 기대 효과' || {_NL} || {_NL} || 'gain') END AS markdown_sha256 FROM g""")
def summary_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Briefs from replies in JSON, checked and laid out; orders with too few lines lack their lists."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    parts = F.transform("lines", lambda x: F.concat(F.lit(" part\n"), x["l_partkey"].cast("string")))
    steps = F.transform("lines", lambda x: F.concat(F.lit("by  "), x["l_suppkey"].cast("string")))
    reply = F.to_json(F.struct(F.concat(F.lit("Order\t"), F.col("l_orderkey").cast("string")).alias("one_line_summary"), F.lit(" why ").alias("problem"), F.lit("how  it works").alias("core_idea"), parts.alias("key_components"), steps.alias("operation_steps"), F.lit("gain").alias("expected_effect")))
    told = lambda b: F.struct(F.concat_ws(",", briefs.missing(b)).alias("missing"), F.sha2(briefs.markdown(b), 256).alias("markdown_sha256"))
    rows = held.select("l_orderkey", F.inline(F.transform(F.array(briefs.brief(F.from_json(reply, briefs.BRIEF))), told)))
    return rows.select("l_orderkey", "missing", "markdown_sha256")


@query("""WITH f AS (SELECT c_nationkey, c_mktsegment AS q, min(c_custkey) AS o FROM customer GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY o) AS n FROM f),
d AS (SELECT c_nationkey, coalesce(string_agg('market of ' || q, '|' ORDER BY n) FILTER (n <= 3 AND q <> 'BUILDING'), '') AS domestic FROM t GROUP BY 1)
SELECT n_nationkey, coalesce(domestic, '') AS domestic, CASE WHEN n_nationkey % 3 = 0 THEN 'first|second' ELSE '' END AS en FROM nation LEFT JOIN d ON n_nationkey = c_nationkey""")
def rewritten_query_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries by channel out of replies with text around their JSON: lists and mappings of lists, without what was asked before."""
    named = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment"))), lambda x: F.concat(F.lit("market  of "), x["c_mktsegment"])).alias("domestic"))
    rows = table(spark, sf_dir, "nation").join(named, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    en = F.when(F.col("n_nationkey") % 3 == 0, '{"a": ["first", " "], "b": "no list", "c": ["second", "first"]}').otherwise('"none"')
    reply = F.concat(F.lit('Here they are: {"domestic": '), F.coalesce(F.to_json("domestic"), F.lit("[]")), F.lit(', "en": '), en, F.lit("}\nGood luck."))
    lists = evidence_sets.rewritten_queries(reply, F.array(F.lit("market of BUILDING")), {"domestic": 3, "en": 3})
    found = rows.select("n_nationkey", lists.alias("q"))
    return found.select("n_nationkey", F.concat_ws("|", "q.domestic").alias("domestic"), F.concat_ws("|", "q.en").alias("en"))


@query(r"""SELECT c_custkey, '| 항목 | 내용 |' || chr(10) || '|---|---|' || chr(10) || '| Name | ' || c_name || '\|' || c_nationkey || ' |' || chr(10) || '| Segment | ' || CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '-' END || ' |' AS markdown FROM customer""")
def basic_info_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as Markdown tables."""
    name = F.concat_ws("|", "c_name", "c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", briefs.table({"Name": name, "Segment": F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise(" ")}).alias("markdown"))
