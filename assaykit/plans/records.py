"""Joins, merges, integrity and record shapes over the star-schema tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import aggregates, constraints, dedupe, filters, matching, nested, ranking
from ..sources.tables import table
from .registry import query


@query("""SELECT r_name, n_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 1) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY r_name, n_name, o_orderpriority""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").where("l_shipdate >= TIMESTAMP '1997-01-01'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))
    rows = lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("price"), 1).alias("revenue"))


@query("""SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate >= TIMESTAMP '1989-06-30' AND o_orderdate < TIMESTAMP '1999-06-30' AND o_orderstatus IN ('O', 'F') AND o_orderkey <> 7 ORDER BY o_orderkey LIMIT 50""")
def candidate_date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates at home, of a status, in the ten years before a date: the first 50, as the operator's limit has it."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("number", F.col("o_orderkey").cast("string"))
    found = filters.candidates(rows, seq="o_orderkey", number="number", country="c_mktsegment", date="o_orderdate", filed=F.lit("1999-06-30").cast("timestamp"), home="BUILDING", own=F.lit("7"), status=("O", "F"), state="o_orderstatus")
    return found.select("o_orderkey", "o_custkey", "c_mktsegment")


_FAMILY = "upper(regexp_replace(regexp_extract(p_name, '^([^ ]*)', 1), '\\s+', '', 'g'))"


@query(f"""WITH t AS (SELECT p_type, {_FAMILY} AS family, p_brand FROM part WHERE p_partkey = 1),
s AS (SELECT p.p_partkey, p.p_type = t.p_type AS a, {_FAMILY.replace('p_name', 'p.p_name')} = t.family AS b, p.p_brand = t.p_brand AS c FROM part p, t WHERE p.p_partkey <> 1)
SELECT p_partkey, CAST(CASE WHEN a THEN 0 WHEN b THEN 1 ELSE 2 END AS INTEGER) AS priority, concat_ws(',', CASE WHEN a THEN 'same_product' END, CASE WHEN b THEN 'same_family' END, CASE WHEN c THEN 'same_management' END) AS reasons
FROM s WHERE a OR b OR c ORDER BY priority, p_partkey LIMIT 10""")
def sibling_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest relatives of one record, with the reasons in order."""
    rows = table(spark, sf_dir, "part").withColumn("family", F.upper(F.regexp_replace(F.regexp_extract("p_name", "^([^ ]*)", 1), r"\s+", "")))
    own = rows.where("p_partkey = 1").select("p_partkey", "p_type", "family", "p_brand").first()
    found = matching.siblings_of(rows, own.asDict() if own else {"p_partkey": 1}, key="p_partkey", product="p_type", family="family", management="p_brand")
    return found.select("p_partkey", "priority", F.concat_ws(",", "reasons").alias("reasons"))


@query("""SELECT o_custkey, coalesce(a.c_name, b.c_name, c.c_name) AS value, CASE WHEN a.c_name IS NOT NULL THEN 'building' WHEN b.c_name IS NOT NULL THEN 'machinery' WHEN c.c_name IS NOT NULL THEN 'in_credit' ELSE 'unresolved' END AS found_in
FROM (SELECT DISTINCT o_custkey FROM orders) o LEFT JOIN customer a ON o_custkey = a.c_custkey AND a.c_mktsegment = 'BUILDING' LEFT JOIN customer b ON o_custkey = b.c_custkey AND b.c_mktsegment = 'MACHINERY' LEFT JOIN customer c ON o_custkey = c.c_custkey AND c.c_acctbal > 0""")
def lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ordering customer's name from the first of three sources that knows it."""
    known = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    sources = [("building", known.where("c_mktsegment = 'BUILDING'")), ("machinery", known.where("c_mktsegment = 'MACHINERY'")), ("in_credit", known.where("c_acctbal > 0"))]
    return matching.cascade(table(spark, sf_dir, "orders").select("o_custkey").distinct(), "o_custkey", sources, "c_name")


@query("""SELECT coalesce(n.k, c.c_custkey) AS c_custkey, coalesce(n.top, c.c_acctbal) AS c_acctbal, CASE WHEN c.c_custkey IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'kept' ELSE 'updated' END AS status
FROM (SELECT * FROM customer WHERE c_acctbal > 0) c FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) n ON c.c_custkey = n.k""")
def keyed_merge_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert: what new rows do to the known ones."""
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return dedupe.merge_keyed(table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal"), new, "c_custkey", ["c_acctbal"])


_CITED = "SELECT l_orderkey AS patent, l_linenumber AS seq, CAST(l_suppkey AS VARCHAR) AS original, l_returnflag AS country, CAST(l_suppkey % 50 AS VARCHAR) AS number, l_returnflag AS kind, l_linestatus = 'F' AS standard, l_returnflag AS type FROM lineitem"


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as citations of documents by orders."""
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS patent", "l_linenumber AS seq", "CAST(l_suppkey AS STRING) AS original", "l_returnflag AS country", "CAST(l_suppkey % 50 AS STRING) AS number", "l_returnflag AS kind", "l_linestatus = 'F' AS standard", "l_returnflag AS type")


@query(f"""WITH c AS ({_CITED}), s AS (SELECT patent, original, min(ROW(seq, concat_ws('|', country, number, kind))) AS s FROM c WHERE standard GROUP BY patent, original),
k AS (SELECT c.*, CASE WHEN standard THEN concat_ws('|', country, number, kind) ELSE coalesce(s.s[2], c.original) END AS key FROM c LEFT JOIN s ON c.patent = s.patent AND c.original = s.original),
t AS (SELECT patent, key, type, min(seq) AS o FROM k GROUP BY patent, key, type)
SELECT h.*, t.types FROM (SELECT patent, key, min(seq) AS seq, bool_or(standard) AS standard FROM k GROUP BY patent, key) h JOIN (SELECT patent, key, string_agg(type, ',' ORDER BY o, type) AS types FROM t GROUP BY patent, key) t ON h.patent = t.patent AND h.key = t.key""")
def citation_dedupe_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations merged by document, with the ordered union of their types."""
    return dedupe.citations(_cited(spark, sf_dir)).select("patent", "key", "seq", "standard", F.concat_ws(",", "types").alias("types"))


@query(f"SELECT patent, count(*) AS total, count(*) FILTER (standard) AS standardised, count(*) FILTER (NOT standard) AS other FROM ({_CITED}) GROUP BY patent")
def citation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.citation_stats(_cited(spark, sf_dir))


@query("""SELECT o_orderkey, display FROM (SELECT o_orderkey, o_orderstatus = 'F' AS standard, o_orderpriority AS kind, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS display,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'E0802' WHEN o_orderpriority = '2-HIGH' THEN 'E0801' ELSE 'E0899' END AS type FROM orders)
ORDER BY standard DESC, kind LIKE 'B%' DESC, CASE type WHEN 'E0802' THEN 0 WHEN 'E0801' THEN 1 ELSE 3 END, display""")
def citation_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All citations by standing, kind, type and number."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("standard"), F.col("o_orderpriority").alias("kind"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("display"), F.lit("x").alias("country"), F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "E0802").when(F.col("o_orderpriority") == "2-HIGH", "E0801").otherwise("E0899")).alias("types"))
    return rows.orderBy(*ranking.citation_order(rows, types="types", home="home")).select("o_orderkey", "display")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber AS n, l_returnflag = 'N' AS indep, l_linestatus = 'O' AND l_returnflag = 'A' AS gone FROM lineitem),
g AS (SELECT l_orderkey, list_sort(list_distinct(list(n) FILTER (NOT gone))) AS act, list_sort(list_distinct(list(n) FILTER (NOT gone AND indep))) AS ind, list_sort(list_distinct(list(n) FILTER (gone))) AS del, max(n) AS most FROM a GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(array_to_string(act, ','), '') AS active, coalesce(array_to_string(ind, ','), '') AS independent, coalesce(array_to_string(del, ','), '') AS deleted,
  coalesce(array_to_string(list_filter(range(1, most + 1), lambda x: NOT list_contains(coalesce(act, []), x)), ','), '') AS gaps FROM g""")
def claim_stats_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in use, independent, deleted and missing; lines of an order stand for claims."""
    rows = aggregates.claim_stats(table(spark, sf_dir, "lineitem"), by="l_orderkey", number="l_linenumber", independent=F.col("l_returnflag") == "N", deleted=(F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"))
    return rows.select("l_orderkey", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("active", "independent", "deleted", "gaps")))


@query("""SELECT o_orderpriority, string_agg(o_orderstatus, ',' ORDER BY o, o_orderstatus) AS states FROM (SELECT o_orderpriority, o_orderstatus, min(o_orderkey) AS o FROM orders GROUP BY 1, 2) GROUP BY o_orderpriority""")
def review_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's distinct values in the order in which they first come."""
    rows = dedupe.ordered_distinct(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", "o_orderkey", "states")
    return rows.select("o_orderpriority", F.concat_ws(",", "states").alias("states"))


@query("""SELECT l_partkey, string_agg(l_returnflag, ',' ORDER BY o, l_returnflag) AS users FROM (SELECT l_partkey, l_returnflag, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2) GROUP BY l_partkey""")
def evidence_axis_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inverted index: which axes use each item."""
    rows = matching.used_by(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag", "l_orderkey")
    return rows.select("l_partkey", F.concat_ws(",", "users").alias("users"))


_REFERENCES = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("documents", "doc_id", "labels", "doc_id"), ("customer", "c_custkey", "orders", "o_custkey"))


@query(" UNION ALL ".join(f"SELECT DISTINCT '{c}.{k}' AS reference, CAST({k} AS VARCHAR) AS value FROM {c} WHERE {k} IS NOT NULL AND CAST({k} AS VARCHAR) NOT IN (SELECT CAST({r} AS VARCHAR) FROM {p} WHERE {r} IS NOT NULL)" for c, k, p, r in _REFERENCES))
def reference_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that point nowhere, for each pair of tables."""
    parts = [matching.missing_references(table(spark, sf_dir, c), k, table(spark, sf_dir, p), r, f"{c}.{k}") for c, k, p, r in _REFERENCES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""SELECT rule, CAST(l_orderkey AS VARCHAR) AS key, count(*) AS n FROM (
  SELECT 'discount_small' AS rule, l_orderkey FROM lineitem WHERE NOT coalesce(l_discount <= 0.09, false) UNION ALL
  SELECT 'quantity_fits', l_orderkey FROM lineitem WHERE NOT coalesce(l_quantity < 49, false)) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY rule, l_orderkey"))
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules in one pass."""
    rules = {"discount_small": (F.col("l_discount") <= 0.09, F.col("l_discount")), "quantity_fits": (F.col("l_quantity") < 49, F.col("l_quantity"))}
    return constraints.violations(table(spark, sf_dir, "lineitem"), "l_orderkey", rules).groupBy("rule", "key").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN text IS NULL OR trim(text) = '' THEN 'text' END, CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'lang' END, CASE WHEN quality IS NULL THEN 'quality' END) AS missing FROM documents LEFT JOIN labels USING (doc_id)""")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return constraints.required(rows, "doc_id", ["text", "lang", "quality"]).select("doc_id", F.concat_ws(",", "missing").alias("missing"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'reject' WHEN p_retailprice > 1000 THEN 'review' ELSE 'accept' END AS action FROM part")
def decision_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.precedence(table(spark, sf_dir, "part"), [("reject", F.col("p_size") > 40), ("review", F.col("p_retailprice") > 1000)], "accept").select("p_partkey", "action")


@query("""SELECT c.c_custkey, coalesce(nullif(trim(o.c_name), ''), c.c_name) AS c_name, coalesce(o.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c
LEFT JOIN (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_name ELSE ' ' END AS c_name, CASE WHEN s_acctbal > 5000 THEN s_acctbal END AS c_acctbal FROM supplier) o ON c.c_custkey = o.s_suppkey""")
def record_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of one source over another's, blanks and nulls left out."""
    over = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS c_custkey", "CASE WHEN s_acctbal > 0 THEN s_name ELSE ' ' END AS c_name", "CASE WHEN s_acctbal > 5000 THEN s_acctbal END AS c_acctbal")
    return nested.overlay(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), over, "c_custkey")


@query("SELECT n_name, CAST(count(s_suppkey) AS BIGINT) AS suppliers FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal BETWEEN 0 AND 5000 GROUP BY n_name")
def suppliers_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").where("s_acctbal BETWEEN 0 AND 5000")
    return table(spark, sf_dir, "nation").join(rows, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("SELECT p_partkey, upper(regexp_replace(p_brand, '[^0-9A-Za-z]', '', 'g')) AS document_key, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug FROM (SELECT *, regexp_replace(regexp_replace(p_name, '[^0-9A-Za-z가-힣.-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g') AS s FROM part)")
def normal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.document_key(F.col("p_brand")).alias("document_key"), text.slug(F.col("p_name")).alias("slug"))


#: Fixed so that results do not move with the clock.
REFERENCE_DAY = date(2001, 7, 31)


@query("SELECT o_orderstatus, count(*) FILTER (TIMESTAMP '2001-07-31' - o_orderdate > INTERVAL 1825 DAY) AS stale, count(*) AS n FROM orders GROUP BY o_orderstatus")
def stale_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import dates

    old = dates.older_than(F.col("o_orderdate"), F.lit(REFERENCE_DAY).cast("timestamp"), 1825)
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(old).alias("stale"), F.count("*").alias("n"))
