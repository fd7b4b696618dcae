"""Vectors, windows, growth, scores and grades."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Valuation
from ..functions import scores, text
from ..operators import aggregates, growth, matching, model, neighbours, ranking
from ..sources.tables import table
from ..streaming import state
from .registry import query

_COS = "round(coalesce(list_dot_product(e.v, q.v) / nullif(sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v)), 0), 0), 4)"
_VECTORS = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@query(f"WITH {_VECTORS} SELECT e.vec_id, e.label, {_COS} AS similarity FROM e, (SELECT v FROM e WHERE vec_id = 0) q ORDER BY similarity DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows nearest to one vector: a top-k report."""
    return ranking.top_cosine(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), vector="embedding", key="vec_id", k=10).select("vec_id", "label", "similarity")


@query(f"WITH {_VECTORS} SELECT e.vec_id, e.label, {_COS} AS similarity FROM e, (SELECT v FROM e WHERE vec_id = 0) q WHERE e.label IN (1, 3) ORDER BY similarity DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_cosine(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), vector="embedding", key="vec_id", k=10, where=F.col("label").isin(1, 3)).select("vec_id", "label", "similarity")


@query(f"""WITH {_VECTORS} SELECT q.vec_id AS query, e.vec_id AS match, {_COS} AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS INTEGER) AS rank
FROM e JOIN e q ON e.label = q.label WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id QUALIFY rank <= 3""")
def vector_rank_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest of each query vector in its own class; queries are the ids divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 20 = 0"), vector="embedding", key="vec_id", by="label", k=3)


@query()
def hashing_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature hashing of each conversation turn: the hash is Spark's own, so SQL has no twin."""
    rows = model.embed(table(spark, sf_dir, "conversations"), "text", dims=64)
    return rows.select("conv_id", "turn", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))


_SPANS = growth.windows(date(2001, 7, 31))
_COUNTS = ", ".join(f"count(DISTINCT o_custkey) FILTER (CAST(o_orderdate AS DATE) BETWEEN DATE '{a}' AND DATE '{b}') AS c{i}" for i, a, b in _SPANS)
_CAGR = "CASE WHEN reason IS NULL THEN round(pow(c3 * 1.0 / c1, 0.5) - 1, 6) END"


@query(f"""WITH c AS (SELECT o_orderpriority, o_orderstatus, {_COUNTS} FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '{_SPANS[0][1]}' AND DATE '{_SPANS[-1][2]}' GROUP BY o_orderpriority, o_orderstatus),
r AS (SELECT *, CASE WHEN c1 = 0 AND c2 = 0 AND c3 = 0 THEN 'inactive_or_reclassified' WHEN c1 <= 0 THEN 'cagr_start_count_zero' END AS reason FROM c),
g AS (SELECT *, {_CAGR} AS cagr FROM r)
SELECT *, CAST(CASE WHEN reason IS NULL THEN CASE WHEN cagr >= 0.15 THEN 10 WHEN cagr >= 0.08 THEN 8 WHEN cagr >= 0.03 THEN 6 WHEN cagr >= 0 THEN 4 ELSE 0 END END AS INTEGER) AS cagr_points,
  CAST(CASE WHEN reason IS NULL THEN CASE WHEN c1 < c2 AND c2 < c3 THEN 10 WHEN c1 > c2 AND c2 > c3 THEN 0 WHEN c1 < c2 OR c2 < c3 THEN 5 ELSE 0 END END AS INTEGER) AS trend_points FROM g""")
def window_counts_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customers in three consecutive years, with growth rate, its points and the trend's."""
    counts = growth.window_counts(table(spark, sf_dir, "orders"), "o_orderdate", "o_custkey", _SPANS, ["o_orderpriority", "o_orderstatus"])
    return growth.growth(counts).drop("growth_points")


_SHIPS = ", ".join(f"count(DISTINCT l_orderkey) FILTER (CAST(l_shipdate AS DATE) BETWEEN DATE '{a}' AND DATE '{b}') AS c{i}" for i, a, b in _SPANS)


@query(f"""SELECT l_returnflag, l_linestatus, CASE WHEN c1 < c2 AND c2 < c3 THEN 'rising' WHEN c1 > c2 AND c2 > c3 THEN 'falling' ELSE 'mixed' END AS trend FROM (
  SELECT l_returnflag, l_linestatus, {_SHIPS} FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '{_SPANS[0][1]}' AND DATE '{_SPANS[-1][2]}' GROUP BY l_returnflag, l_linestatus)""")
def trend_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = growth.window_counts(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_orderkey", _SPANS, ["l_returnflag", "l_linestatus"])
    points = scores.trend_points(F.col("c1"), F.col("c2"), F.col("c3"))
    return rows.select("l_returnflag", "l_linestatus", F.when(points == 10, "rising").when((F.col("c1") > F.col("c2")) & (F.col("c2") > F.col("c3")), "falling").otherwise("mixed").alias("trend"))


_V = Valuation()
_AXES = {"legal": "c_custkey * 7 % 101", "technology": "c_custkey * 13 % 101", "market": "c_custkey * 29 % 101", "business_fit": "c_custkey * 31 % 101"}
_MEAN = f"round((legal * {_V.weights['legal']!r}::DOUBLE + technology * {_V.weights['technology']!r}::DOUBLE + market * {_V.weights['market']!r}::DOUBLE) / 100.0::DOUBLE, 1)"


@query(f"""WITH s AS (SELECT c_custkey, {', '.join(f'CAST({e} AS INTEGER) AS {a}' for a, e in _AXES.items())} FROM customer), m AS (SELECT *, legal + technology + market AS total, {_MEAN} AS mean FROM s),
g AS (SELECT *, CASE WHEN mean >= 70 THEN 'A' WHEN mean >= 50 THEN 'B' ELSE 'C' END AS grade FROM m)
SELECT c_custkey, CAST(total AS BIGINT) AS total, mean, grade, business_fit >= 60 AND grade <> 'A' AS overridden,
  CASE WHEN business_fit >= 60 OR grade = 'A' THEN 'keep' WHEN grade = 'B' THEN 'conditional' ELSE 'drop' END AS recommendation FROM g""")
def axis_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long axis scores to totals, weighted means, grades and recommendations; scores follow from customers' keys."""
    axes = F.array(*(F.struct(F.lit(a).alias("axis"), F.expr(f"CAST({e} AS INT)").alias("score")) for a, e in _AXES.items()))
    long = table(spark, sf_dir, "customer").select("c_custkey", F.explode(axes).alias("x")).select("c_custkey", "x.*")
    out = aggregates.valuation(long, by="c_custkey")
    return out.select("c_custkey", F.col("total").cast("long").alias("total"), "mean", "grade", "overridden", "recommendation")


@query("""WITH long AS (SELECT c_custkey, unnest([0, 1, 2]) AS rank, unnest(['legal', 'technology', 'market']) AS axis, unnest([c_custkey * 7 % 101, c_custkey * 13 % 101, c_custkey * 29 % 101]) AS score FROM customer)
SELECT c_custkey, first(axis ORDER BY score DESC, rank) AS strongest, first(axis ORDER BY score, rank) AS weakest FROM long GROUP BY c_custkey""")
def axis_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = list(_AXES)[:3]
    axes = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(a).alias("axis"), F.expr(_AXES[a]).alias("score")) for i, a in enumerate(names)))
    return aggregates.extremes(table(spark, sf_dir, "customer").select("c_custkey", F.explode(axes).alias("x")).select("c_custkey", "x.*"), by="c_custkey")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) AS n, count(*) OVER (PARTITION BY user_id, event_type) AS runs FROM events)
SELECT user_id, event_type, event_id, value, runs FROM r WHERE n = runs // 2 + 1""")
def ensemble_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group of runs the one at the upper median."""
    rows = aggregates.ensemble(table(spark, sf_dir, "events"), by=["user_id", "event_type"], score="value", seq="event_id", confidence="value")
    return rows.select("user_id", "event_type", "event_id", "value", "runs")


@query("""SELECT p_partkey, p_size, CAST(CASE WHEN p_size >= 25 THEN 30 WHEN p_size >= 15 THEN 20 WHEN p_size >= 5 THEN 10 ELSE 0 END AS INTEGER) AS snapped,
  CAST(round_even(p_size * 40 / 60.0::DOUBLE, 0) AS INTEGER) AS rescaled FROM part""")
def snap_and_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores snapped to the nearest allowed value (the larger of two as near), and rescaled in proportion."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", scores.snap(size, (0, 10, 20, 30)).cast("int").alias("snapped"), scores.rescale(size, 60.0, 40.0).alias("rescaled"))


@query("""SELECT count(*) FILTER (p AND q) AS scored, count(*) FILTER (NOT (p AND q)) AS errors, round(count(*) FILTER (p AND q AND long = quality) * 1.0 / count(*) FILTER (p AND q), 4)::DOUBLE AS length_rule,
  round(count(*) FILTER (p AND q AND toxic = 0) * 1.0 / count(*) FILTER (p AND q), 4)::DOUBLE AS never_toxic, round(count(*) FILTER (p AND q AND long = quality AND toxic = 0) * 1.0 / count(*) FILTER (p AND q), 4)::DOUBLE AS all_right
FROM (SELECT quality, toxic, CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END AS long, quality IS NOT NULL AS p, toxic IS NOT NULL AS q FROM documents LEFT JOIN labels USING (doc_id))""")
def label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two plain rules agree with the labels; documents without labels count as errors."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return aggregates.accuracy(rows, {"length_rule": (F.when(F.col("n_chars") >= 500, 1).otherwise(0), F.col("quality")), "never_toxic": (F.lit(0), F.col("toxic"))})


@query("SELECT event_type, user_id % 7 AS bucket, count(*) AS n, min(k) AS least, max(k) AS most FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY event_type, user_id % 7")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").withColumn("k", k).groupBy("event_type", (F.col("user_id") % 7).alias("bucket")).agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"))


@query("""SELECT event_id, recent, recent > 3 AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW) AS recent FROM events)""")
def rate_limit_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user in the half day before, and whether they are beyond the limit."""
    return state.sliding_limit(table(spark, sf_dir, "events"), key="user_id", at="ts", order="event_id", seconds=43_200, most=3).select("event_id", "recent", "limited")


@query("""SELECT user_id, event_id, event_type FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' AND ts > TIMESTAMP '2024-01-19 18:00:00' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 ORDER BY ts DESC, event_id DESC LIMIT 1024""")
def progress_latest_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event that has not expired; of more than 1,024 users the newest."""
    rows = state.latest(table(spark, sf_dir, "events"), key="user_id", at="ts", order="event_id", now=F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return rows.select("user_id", "event_id", "event_type")


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the streaming window counts."""
    return state.stream_window_counts(table(spark, sf_dir, "events"), key="event_type", at="ts").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("SELECT p_brand, CASE WHEN p_size BETWEEN 1 AND 15 THEN 'small' WHEN p_size BETWEEN 10 AND 30 THEN 'medium' WHEN p_size >= 31 THEN 'large' END AS band, count(*) AS n, round(avg(p_retailprice), 2) AS mean_price FROM part GROUP BY 1, 2")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of a small table of intervals, the first that fits; the last one is open."""
    rows = matching.intervals(table(spark, sf_dir, "part"), "p_size", [(1, 15, "small"), (10, 30, "medium"), (31, None, "large")], "band")
    return rows.groupBy("p_brand", "band").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 2).alias("mean_price"))


@query("SELECT coalesce(nullif(trim(lang), ''), 'unknown') AS lang, count(*) AS n FROM documents GROUP BY 1")
def counts_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.counts_by(table(spark, sf_dir, "documents"), "lang")


@query("""SELECT "column", string_agg(DISTINCT v, ',' ORDER BY v) AS labels FROM (SELECT 'p_brand' AS "column", p_brand AS v FROM part UNION ALL SELECT 'p_type', p_type FROM part) WHERE v NOT IN ('', 'etc') GROUP BY "column" """)
def taxonomy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..config import EXCLUDED_LABELS

    rows = aggregates.labels(table(spark, sf_dir, "part"), ["p_brand", "p_type"], EXCLUDED_LABELS)
    return rows.select("column", F.concat_ws(",", "labels").alias("labels"))


@query("SELECT doc_id, CAST(year AS INTEGER) AS year, digits FROM (SELECT doc_id, TRY_CAST(nullif(regexp_extract(coalesce(text, ''), '((?:19|20)[0-9]{2})', 1), '') AS INTEGER) AS year, length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) AS digits FROM documents)")
def years_and_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import dates

    return table(spark, sf_dir, "documents").select("doc_id", dates.year_of(F.col("text")).alias("year"), F.coalesce(F.length(text.digits(F.col("text"))), F.lit(0)).cast("long").alias("digits"))


@query("""SELECT user_id, event_id, attempt, CASE WHEN event_type <> 'error' THEN 'pass' WHEN attempt <= 1 THEN 'retry' ELSE 'fallback' END AS decision
FROM (SELECT *, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempt FROM events)""")
def retry_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import constraints

    return constraints.retry_limit(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "error").select("user_id", "event_id", "attempt", "decision")


