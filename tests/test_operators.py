"""Operators and functions on literal rows: ties, nulls, blanks and edges."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from assaykit.functions import dates, scores, text, vectors
from assaykit.operators import aggregates, constraints, dedupe, documents, filters, growth, matching, nested, positional, ranking
from assaykit.streaming import state


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# --- functions --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("given", "want"),
    [("https://Example.COM", "https://example.com/"), ("HTTP://a.b/C?q=1#f", "http://a.b/C?q=1"), ("ftp://a.b/", None), ("no url", None), (None, None)],
)
def test_url_normal(spark, given, want):
    assert one(spark, text.url_normal(F.lit(given).cast("string"))) == want


def test_keywords_leave_out_stop_words_numbers_and_repeats(spark):
    assert one(spark, text.keywords(F.lit("Motor 관련 motor 2024 전지 x"))) == ["motor", "전지"]
    assert one(spark, text.keywords(F.lit(None).cast("string"))) == []


def test_jaccard_of_empty_sets_is_zero(spark):
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0.0
    assert one(spark, text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == 0.3333


def test_json_object_cuts_text_around(spark):
    assert one(spark, text.json_object(F.lit('so: {"a": 1} end'))) == '{"a": 1}'
    assert one(spark, text.json_object(F.lit("{broken"))) is None
    assert one(spark, text.json_object(F.lit("{broken}"))) is None


def test_dates_never_fail(spark):
    assert one(spark, dates.compact_date(F.lit("20240229"))) == date(2024, 2, 29)
    assert one(spark, dates.compact_date(F.lit("20230229"))) is None
    assert one(spark, dates.any_date(F.lit("2024.3.1"))) == date(2024, 3, 1)
    assert one(spark, dates.iso(F.lit("yesterday"))) is None
    assert one(spark, dates.year_of(F.lit("in 1899 and 2011"))) == 2011
    assert one(spark, dates.older_than(F.lit(None).cast("timestamp"), F.current_timestamp(), 1)) is False


def test_snap_takes_the_larger_of_two_as_near(spark):
    assert one(spark, scores.snap(F.lit(5), (0, 10))) == 10
    assert one(spark, scores.snap(F.lit(4), (0, 10))) == 0
    assert one(spark, scores.snap(F.lit(None).cast("int"), (0, 10))) is None


def test_cosine_edges(spark):
    vector = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(spark, vectors.cosine(vector(1, 0), vector(0, 1))) == 0.0
    assert one(spark, vectors.cosine(vector(2, 0), vector(3, 0))) == 1.0
    assert one(spark, vectors.cosine(vector(0, 0), vector(1, 0))) == 0.0
    assert one(spark, vectors.cosine(vector(1), vector(1, 0))) == 0.0


# --- operators --------------------------------------------------------------------------------------------


def test_news_reports_the_first_rule_that_fails(spark):
    day = "2024-01-01T00:00:00+00:00"
    df = spark.createDataFrame(
        [(1, "u1", "motor", "", day, "news"), (2, "U1", "motor", "", day, "news"), (3, "u3", "motor", "", "2001-01-01T00:00:00+00:00", "news"), (4, "u4", "cake", "", None, "news"), (5, "u5", "cake", "", None, "domestic_news")],
        "seq int, url string, title string, content string, published_at string, source string",
    )
    got = filters.news(df, F.array(F.lit("motor")), F.lit("2024-06-01").cast("timestamp"))
    assert rows(got.select("seq", "reason"), "seq") == [(1, "passed"), (2, "duplicate"), (3, "too_old"), (4, "no_keyword_match"), (5, "passed")]


def test_route_at_and_below_the_threshold(spark):
    df = spark.createDataFrame([(1, "news", None), (2, "industry_report", 0.5), (3, "industry_report", 0.49), (4, "industry_report", None), (5, "competitor_patent", 1.0), (6, "other", 1.0)], "i int, source_type string, score double")
    assert [r for _, r in rows(filters.route(df).select("i", "route"), "i")] == ["candidate", "candidate", "non_target", "candidate", "passthrough", "non_target"]


def test_first_per_key_keeps_blank_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None)], "i int, k string")
    assert [i for i, _ in rows(dedupe.first_per_key(df, F.col("k"), "i", keep_blank=True), "i")] == [1, 3, 4]


def test_citations_join_their_standard_twin(spark):
    df = spark.createDataFrame(
        [(1, 1, "KR 1", None, None, None, False, "A"), (1, 2, "KR1", "KR", "1", "B1", True, "B"), (1, 3, "Some book", None, None, None, False, "A"), (1, 4, "", None, None, None, False, "A")],
        "patent int, seq int, original string, country string, number string, kind string, standard boolean, type string",
    )
    got = dedupe.citations(df).select("key", "seq", "standard", "types")
    assert rows(got, "seq") == [("KR|1|B1", 1, True, ["A", "B"]), ("SOMEBOOK", 3, False, ["A"])]


def test_merge_keyed_says_what_happened(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert rows(dedupe.merge_keyed(old, new, "k", ["v"]), "k") == [(1, "a", "kept"), (2, "b", "updated"), (3, "c", "inserted")]


def test_cascade_asks_in_order(spark):
    want = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert rows(matching.cascade(want, "k", [("a", a), ("b", b)], "v"), "k") == [(1, "a", "a"), (2, "b", "b"), (3, None, "unresolved")]


def test_interval_join_equals_the_plain_condition(spark):
    points = spark.range(40).select((F.col("id") * 1.5 - 7).alias("p"))
    spans = spark.createDataFrame([(1, -5.0, 3.0), (2, 3.0, 3.0), (3, 0.0, 45.0)], "s int, a double, b double")
    got = matching.interval_join(points, spans, point="p", start="a", end="b", width=4.0, how="inner").select("p", "s")
    want = [(p * 1.5 - 7, s) for p in range(40) for s, a, b in ((1, -5, 3), (2, 3, 3), (3, 0, 45)) if a <= p * 1.5 - 7 <= b]
    assert rows(got, "p", "s") == sorted(want)


def test_siblings_and_their_reasons(spark):
    df = spark.createDataFrame([(1, "p", "f", "m"), (2, "p", "f", "x"), (3, "", "f", "m"), (4, "q", "", "")], "id int, product string, family string, management string")
    got = matching.siblings(df, df.where("id = 1"), key="id", product="product", family="family", management="management")
    assert rows(got, "sibling") == [(1, 2, 0, ["same_product", "same_family"]), (1, 3, 1, ["same_family", "same_management"])]


def test_windows_end_at_month_ends():
    assert growth.shifted(date(2024, 2, 29), -12) == date(2023, 2, 28)
    assert growth.shifted(date(2024, 1, 31), 1) == date(2024, 2, 29)
    assert growth.windows(date(2024, 2, 29), n=2) == [(1, date(2022, 3, 1), date(2023, 2, 28)), (2, date(2023, 3, 1), date(2024, 2, 29))]


def test_growth_reasons(spark):
    df = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 1, 2), (3, 1, 2, 4), (4, None, 1, 1)], "i int, c1 long, c2 long, c3 long")
    got = rows(growth.growth(df).select("i", "reason", "cagr", "growth_points"), "i")
    assert got == [(1, "inactive_or_reclassified", None, None), (2, "cagr_start_count_zero", None, None), (3, None, 1.0, 20), (4, "window_counts_incomplete", None, None)]


def test_claim_stats_count_deleted_for_the_largest(spark):
    df = spark.createDataFrame([(1, 1, True, False), (1, 3, False, False), (1, 5, True, True)], "d int, n int, i boolean, x boolean")
    got = aggregates.claim_stats(df, by="d", number="n", independent=F.col("i"), deleted=F.col("x")).first()
    assert (got["active"], got["independent"], got["dependent"], got["deleted"], got["gaps"]) == ([1, 3], [1], [3], [5], [2, 4, 5])


def test_ensemble_takes_the_upper_median(spark):
    df = spark.createDataFrame([(1, 10, 0, 0.5), (1, 30, 1, 0.7), (2, 5, 0, 1.0)], "k int, score int, seq int, c double")
    got = aggregates.ensemble(df, by=["k"], score="score", seq="seq", confidence="c").select("k", "score", "runs", "mean_confidence")
    assert rows(got, "k") == [(1, 30, 2, 0.6), (2, 5, 1, 1.0)]


def test_chunks_overlap_and_end_with_the_text(spark):
    df = spark.createDataFrame([("a b c d e f g h",), ("x  y",), (None,)], "t string")
    got = documents.chunks(df, "t", size=5, overlap=2).select("t", "chunk_no", "chunk").collect()
    assert [(r["chunk_no"], r["chunk"]) for r in got if r["t"] == "a b c d e f g h"] == [(1, "a b c d e"), (2, "d e f g h")]
    assert [(r["chunk_no"], r["chunk"]) for r in got if r["t"] == "x  y"] == [(1, "x  y")]
    assert [(r["chunk_no"], r["chunk"]) for r in got if r["t"] is None] == [(1, None)]


def test_claims_dependency_and_deletion(spark):
    df = spark.createDataFrame([(1, "1. A device.\nwith parts\n2. The device of claim 1.\n3. [삭제]")], "d int, t string")
    got = documents.claims(df, "d", "t").select("claim_no", "text", "dependency", "is_deleted")
    assert rows(got, "claim_no") == [(1, "A device.\nwith parts", None, False), (2, "The device of claim 1.", 1, False), (3, "[삭제]", None, True)]


def test_html_leaves_out_navigation(spark):
    page = "<html><head><title>T</title></head><body><nav><p>a link that is long enough</p></nav><h1>Head</h1><p>a paragraph of some length</p><p>short</p></body></html>"
    got = documents.read_html(spark.createDataFrame([(page,), (None,)], "h string"), "h").orderBy(F.col("h").isNull()).collect()
    assert (got[0]["title"], got[0]["paragraphs"]) == ("Head", ["a paragraph of some length"])
    assert (got[1]["title"], got[1]["paragraphs"]) == (None, [])


def test_islands_runs_and_ranges(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, None), (1, 4, "a")], "k int, i int, v string")
    assert [r["island"] for r in positional.islands(df, ["k"], "i", F.col("v").isNotNull()).orderBy("i").collect()] == [1, 1, 1, 2]
    assert [r["run"] for r in positional.runs(df, ["k"], "i", ["v"]).orderBy("i").collect()] == [1, 2, 2, 3]
    assert rows(positional.ranges(df, ["k"], "i"), "start") == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, None)]


def test_overlay_ignores_blanks(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    over = spark.createDataFrame([(1, " ", 5)], "k int, s string, n int")
    assert rows(nested.overlay(base, over, "k"), "k") == [(1, "a", 5), (2, "b", 2)]


def test_violations_count_null_as_broken(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "k int, n int")
    assert rows(constraints.violations(df, "k", {"small": (F.col("n") < 10, F.col("n"))}), "key") == [("small", "2", None), ("small", "3", "50")]


def test_top_cosine_settles_ties_by_key(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, v array<double>")
    got = ranking.top_cosine(df, [2.0, 0.0], vector="v", key="id", k=2)
    assert [(r["id"], r["similarity"]) for r in got.collect()] == [(1, 1.0), (3, 1.0)]


# --- state ------------------------------------------------------------------------------------------------


def test_latest_drops_expired_keys(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    df = spark.createDataFrame([("a", t(1), 1, "x"), ("a", t(9), 2, "y"), ("b", t(2), 3, "z")], "k string, t timestamp, o int, v string")
    got = state.latest(df, key="k", at="t", order="o", now=F.lit(t(10)), ttl_hours=6)
    assert [(r["k"], r["v"]) for r in got.collect()] == [("a", "y")]


def test_sliding_limit_counts_the_last_seconds(spark):
    at = [0, 10, 59, 60, 61]
    df = spark.createDataFrame([(i, "a", s) for i, s in enumerate(at)], "i int, k string, s int").withColumn("t", F.timestamp_seconds("s"))
    got = state.sliding_limit(df, key="k", at="t", order="i", seconds=60, most=3)
    assert [r["recent"] for r in got.orderBy("i").collect()] == [1, 2, 3, 3, 4]
    assert [r["limited"] for r in got.orderBy("i").collect()] == [False, False, False, False, True]
