"""Each catalogue query against its SQL on DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from assaykit import plans
from assaykit.functions import text

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, small, name):
    df = plans.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.sql(plans.SQL[name])
    assert sorted(result.columns) == columns
    want = sorted(tuple(plain(v) for v in row) for row in result.select(*(f'"{c}"' for c in columns)).fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_other_queries_run(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0


def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").collect()


def test_document_indicators_equal_regular_expressions(spark, small):
    import re

    from assaykit.config import DOCUMENT_INDICATORS

    got = {r["doc_id"]: r.asDict() for r in plans.QUERIES["document_indicators"](spark, small).collect()}
    for d in documents(spark, small):
        assert got[d["doc_id"]] == {"doc_id": d["doc_id"]} | {n: len(re.findall(p, d["text"] or "", re.I)) for n, p in DOCUMENT_INDICATORS.items()}


def test_document_sections_equal_a_plain_walk(spark, small):
    import re

    want = []
    for d in documents(spark, small):
        parts, at = [[None, []]], 0
        for line in re.split(r"\r\n|\r|\n", d["text"] or ""):
            if re.search("^#{1,6}[ \t]+", line) or (3 <= len(line) <= 60 and line.upper() == line):
                parts.append([line, []])
            else:
                parts[-1][1].append(line)
        for at, (heading, lines) in enumerate(parts):
            body = "\n".join(lines).strip(" ")
            if at or body:
                want.append((d["doc_id"], at, heading, len(body)))
    got = [(r["doc_id"], r["section_no"], r["heading"], r["chars"]) for r in plans.QUERIES["document_sections"](spark, small).collect()]
    assert sorted(got, key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_evidence_is_compressed_row_by_row(spark, small):
    import json
    import re

    from assaykit.operators import model

    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    want = {}
    for d in documents(spark, small):
        label, score = labels.get(d["doc_id"]), d["n_chars"] / 4000 if d["n_chars"] is not None else None
        kind = None if not label else "competitor_patent" if label["toxic"] == 1 else {1: "news", 0: "industry_report"}.get(label["quality"])
        route = "candidate" if kind == "news" or (kind == "industry_report" and (score is None or score >= 0.5)) else "passthrough" if kind == "competitor_patent" else "non_target"
        if route == "candidate":
            reply = json.loads(model.stub(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", d["text"] or "")[:6_000]))
            if reply["is_relevant"]:
                want[d["doc_id"]] = (route, "ok", reply["summary"])
        else:
            want[d["doc_id"]] = (route, route, d["text"] and d["text"][:600])
    got = {r["doc_id"]: (r["route"], r["status"], r["summary"]) for r in plans.QUERIES["evidence_compressed"](spark, small).collect()}
    assert got == want


def test_hashed_embeddings_equal_plain_ones(spark, small):
    import re

    import xxhash

    got = {(r["conv_id"], r["turn"]): (r["dims"], r["length"]) for r in plans.QUERIES["hashing_embed"](spark, small).collect()}
    rows = spark.read.parquet(f"{small}/conversations.parquet").collect()
    vectors = {(r["conv_id"], r["turn"]): r["embedding"] for r in __import__("assaykit.operators.model", fromlist=["embed"]).embed(spark.read.parquet(f"{small}/conversations.parquet"), "text", dims=64).collect()}
    for r in rows:
        v = [0.0] * 64
        for t in [t for t in re.split("[\\s\u00a0\u3000]+", (r["text"] or "").lower()) if t]:
            h = xxhash.xxh64(t.encode(), seed=42).intdigest()
            signed = h - (1 << 64) if h >> 63 else h
            v[(signed >> 1) % 64] += 1 if signed % 2 else -1
        n = math.sqrt(sum(x * x for x in v))
        key = (r["conv_id"], r["turn"])
        assert got[key] == (64, 1.0 if n else 0.0)
        assert all(abs(a - (b / n if n else b)) < 1e-9 for a, b in zip(vectors[key], v, strict=True))


def test_pages_are_read_like_plain_ones(spark, small):
    """Titles and paragraphs against a plain cut of the pages' markup, which is flat."""
    import hashlib
    import html
    import re

    got = {r["page_id"]: r for r in plans.QUERIES["html_title_text"](spark, small).collect()}
    for p in spark.read.parquet(f"{small}/pages.parquet").collect():
        body = re.sub(r"(?s)<(script|style|nav|footer|header|svg|noscript)\b.*?</\1>|<!--.*?-->", "", p["html"])
        title = " ".join(html.unescape(re.search("(?s)<title>(.*?)</title>", p["html"])[1]).split())
        parts = re.findall(r"(?s)<(?:p|h1|h2|h3|li)\b[^>]*>(.*?)(?=<(?:p|h1|h2|h3|li)\b|</(?:p|h1|h2|h3|li|ul|ol|body|html)>|\Z)", body)
        texts = list(dict.fromkeys(t for t in (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in parts) if len(t) >= 20))
        heads = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.findall("(?s)<h1>(.*?)</h1>", body)]
        r = got[p["page_id"]]
        assert r["title"] == (heads[0] if heads and heads[0] else title)
        assert (r["paragraphs"], r["text_sha256"]) == (len(texts), hashlib.sha256("\n".join(texts).encode()).hexdigest())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_indicators_of_cjk_texts(spark, tmp_path):
    import re

    from assaykit.config import DOCUMENT_INDICATORS

    texts = ["실시 형태와 도면 3, 수학식; 임계값 데이터 구조, 입력과 출력; 조건 분기, 제어 상태, S12 단계", "実施例 図 4 式 2 閾値 入力 条件 制御 ステップ", "附图 5 公式 参数 输入 分支 反馈 步骤", "Example: fig. 7, equation, weight, table, INPUT; if we loop, step 3, S100", "if는 xif whenの when 図１２ S３４", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r.asDict() for r in plans.QUERIES["document_indicators"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        assert rows[i] == {"doc_id": i} | {n: len(re.findall(p, t or "", re.I)) for n, p in DOCUMENT_INDICATORS.items()}
    assert all(rows[0][n] for n in DOCUMENT_INDICATORS)


def test_industry_hits_lower_a_text_once(spark, small):
    import re

    df = plans.QUERIES["industry_match"](spark, small)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    said = [("Battery, LITHIUM-ess 5g",), ("batterybattery",), ("x-battery",), ("리튬lithium",), (None,)]
    words = ("battery", "lithium", "ess", "5g", "리튬")
    want = [sum(w in (t or "").lower() if w == "리튬" else bool(re.search(f"(^|[^0-9a-z]){w}($|[^0-9a-z])", (t or "").lower())) for w in words) for (t,) in said]
    assert [r[0] for r in spark.createDataFrame(said, "t string").select(text.word_hits(F.col("t"), words)).collect()] == want


def test_report_chunks_clean_a_section_once(spark, small):
    plan = plans.QUERIES["report_chunks"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("removed_tables") == 2  # of sections, then of chunks


def test_claims_and_covers_are_computed_once_and_only_what_is_selected(spark, small):
    plan = lambda name: plans.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "特開" not in plan("cover_page_fields")  # prior art is not selected
    for name in ("korean_claim_rows", "foreign_claim_rows"):
        assert ", true, [c#" in plan(name)  # an outer generator, of which no filter on its size is inferred


def test_indicators_say_how_they_begin(spark, small):
    import re

    from assaykit.config import DOCUMENT_INDICATORS, INDICATOR_STARTS

    assert set(INDICATOR_STARTS) == set(DOCUMENT_INDICATORS)
    for name, pattern in DOCUMENT_INDICATORS.items():
        heads = re.split(r"\|", pattern)
        assert {re.sub(r"^(?:\\b|\(\?:)+", "", h)[0].lower() for h in heads} <= set(INDICATOR_STARTS[name])
    assert plans.QUERIES["document_indicators"](spark, small)._jdf.queryExecution().optimizedPlan().toString().count("(?=[") == len(DOCUMENT_INDICATORS)
