"""Evidence sets, briefs and the vector store against fixtures."""

from __future__ import annotations

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from assaykit import plans
from assaykit.functions import vectors
from assaykit.operators import briefs, evidence_sets, walks
from assaykit.sources import vector_store
from assaykit.sources.vector_store import VectorStore


def hashed(texts):
    return vectors.hashed(vector_store.embedding_tokens(texts), 64)


# --- the vector store -------------------------------------------------------------------------------


def test_embedding_tokens_and_literals(spark):
    texts = ["AI 기반 반도체 a 12x", "가나", "가 나 다라", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(vector_store.embedding_tokens(F.col("t"))).collect()]

    def plain(t):
        low = re.sub(r"\s+", " ", (t or "").lower()).strip()
        hangul = "".join(re.findall("[가-힣]", low))
        return re.findall("[0-9a-zA-Z가-힣]{2,}", low) + [hangul[i : i + 3] for i in range(max(0, len(hangul) - 2))]

    assert got == [plain(t) for t in texts]
    row = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([1.0, 1.0],)], "v array<double>").select(vector_store.literal(F.col("v"))).collect()
    assert [json.loads(r[0]) for r in row] == [[0.6, 0.8], [0, 0], [0.7071067812, 0.7071067812]]


def test_store_is_built_upserted_and_searched(spark, tmp_path):
    lines = [{"chunk_id": f"c{i}", "text": t, "metadata": {"industry": "AI" if i % 2 else "반도체", "heading": f"h{i}", "source_name": "s.pdf", "published_year": "2025"}} for i, t in enumerate(["neural networks learn", "chips are etched", "learning machines", "wafer and chips"])]
    (tmp_path / "chunks.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n", encoding="utf-8")
    store = VectorStore(spark, str(tmp_path / "store"), hashed, "hash-64")
    assert store.build(str(tmp_path / "chunks.jsonl"), "v1") == 4
    query = spark.createDataFrame([("chips wafer",)], "t string").select(hashed(F.col("t"))).first()[0]

    def plain(rows, k, keep=lambda r: True):
        cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))
        return [r["chunk_id"] for r in sorted((r for r in rows if keep(r)), key=lambda r: (-cos(r["embedding"], query), r["chunk_id"]))[:k]]

    rows = store.rows().collect()
    names = lambda df: [r["chunk_id"] for r in df.collect()]
    assert names(store.search(query, k=3)) == plain(rows, 3)
    assert names(store.search(query, industry="AI")) == plain(rows, 5, lambda r: r["industry"] == "AI") and names(store.search(query, industries=["AI", "반도체"], industry="none", k=1)) == plain(rows, 1)
    assert names(store.search(query, industries=[])) == [] and names(store.search(query, source_name="other")) == []
    hit = vector_store.as_evidence(store.search(query, k=1)).first()
    assert hit["published_at"] == "2025" and hit["title"].startswith("s.pdf - h") and hit["source_type"] == "industry_report"
    metadata = json.loads(next(r["metadata"] for r in rows if r["chunk_id"] == "c1"))
    assert metadata["chunk_id"] == "c1" and metadata["embedding_model"] == "hash-64"
    more = spark.createDataFrame([("c1", "quite another text", {"industry": "AI"}), ("c9", "new", None), ("c9", "later of the same id", None), (None, "no id", None)], vector_store.CHUNKS)
    assert store.upsert(more, "v2") == 2
    assert {r["chunk_id"]: r["text"] for r in store.rows().collect()} == {"c0": "neural networks learn", "c1": "quite another text", "c2": "learning machines", "c3": "wafer and chips", "c9": "later of the same id"}
    assert store.upsert(more.limit(0), "v3") == 0 and store.rows().count() == 5


def test_vectors_must_fit(spark):
    rows = lambda *vs: spark.createDataFrame([(v,) for v in vs], "embedding array<double>")
    assert vector_store.dimension(rows([1.0, 2.0], [0.0, 0.0])) == 2
    for bad in (rows(), rows([]), rows([1.0], [1.0, 2.0]), rows([1.0], None)):
        with pytest.raises(ValueError):
            vector_store.dimension(bad)


# --- evidence sets ----------------------------------------------------------------------------------


def test_samples_identifiers_and_counts(spark):
    rows = spark.createDataFrame([("t", i, i in (4, 7), None if i == 2 else f" x{i % 3} ", "y" if i else None) for i in range(9)] + [("u", 0, None, "", None)], "target string, o int, cited boolean, a string, b string")
    got = evidence_sets.samples(rows, "target", "o", F.col("cited"), most=3).orderBy("target", "place").collect()
    assert [(r["target"], r["o"]) for r in got] == [("t", 4), ("t", 7), ("t", 0), ("t", 1), ("t", 2), ("u", 0)]
    assert {r["target"]: r["identifiers"] for r in evidence_sets.identifiers(rows, "target", "o", ["a", "b"]).collect()} == {"t": ["x0", "x1", "y", "x2"]}
    counts = {r["target"]: (r["found"], r["good"], r["ids"]) for r in evidence_sets.quality_counts(rows, "target", "o", F.col("b") == "y", F.col("o") > 6).collect()}
    assert counts == {"t": (8, 2, [7, 8]), "u": (0, 0, [])}
    judged = spark.createDataFrame([("s", "passed"), ("s", "old"), ("s", "old"), ("s", "double"), ("r", "passed")], "source string, reason string")
    stats = {r["source"]: (r["input_count"], r["kept_count"], r["rejected_count"], [tuple(x) for x in r["rejected"]]) for r in evidence_sets.filter_stats(judged, "source").collect()}
    assert stats == {"s": (4, 1, 3, [("double", 1), ("old", 2)]), "r": (1, 1, 0, [])}
    said = spark.createDataFrame([(["a", " ", "b"], ["b", "c"], False), (None, ["x"], True), (None, None, None)], "p array<string>, q array<string>, e boolean")
    assert [r[0] for r in said.select(evidence_sets.warnings([F.col("p"), F.col("q")], F.col("e"))).collect()] == [["a", "b", "c"], ["x", "evidence_bundle_empty"], ["evidence_bundle_empty"]]
    assert evidence_sets.either(None, judged, judged.limit(1)).count() == 6


@pytest.mark.parametrize(
    "reply,want",
    [
        ('{"domestic": ["a  b", "a b", "", 3, "old"], "en": []}', (["a b", "3"], [])), ('text {"domestic": {"x": ["p"], "y": "no", "z": ["q", "p"]}, "en": null} more', (["p", "q"], [])), ('["not an object"]', ([], [])), ("{broken", ([], [])), (None, ([], [])), ("", ([], [])),
    ],
)
def test_replies_become_lists(spark, reply, want):
    row = spark.createDataFrame([(reply,)], "r string").select(evidence_sets.rewritten_queries(F.col("r"), F.array(F.lit("old")), {"domestic": 3, "en": 2}).alias("q")).first()["q"]
    assert (row["domestic"], row["en"]) == want


# --- briefs -----------------------------------------------------------------------------------------


def test_briefs_are_checked_and_laid_out(spark):
    good = (" one\n line ", "p", "c", ["a", " ", "b ", "c", "d", "e", "f", "g"], ["1", "2", "3"], "e")
    rows = spark.createDataFrame([(1, good), (2, ("x", "", "c", ["a", "b"], ["1", "2", "3"], None)), (3, None)], f"id int, raw {briefs.BRIEF}").withColumn("b", briefs.brief(F.col("raw")))
    got = {r["id"]: r for r in rows.select("id", briefs.missing(F.col("b")).alias("missing"), briefs.markdown(F.col("b")).alias("text")).collect()}
    assert got[1]["missing"] == [] and got[2]["missing"] == ["problem", "key_components", "expected_effect"] and got[2]["text"] is None and len(got[3]["missing"]) == 6
    assert got[1]["text"] == "# 특허 이해 요약\n\n## 한 줄 요약\n\none line\n\n## 해결하려는 문제\n\np\n\n## 핵심 아이디어\n\nc\n\n## 주요 기술/구성\n\n- a\n- b\n- c\n- d\n- e\n- f\n\n## 작동 방식 3단계\n\n1. 1\n2. 2\n3. 3\n\n## 기대 효과\n\ne"
    table = spark.createDataFrame([("x|y\nz", None)], "a string, b string").select(briefs.table({"A": F.col("a"), "B": F.col("b")})).first()[0]
    assert table == "| 항목 | 내용 |\n|---|---|\n| A | x\\|y z |\n| B | - |"


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_summary_briefs_read_a_reply_once(spark, small):
    assert plans.QUERIES["summary_briefs"](spark, small)._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_identifiers_are_dealt_once(spark, small):
    assert planned(plans.QUERIES["reference_identifiers"](spark, small)).count("Exchange hashpartitioning") == 1


def test_identifiers_of_rows_with_one_order(spark):
    rows = spark.createDataFrame([("t", 1, "b", "a"), ("t", 1, "a", "c"), ("t", 0, "c", " "), (None, 2, "x", None), ("u", 3, None, "")], "t string, o int, f string, g string")
    got = {r["t"]: r["identifiers"] for r in evidence_sets.identifiers(rows, "t", "o", ["f", "g"]).collect()}
    assert got == {"t": ["c", "a", "b"], None: ["x"]}
    assert {r["t"]: r["identifiers"] for r in evidence_sets.identifiers(rows, "t", "f", ["f", "t"]).collect()} == {"t": ["a", "t", "b", "c"], None: ["x"], "u": ["u"]}


def test_a_walk_deals_its_candidates_by_group_and_by_key_once(spark, small):
    assert planned(plans.QUERIES["prior_art_walk"](spark, small)).count("Exchange hashpartitioning") <= 4  # by group, by key, what is known, by group


def test_a_walk_with_null_keys_and_no_sources(spark):
    rows = spark.createDataFrame([(1, None, 1), (1, "a", 2), (1, "b", 3), (1, "c", 4), (2, None, 1)], "g int, k string, place int")
    first = spark.createDataFrame([("b", " "), ("a", "y"), ("a", "x"), (None, "z")], "k string, text string")
    second = spark.createDataFrame([("b", "w"), ("a", "v"), ("c", "u")], "k string, text string")
    walk = lambda sources: sorted((r["g"], r["place"], r["text"], r["found_in"], list(r["tried"])) for r in walks.until_enough(rows, "g", "k", sources, goal=2).collect())
    assert walk([("one", first), ("two", second)]) == [(1, 1, None, None, ["one", "two"]), (1, 2, "x", "one", ["one"]), (1, 3, "w", "two", ["one", "two"]), (1, 4, None, None, ["one"]), (2, 1, None, None, ["one", "two"])]
    assert [r[2:] for r in walk([])] == [(None, None, [])] * 5
