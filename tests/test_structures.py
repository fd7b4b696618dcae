"""Boxes on pages, walks, nested documents, archive pages, merged structures, caches, entities, rework, neighbours."""

from __future__ import annotations

import json
import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assaykit.functions import reports as report_texts
from assaykit.functions.arrays import runs, scan
from assaykit.operators import archive_pages, boxes, hybrid, identity, linkage, model, neighbours, reports, rework, structures, structuring, trees, walks
from assaykit.sources.cache import ResultCache, content_key


# --- arrays ---------------------------------------------------------------------------------------


def test_scan_and_runs_over_blocks(spark):
    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 3, 4, 5, 23)], "xs array<int>")
    got = rows.select("xs", scan(F.col("xs"), F.lit(0), "int", lambda s, x: s + x, block=4).alias("sums"), runs(F.col("xs"), lambda xs, i: F.get(xs, i) % 3 == 0).alias("runs")).collect()
    for r in got:
        assert r["sums"] == np.cumsum(r["xs"]).tolist()
        assert [x for part in r["runs"] for x in part] == r["xs"] and all(part[0] % 3 == 0 for part in r["runs"])
    assert spark.createDataFrame([(None,)], "xs array<int>").select(scan(F.col("xs"), F.lit(0), "int", lambda s, x: s + x)).first()[0] in (None, [])


def test_sections_of_many_headings_are_linear(spark):
    text = "\n".join(f"{i % 9 + 1}. Heading {i}\nbody of {i}" for i in range(20_000))
    df = spark.createDataFrame([("r", text)], "id string, text string")
    began = time.perf_counter()
    n = reports.sections(df, "id", "text").count()
    assert n > 0 and time.perf_counter() - began < 20


# --- boxes ----------------------------------------------------------------------------------------


def plain_page(words, apart=3.0):
    lines = []
    for w in sorted(words, key=lambda w: (round(w[2]), w[0])):
        if lines and abs(w[2] - lines[-1][0][2]) <= apart:
            lines[-1].append(w)
        else:
            lines.append([w])
    return "\n".join(" ".join(w[4] for w in sorted(line, key=lambda w: w[0])) for line in lines)


def test_words_outside_boxes_of_any_size(spark):
    r = random.Random(4)
    words = [(p, x := r.uniform(-50, 600), x + r.uniform(1, 60), t := r.uniform(0, 800), t + 10, f"w{i}") for i in range(600) for p in [r.randrange(4)]]
    frames = [(p, x := r.uniform(-60, 500), t := r.uniform(0, 700), x + w, t + r.uniform(0, 2 * w)) for w in (0, 3, 20, 33, 90, 260, 5_000) for p in (0, 1, 2)]
    frames += [(0, 10.0, 10.0, 5.0, 5.0), (1, None, 1.0, 2.0, 3.0), (2, -1e7, -1e7, 0.0, 1e7)]
    w = spark.createDataFrame(words, "page int, x0 double, x1 double, top double, bottom double, text string")
    b = spark.createDataFrame(frames, "page int, x0 double, top double, x1 double, bottom double")
    kept = boxes.outside(w, b, ["page"])
    inside = lambda a: any(f[0] == a[0] and f[1] is not None and f[1] <= (a[1] + a[2]) / 2 <= f[3] and f[2] <= (a[3] + a[4]) / 2 <= f[4] for f in frames)
    want = {a[5] for a in words if not inside(a)}
    assert {x["text"] for x in kept.collect()} == want and 0 < len(want) < len(words)
    assert "NestedLoop" not in kept._jdf.queryExecution().toString() and "Cartesian" not in kept._jdf.queryExecution().toString()
    texts = {x["page"]: x["text"] for x in boxes.page_texts(kept, ["page"]).collect()}
    for p in range(4):
        assert texts[p] == plain_page([a[1:] for a in words if a[0] == p and a[5] in want])


def test_second_reader_and_documents(spark):
    pages = spark.createDataFrame([("d", 1, "short"), ("d", 2, "x" * 200), ("d", 3, None), ("e", 1, "")], "doc string, page int, text string")
    other = spark.createDataFrame([("d", 1, "a longer text"), ("d", 2, "y" * 300), ("d", 3, "third"), ("f", 1, "only here")], "doc string, page int, text string")
    rows = boxes.second_reader(pages, other, ["doc", "page"])
    assert {(r["doc"], r["page"]): r["text"] for r in rows.collect()} == {("d", 1): "a longer text", ("d", 2): "x" * 200, ("d", 3): "third", ("e", 1): "", ("f", 1): "only here"}
    tables = spark.createDataFrame([("d", 1), ("d", 2)], "doc string, page int")
    whole = {r["doc"]: r["text"] for r in boxes.documents(rows, tables, "doc", "page").collect()}
    assert whole["d"] == f"# Page 1\n\na longer text\n\n\n# Page 2\n\n{'x' * 200}\n\n\n# Page 3\n\nthird\n\n<!-- removed_tables: 2 -->\n"
    assert whole["f"].endswith("only here\n\n<!-- removed_tables: 0 -->\n")


def test_long_pages_are_linear(spark):
    rows = spark.range(30_000).select(F.lit(1).alias("page"), (F.col("id") % 7 * 30).alias("x0"), (F.col("id") / 7 * 12).alias("top"), F.col("id").cast("string").alias("text"))
    began = time.perf_counter()
    text = boxes.page_texts(rows, ["page"]).first()["text"]
    assert len(text.split()) == 30_000 and time.perf_counter() - began < 20
    assert spark.range(1).select(report_texts.lines_from_words(F.array().cast("array<struct<text:string,top:double,x:double>>"))).first()[0] == ""


# --- walks ----------------------------------------------------------------------------------------


def plain_walk(candidates, sources, goal, most):
    tried = []
    done = 0
    for i, (name, known) in enumerate(sources):
        rows = list(range(min(len(candidates), max(most, goal)))) if i == 0 else [k for k, t in enumerate(tried) if not t[1]]
        if i and done >= goal:
            break
        for k in rows:
            if i == 0:
                tried.append([candidates[k], None, None, []])
            value = known.get(candidates[k])
            tried[k][3].append(name)
            if value:
                tried[k][1:3] = value, name
                done += 1
                if done >= goal:
                    break
    return [tuple([*t[:3], ",".join(t[3])]) for t in tried]


@pytest.mark.parametrize("goal,most", [(3, 15), (3, 2), (1, 4)])
def test_walk_stops_at_the_goal(spark, goal, most):
    r = random.Random(goal + most)
    groups = {g: [f"{g}-{i}" for i in range(r.randint(0, 22))] for g in range(40)}
    sources = [(f"s{k}", {c: r.choice(["text", " ", None, "other"]) for cs in groups.values() for c in cs if r.random() < p}) for k, p in enumerate((0.15, 0.2, 0.9))]
    rows = spark.createDataFrame([(g, i, c) for g, cs in groups.items() for i, c in enumerate(cs)], "g int, place int, number string")
    tables = [(name, spark.createDataFrame([(c, v) for c, v in known.items()], "number string, text string")) for name, known in sources]
    blankless = [(name, {c: v for c, v in known.items() if v and v.strip()}) for name, known in sources]
    got = walks.until_enough(rows, "g", "number", tables, goal=goal, most=most)
    found = {}
    for x in sorted(got.collect(), key=lambda x: (x["g"], x["place"])):
        found.setdefault(x["g"], []).append((x["number"], x["text"], x["found_in"], ",".join(x["tried"])))
    for g, cs in groups.items():
        assert found.get(g, []) == plain_walk(cs, blankless, goal, most), g
        assert len(found.get(g, [])) <= max(goal, most)
    counts = {x["g"]: x for x in walks.summary(got, rows, "g", goal).collect()}
    assert all(counts[g]["candidate_count"] == len(cs) and counts[g]["fulltext_count"] <= goal for g, cs in groups.items() if cs)


def test_candidates_are_ranked_once(spark):
    cited = spark.createDataFrame(
        [(1, " KR 10-1 B1 ", "KR", "B1", True), (1, "US 5 B2", "US", "B2", True), (1, "KR 9 A", "KR", "A", True), (1, "X", "KR", "B", None), (1, "  ", "KR", "B", True), (1, "US 5 B2", "US", "A", False)],
        "doc int, display_number string, country_code string, kind_code string, is_standardized boolean",
    )
    said = spark.createDataFrame([(1, 0, "JP 7 A"), (1, 1, "X"), (1, 2, "JP 7 A"), (2, 0, "alone"), (2, 1, None)], "doc int, position int, display_number string")
    rows = walks.ranked_candidates(cited, said, "doc").orderBy("doc", "place").collect()
    assert [(r["doc"], r["place"], r["display_number"], r["origin"]) for r in rows] == [
        (1, 1, "KR 10-1 B1", "citation"), (1, 2, "US 5 B2", "citation"), (1, 3, "KR 9 A", "citation"), (1, 4, "X", "citation"), (1, 5, "JP 7 A", "mentioned"), (2, 1, "alone", "mentioned"),
    ]
    assert rows[4]["country_code"] == "JP"


def test_enrichment_keeps_the_unresolved(spark):
    candidates = spark.createDataFrame([("a",), ("b",), ("c",)], "number string")
    matches = spark.createDataFrame([("a", 2, "20", "second", "old", None, None), ("a", 1, "10", "first", "pending", "2001", "text"), ("a", 3, "10", "x", None, None, None), ("b", 1, "30", "only search", "pending", None, None)], "number string, rank int, application_number string, title string, status string, publication_date string, abstract string")
    records = spark.createDataFrame([("10", " ", "R1", None, "register's"), ("99", "t", None, None, None)], "application_number string, title string, registration_number string, publication_date string, abstract string")
    got = {r["number"]: r for r in walks.enriched(candidates, matches, records, "number").collect()}
    assert (got["a"]["resolved_numbers"], got["a"]["title"], got["a"]["status"], got["a"]["publication_date"], got["a"]["abstract"], got["a"]["warning"]) == (["10", "20"], "first", "registered", "2001", "register's", None)
    assert (got["b"]["title"], got["b"]["status"], got["b"]["warning"]) == ("only search", "pending", "record_missing:30")
    assert (got["c"]["title"], got["c"]["application_number"], got["c"]["warning"]) == ("c", None, "application_number_unresolved:c")
    placed = candidates.withColumn("g", F.lit(1)).withColumn("place", F.ascii("number"))
    status = walks.evidence_status(placed, spark.createDataFrame([("b",), ("b",)], "number string"), "g", "number", most=2).orderBy("place").collect()
    assert [(r["number"], r["lookup_status"], r["n_resolved"], r["n_unresolved"]) for r in status] == [("a", "unresolved", 1, 1), ("b", "resolved", 1, 1)]


# --- nested documents -----------------------------------------------------------------------------


def random_json(r, depth):
    kind = r.choice(["object", "array", "scalar"]) if depth else "scalar"
    if kind == "object":
        return {r.choice(["a", "Citation", "patentDocumentsInfo", "b", "documentsInfo"]): random_json(r, depth - 1) for _ in range(r.randint(0, 4))}
    if kind == "array":
        return [random_json(r, depth - 1) for _ in range(r.randint(0, 4))]
    return r.choice([None, True, False, 3, 2.5, "", "text", 'q"uote'])


def plain_items(raw, tokens):
    found = []

    def walk(value):
        if isinstance(value, dict):
            for k, child in value.items():
                if any(t in k.lower() for t in tokens):
                    found.extend(child if isinstance(child, list) else [child] if isinstance(child, dict) else [])
                walk(child)
        elif isinstance(value, list):
            for child in value:
                walk(child)

    walk(raw)
    return found


def at(raw, path):
    import re

    for key, idx in re.findall(r"\.([^.\[]+)|\[(\d+)\]", path):
        raw = raw[key] if key else raw[int(idx)]
    return raw


def test_walk_of_nested_documents(spark):
    r = random.Random(8)
    docs = [(i, random_json(r, 6)) for i in range(120)]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs] + [(900, None), (901, ""), (902, "{broken"), (903, "[" * 50_000)], "id int, body string")
    nodes = trees.walk(rows, "id", "body")
    held = {}
    for n in nodes.collect():
        held.setdefault(n["doc"], []).append(n)
    assert not set(held) & {900, 901, 902, 903}
    for i, d in docs:
        for n in held.get(i, []):
            value = at(d, n["path"])
            kind = {dict: "object", list: "array", type(None): "null", bool: "boolean", str: "string"}.get(type(value), "number")
            assert n["kind"] == kind and n["value"] == (value if kind == "string" else json.dumps(value) if kind in ("number", "boolean") else None)
        assert [n["position"] for n in sorted(held.get(i, []), key=lambda n: n["position"])] == list(range(len(held.get(i, []))))
    tokens = ("documentsinfo", "patentdocuments", "citation")
    items = {}
    for x in trees.listed_under(nodes, tokens).orderBy("doc", "item").collect():
        items.setdefault(x["doc"], []).append(x["path"])
    for i, d in docs:
        assert [json.dumps(at(d, p)) for p in items.get(i, [])] == [json.dumps(x) for x in plain_items(d, tokens)], i


def test_items_and_their_fields_without_joins(spark):
    r = random.Random(9)
    docs = [(i, random_json(r, 6)) for i in range(80)] + [(900, {"citation": {"Line": 1, "line": 2}, "patentDocuments": [{"part": "p", "supplier": None}, 7, {"line": [1]}, {"line": "x", "more": {"citation": {"supplier": 3}}}]})]
    names = ["line", "part", "supplier", "a", "b"]
    tokens = ("documentsinfo", "patentdocuments", "citation", "a")
    nodes = trees.walk(spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "id long, body string"), "id", "body")
    items = trees.listed_under(nodes, tokens)
    joined = trees.fields(nodes, items, names).join(items.select("doc", "item", "position"), ["doc", "item"]).join(nodes.select("doc", "position", "depth"), ["doc", "position"])
    got = trees.listed_fields(nodes, tokens, names)
    columns = ["doc", "item", "position", "depth", *names]
    rows = sorted(map(tuple, got.select(columns).collect()), key=lambda x: x[:2])
    assert rows == sorted(map(tuple, joined.select(columns).collect()), key=lambda x: x[:2]) and len(rows) > 20
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_xml_becomes_records(spark):
    xml = '<?xml version="1.0"?><r xmlns:n="u"><n:a> 1 </n:a><b/><c><d>x</d><d>y</d></c><a>2</a></r>'
    rows = spark.createDataFrame([(1, xml), (2, "<broken"), (3, None), (4, '<!DOCTYPE x [<!ENTITY e "v">]><x>&e;</x>'), (5, "<one>t</one>"), (6, "<a>" * 3_000 + "z" + "</a>" * 3_000)], "id int, body string").withColumn("json", trees.xml_to_json(F.col("body")))
    got = {r["id"]: r["json"] for r in rows.collect()}
    assert json.loads(got[1]) == {"a": ["1", "2"], "b": "", "c": {"d": ["x", "y"]}} and json.loads(got[5]) == "t"
    assert got[2] is None and got[3] is None and got[4] is None and got[6].endswith('"z"' + "}" * 2_999)
    nodes = trees.walk(rows.where("id = 1"), "id", "json")
    assert [r["idx"] for r in trees.as_list(nodes, "$.c.d").orderBy("idx").collect()] == [0, 1]
    assert trees.as_list(nodes, "$.c").count() == 1 and trees.as_list(nodes, "$.b").count() == 0 and trees.as_list(nodes, "$.none").count() == 0
    fields = trees.fields(nodes, nodes.where("path = '$'").select("doc", F.lit(1).alias("item"), "position"), ["B", "q"]).first()
    assert (fields["B"], fields["q"]) == ("", None)


@pytest.mark.parametrize("together", [0, 2, 64])
def test_words_meet_few_boxes_in_one_join(spark, monkeypatch, together):
    monkeypatch.setattr(boxes, "TOGETHER", together)
    r = random.Random(6)
    words = [(p, r.uniform(0, 300), r.uniform(0, 300)) for _ in range(300) for p in [r.choice((0, 1, 2, None))]] + [(0, None, 1.0)]
    frames = [(p, x := r.uniform(0, 250), t := r.uniform(0, 250), x + r.uniform(0, 90), t + r.uniform(0, 90)) for p in (0, 1, 1, 1, None) for _ in range(2)] + [(0, 0.0, None, 300.0, 300.0)]
    w = spark.createDataFrame([(i, p, x, x, y, y) for i, (p, x, y) in enumerate(words)], "i int, page int, x0 double, x1 double, top double, bottom double")
    kept = boxes.outside(w, spark.createDataFrame(frames, "page int, x0 double, top double, x1 double, bottom double"), ["page"])
    held = lambda p, x, y: p is not None and x is not None and any(q == p and None not in b and b[0] <= x <= b[2] and b[1] <= y <= b[3] for q, *b in frames)
    assert {k["i"] for k in kept.collect()} == {i for i, (p, x, y) in enumerate(words) if not held(p, x, y)}
    if together == 64:
        assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


# --- archive pages --------------------------------------------------------------------------------

PAGE = """<html><head><title>Fallback</title><meta name="dc.title" content=" A &amp; B "><body>
<section itemprop="abstract"><div class="abstract style">An <b>abstract</b></div></section>
<section itemprop="description"><h2>Field</h2><p>One<p>Two<script>var x="<p>no</p>"</script></section>
<div class="claims"><div id="c1" num="1" class="claim"><div class="claim-text">1. A device<div class="claim-text">with a wheel</div>turning</div></div>
<div class="claim-dependent"><div num="2" class="claim big"><div class="claim-text">The device of claim 1</div></div></div></div>
<table><tr><th>Number<th>Title<tr itemprop="backwardReferences"><td><span itemprop="publicationNumber">US-123 B2</span><td itemprop=title>First<td><span itemprop="examinerCited">*</span>
<tr itemprop="backwardReferencesFamily"><td><span itemprop="publicationNumber">US123B2</span><tr itemprop='backwardReferences'><td><span itemprop="publicationNumber">not a number</span>
<tr itemprop="forwardReferences"><td><table><tr><td>inner</table><span itemprop="publicationNumber">KR9A</span></table>
<img itemprop="thumbnail" src="f1.png"><img itemprop=thumbnail src="f1.png"/><img src="no.png"><a href="x">link</a><a name="none">no</a></body>"""


def test_archive_pages_are_read_as_trees(spark):
    df = archive_pages.read(spark.createDataFrame([(1, PAGE), (2, None), (3, "</div></p>text<div class=claim-text>loose"), (4, "<tr><td>" * 3_000), (5, "<div>" * 5_000)], "id int, html string"), "html")
    got = {r["id"]: r["page"] for r in df.collect()}
    p = got[1]
    assert (p["title"], p["abstract"], p["description"]) == ("A & B", "An abstract", "Field One Two")
    assert [tuple(c) for c in p["claims"]] == [(1, "1. A device with a wheel turning"), (2, "The device of claim 1")]
    assert [(r["kind"], r["number"], r["title"], r["examiner_cited"]) for r in p["references"]] == [("backward", "US-123 B2", "First", True), ("backward", "US123B2", None, False), ("backward", "not a number", None, False), ("forward", "KR9A", None, False)]
    assert (p["figures"], p["headings"], p["n_rows"], p["n_links"]) == (["f1.png"], ["Field"], 6, 1)
    assert got[2]["title"] is None and got[2]["claims"] == [] and [tuple(c) for c in got[3]["claims"]] == [(1, "loose")] and got[4]["n_rows"] == 3_000
    refs = archive_pages.references(df, "id").orderBy("position").collect()
    assert [(r["kind"], r["display_number"], r["title"]) for r in refs] == [("backward", "US 123 B2", "First"), ("forward", "KR 9 A", None)]
    text = df.where("id = 1").select(archive_pages.markdown(F.col("page"))).first()[0]
    assert text == "# A & B\n\n## ABSTRACT\n\nAn abstract\n\n## DETAILED DESCRIPTION\n\nField One Two\n\n## CLAIMS\n\n1. 1. A device with a wheel turning\n\n2. The device of claim 1\n\n## REFERENCES CITED\n\n- US 123 B2"


def test_plain_pages_are_read_alike_and_once(spark, monkeypatch):
    bits = ["<div class='claim' num=3>", "<div class=claim-text>", "</div>", "<tr itemprop=forwardReferences>", "<td>", "<span itemprop='title'>", "</span>", "</table>", "<table>", "<p>", "<br>", '<meta name="DC.title" content="T">', "a &amp; b", "<li>", "<h2>", "</ p>", "<!-- x -->", "<a href='x>y'>", "<title>", "<br/>", "<"]
    r = random.Random(3)
    pages = ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(3_000)]
    fast = [archive_pages._parts(p) for p in pages]
    assert sum(archive_pages._plain(p) is not None for p in pages) > 200
    monkeypatch.setattr(archive_pages, "_plain", lambda page: None)
    assert fast == [archive_pages._parts(p) for p in pages]
    refs = archive_pages.references(archive_pages.read(spark.createDataFrame([(1, PAGE)], "id int, html string"), "html"), "id")
    assert refs._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_plain_pages_need_no_tree(monkeypatch):
    bits = ["<div class='claim claim-text' num=3>", "<div class='claim' num=12>", "<div class=claim-text>", "<div class=abstract>", "<p itemprop=description>", "</div>", "</p>", "<tr itemprop=forwardReferences>", "<tr itemprop='backwardReferencesOrig'>", "<td itemprop=examinerCited>", "<meta itemprop=title>", "<span itemprop=publicationNumber>", "</span>", "<table>", "</table>", "<h3>", "</h3>", "<img itemprop=thumbnail src=a.png>", "<meta name=dc.description content=D>", "<a href=x>", "a &amp; b", " &lt;&amp;amp; ", "c > d"]
    r = random.Random(5)
    pages = ["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(4_000)]
    pages += ["<div class=claim num=1>" * 400 + "<div class=claim-text>deep" + "</div>" * 200 + "<div class=claim-text>later", "<h2>a</x>b</h2><h2>c<b></b>d</h2>"]
    trees = [archive_pages._parts(p + "<!-- -->") for p in pages]
    monkeypatch.setattr(archive_pages, "_Tree", None)
    assert [archive_pages._parts(p) for p in pages] == trees
    monkeypatch.setattr(archive_pages, "_KNOWN_MOST", 8)
    monkeypatch.setattr(archive_pages, "_KNOWN_OF_A_PAGE", 1_000)
    assert [archive_pages._parts(p) for p in pages] == trees
    assert archive_pages._plain("<b>" * 2_000) is None and archive_pages._parts("<h2>x</h2>")[6] == ["x"]


# --- merged structures ----------------------------------------------------------------------------


def test_ids_and_types_are_compared_as_written_differently(spark):
    ids = spark.createDataFrame([("K01",), ("k 1",), (" K1\n",), ("K010",), ("K00",), (None,)], "id string").select(linkage.element_key(F.col("id"))).collect()
    assert [r[0] for r in ids] == ["K1", "K1", "K1", "K10", "K0", ""]
    kinds = [("독립항", None), ("独立権利要求", "1"), ("Independent claim", "1"), ("dependent", None), ("従属項", None), ("?", "2"), (None, "null"), ("", None)]
    got = spark.createDataFrame(kinds, "t string, d string").select(linkage.claim_type(F.col("t"), F.col("d"))).collect()
    assert [r[0] for r in got] == ["independent"] * 3 + ["dependent"] * 3 + ["independent"] * 2


def test_passes_are_merged_and_gathered(spark):
    first = spark.createDataFrame([(1, [("K01", "a"), ("K2", "b"), None, (None, "c")]), (2, []), (3, None)], "doc int, key_elements array<struct<key_element_id:string,key_element_name:string>>")
    second = spark.createDataFrame([(1, [("k 1", True, "self_clear", None), ("K1", False, "", "late"), ("", True, "self_clear", "x"), None])], "doc int, key_element_clarity array<struct<key_element_id:string,in_independent_claim:boolean,claim_clarity:string,clarity_issue:string>>")
    merged = structures.merge_passes(first, second, "doc")
    got = structures.gathered(merged, "doc").first()
    assert [(e["element"]["key_element_name"], e["in_independent_claim"], e["claim_clarity"], e["clarity_issue"]) for e in got["elements"]] == [("a", False, "unresolved", "late"), ("b", False, "unresolved", ""), ("c", False, "unresolved", "")]


# --- caches ---------------------------------------------------------------------------------------


def test_cache_calls_once_and_mends_torn_parts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, text string").withColumn("key", content_key(F.col("text"), model="m", effort="low"))
    assert docs.select("key").distinct().count() == 3 and docs.where("id = 1").select("key").first() != docs.select(content_key(F.col("text"), model="n", effort="low")).first()
    cache = ResultCache(spark, str(tmp_path / "cache"))
    calls = []

    def compute(rows):
        calls.append(rows.count())
        return model.complete(rows, "text").select("key", "reply")

    first = {r["id"]: r["reply"] for r in cache.fill(docs, "key", compute).collect()}
    again = {r["id"]: r["reply"] for r in cache.fill(docs, "key", compute).collect()}
    assert calls == [3] and first == again and first[1] == first[3] and all(first.values())
    cache.put(spark.createDataFrame([("torn", "{no object"), ("list", "[1]"), ("null", None)], "key string, reply string"), "key", "reply")
    assert cache.entries().count() == 3
    for part in Path(tmp_path / "cache" / "entries").glob("*/part-*.parquet"):  # a writer died half-way
        if part.stat().st_size:
            part.write_bytes(part.read_bytes()[: part.stat().st_size // 2])
            (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert cache.entries().count() == 0
    assert {r["id"]: r["reply"] for r in cache.fill(docs, "key", compute).collect()} == first and calls == [3, 3]


def test_documents_are_structured_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def note(kind):
        (calls / f"{kind}-{time.time_ns()}").touch()

    def first(prompt):
        note("first")
        p = json.loads(prompt)
        if p.get("specification") == "bad":
            raise OSError("no answer")
        words = (p.get("specification") or "").split()
        return "Sure: " + json.dumps({"key_elements": [{"key_element_id": f"K0{i}", "key_element_name": w, "core_role": "essential"} for i, w in enumerate(words, 1)], "key_flow": [{"key_element_id": "K1", "next_key_element_id": "K2", "coupling_strength": "weak"}]})

    def second(prompt):
        note("second")
        p = json.loads(prompt)
        if p.get("claims") == "no json":
            return "nothing"
        return json.dumps({"key_element_clarity": [{"key_element_id": "k 1", "in_independent_claim": True, "claim_clarity": "self_clear"}], "claims": [{"claim_no": str(len(p["key_elements"])), "type": "독립항"}]})

    docs = spark.createDataFrame([(1, "wheel axle", "c", None, "x"), (2, "wheel axle", "c", None, "y"), (3, "bad", "c", "d", "z"), (4, "a", "no json", "d", "z"), (5, None, None, None, None)], "id int, spec string, claims string, drawings string, reply string")
    cache = ResultCache(spark, str(tmp_path / "cache"))
    run = lambda: structuring.structured(docs, cache, specification="spec", claims="claims", drawings="drawings", first=first, second=second, model="m")
    got = {r["id"]: r for r in run().collect()}
    assert [(e["key_element_name"], e["in_independent_claim"], e["claim_clarity"]) for e in got[1]["structure"]["key_elements"]] == [("wheel", True, "self_clear"), ("axle", False, "unresolved")]
    assert got[1]["structure"] == got[2]["structure"] and got[1]["structure"]["claims"][0]["claim_no"] == "2" and got[3]["structure"] is None and got[4]["structure"] is None and got[5]["structure"]["key_elements"] == [] and got[2]["reply"] == "y"
    n = len(list(calls.iterdir()))
    again = {r["id"]: r["structure"] for r in run().collect()}
    assert again == {i: r["structure"] for i, r in got.items()} and len(list(calls.iterdir())) <= n + 4  # only what failed is asked again
    light = run().where("id = 1").select(structuring.light(F.col("structure"), elements=1).alias("l")).first()["l"]
    assert [e["key_element_name"] for e in light["key_elements"]] == ["wheel"] and len(light["key_flow"]) == 1


def test_cache_evicts_what_was_not_used(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path / "cache"))
    put = lambda *keys: cache.put(spark.createDataFrame([(k, json.dumps({"k": k})) for k in keys], "key string, reply string"), "key", "reply")
    put("a", "b")
    put("c")
    ask = spark.createDataFrame([("a",)], "key string")
    assert cache.fill(ask, "key", lambda rows: pytest.fail("nothing misses")).first()["reply"] == '{"k": "a"}'
    cache.evict(2)
    assert {r["key"] for r in cache.entries().collect()} == {"a", "c"}
    put("d")
    cache.evict(2)
    assert {r["key"] for r in cache.entries().collect()} == {"a", "d"} or {r["key"] for r in cache.entries().collect()} == {"c", "d"}


# --- entities -------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_entities_equal_union_find(spark, seed):
    r = random.Random(seed)
    rows = [(i, [f"{r.choice('ab')}:{r.randrange(300)}" for _ in range(r.choice([0, 1, 1, 2, 3]))]) for i in range(400)]
    chain = [(1_000 + i, [f"c:{i}", f"c:{i + 1}"]) for i in range(60)]
    r.shuffle(chain)
    rows += [(k, v) for (k, _), (_, v) in zip(sorted(chain), chain)] + [(5_000 + i, ["hot"]) for i in range(200)] + [(9_000, None)]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, names in rows:
        for n in names or []:
            a, b = sorted((root(i), root(holders.setdefault(n, i))))
            parent[b] = a
    got = {x["id"]: x["entity"] for x in identity.entities(spark.createDataFrame(rows, "id int, names array<string>"), "id", "names").collect()}
    assert got == {i: root(i) for i, _ in rows}


def test_identity_columns(spark):
    rows = spark.createDataFrame([("u", " n ", "t"), (None, " ", "t"), (None, None, None)], "url string, number string, title string")
    got = rows.select(identity.identity_values(url=F.col("url"), number=F.col("number")).alias("v"), identity.first_identity(F.col("title"), F.lit("2001"), number=F.col("number")).alias("f"), identity.composite_identity(F.col("url"), F.col("title")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(["url:u", "number:n"], "number:n", "u|t"), ([], "t:2001", "|t"), ([], ":2001", "|")]


# --- rework ---------------------------------------------------------------------------------------


def test_only_flagged_rows_are_made_anew(spark):
    rows = spark.createDataFrame([(1, 10), (2, 70), (3, None), (4, 55)], "id int, score int")
    seen = []

    def again(left):
        seen.append(sorted(r["id"] for r in left.collect()))
        return left.withColumn("score", F.coalesce("score", F.lit(0)) + 10)

    got = {r["id"]: (r["score"], r["retries"], r["checked"], r["status"]) for r in rework.rework(rows, F.col("score") < 60, again, most=2).collect()}
    assert got == {1: (30, 2, 3, "exhausted"), 2: (70, 0, 1, "passed"), 3: (20, 2, 3, "exhausted"), 4: (65, 1, 2, "passed")} and seen == [[1, 3, 4], [1, 3]]
    seen.clear()
    assert rework.rework(rows.where("id = 2"), F.col("score") < 60, again).count() == 1 and not seen
    steps = spark.createDataFrame([(None, None, None, None), (True, False, None, None), (True, True, None, None), (True, True, 1, False), (True, True, 1, True)], "a boolean, b boolean, c int, d boolean")
    assert [r[0] for r in steps.select(rework.next_step(*map(F.col, "abcd"))).collect()] == ["structuring", "evidence", "valuation", "writing", "done"]
    checks = spark.createDataFrame([("p", 2, ["y", "x"]), ("p", 1, ["x", "z"]), ("p", 3, []), ("q", 1, [])], "k string, axis int, issues array<string>")
    assert [(r["k"], r["gaps"]) for r in rework.gaps(checks, "k", "axis").collect()] == [("p", ["x", "z", "y"])]


# --- neighbours -----------------------------------------------------------------------------------


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_nearest_in_blocks(spark, block_bytes):
    r = np.random.default_rng(3)
    rows = [(i, r.integers(-3, 4, 4).astype(float).tolist() if i % 11 else (None if i % 2 else [1.0, 2.0] if i % 3 else [0.0] * 4), i % 3 if i % 13 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v array<double>, g int").repartition(5)

    def cos(a, b):
        a, b = a or [], b or []
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 4) if len(a) == len(b) and n else 0.0

    for by in (None, "g"):
        want = {}
        for q, qv, qg in rows[::20]:
            if by and qg is None:
                continue
            near = sorted((-cos(v, qv), i) for i, v, g in rows if i != q and (not by or g == qg))[:4]
            want |= {(q, k + 1): (i, -s + 0.0) for k, (s, i) in enumerate(near)}
        got = {(x["query"], x["rank"]): (x["match"], x["similarity"] + 0.0) for x in neighbours.nearest(df, df.where("id % 20 = 0"), vector="v", key="id", k=4, by=by, block_bytes=block_bytes).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert neighbours.nearest(df.limit(0), df.where("id = 0"), vector="v", key="id", k=2).count() == 0 and neighbours.nearest(df, df.limit(0), vector="v", key="id", k=2).count() == 0


def test_guards_and_votes(spark):
    rows = spark.createDataFrame([(1, True, "c", "2001", "t"), (2, False, " ", "2001", "t"), (3, False, "c", None, "t"), (4, None, "c", "2001", ""), (5, False, "c", "2001", "t")], "id int, abroad boolean, code string, filed string, claims string")
    got = hybrid.guarded(rows, abroad=F.col("abroad"), code=F.col("code"), filed=F.col("filed"), claims=F.col("claims"))
    assert [r["skip"] for r in got.orderBy("id").collect()] == ["foreign_target_unsupported", "classification_not_found", "filing_date_not_found", "claims_not_found", None]
    near = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10), (2, 13), (3, 14)], "query int, match int")
    labels = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, 2), (14, 9)], "match int, label int")
    taxonomy = spark.createDataFrame([(1, True, "p"), (2, False, "parent")], "label int, known boolean, parent string")
    out = {r["query"]: (r["label"], r["votes"], r["confidence"], r["accepted"]) for r in hybrid.voted(near, labels, taxonomy, k=3).collect()}
    assert out == {1: ("1", 2, 0.6667, True), 2: ("1", 1, 0.3333, True), 3: (None, 1, 0.3, False)}


def test_most_alike_in_blocks(spark):
    r = random.Random(9)
    docs = [(i, list({r.choice("abcdefghij") for _ in range(r.randint(0, 8))})) for i in range(200)]
    asked = [(i, w) for i, w in docs if i % 20 == 0]
    df, queries = spark.createDataFrame(docs, "id int, w array<string>"), spark.createDataFrame(asked, "q int, w array<string>")
    want = {}
    for q, qw in asked:
        near = sorted((-round(len(set(w) & set(qw)) / len(set(w) | set(qw)), 4), i) for i, w in docs if set(w) & set(qw))[:3]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(near)}
    for size in (1 << 20, 200):
        got = neighbours.most_alike(df, "id", F.col("w"), queries, "q", F.col("w"), k=3, block_bytes=size)
        assert {(x["q"], x["rank"]): (x["id"], x["similarity"]) for x in got.collect()} == want
    assert neighbours.most_alike(df, "id", F.col("w"), queries.limit(0), "q", F.col("w"), k=3).count() == 0


def test_neighbours_of_many_queries_are_found_in_slices(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, i % 3, r.normal(size=4 if i % 5 else 6).round(1).tolist()) for i in range(90)] + [(90, 0, None), (91, 1, [0.0] * 4)]
    df = spark.createDataFrame(rows, "i long, g int, v array<double>")
    found = lambda by: sorted(map(tuple, neighbours.nearest(df, df.where("i % 2 = 0"), vector="v", key="i", k=4, by=by).collect()))
    whole = [found(None), found("g")]
    held = []
    best = neighbours._best
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    assert [found(None), found("g")] == whole
    monkeypatch.setattr(neighbours, "_best", lambda sims, keys, k: held.append(sims.shape[1]) or best(sims, keys, k))
    block = [{"q": i, "g": "", "v": v} for i, _, v in rows[:60]]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in rows]), pa.array([v for *_, v in rows], pa.list_(pa.float64())), pa.array([""] * len(rows))], names=["m", "v", "g"])
    assert sum(b.num_rows for b in neighbours._scan(block, 4, 4, False)(iter([batch]))) == 240 and max(held) == 7
