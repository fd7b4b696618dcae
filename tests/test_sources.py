"""Sources, sinks and streams."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F, types as T

from assaykit.operators import documents
from assaykit.sources import tables
from assaykit.streaming import state


def test_bad_lines_are_told_apart(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\nnot json\n\n{"a": "no number"}\n{"a": 3}\n')
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    good, bad = tables.jsonl_with_errors(spark, str(tmp_path), schema)
    assert sorted(tuple(r) for r in good.collect()) == [(1, "x"), (3, None)]
    assert sorted(r[0] for r in bad.collect()) == ['not json', '{"a": "no number"}']
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.jsonl(spark, str(tmp_path), schema).collect()


def test_upserts_build_on_each_other(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    assert tables.current(spark, path) is None
    first = tables.upsert(spark, path, rows((1, "a"), (2, "b")), "k", ["v"], "v1")
    second = tables.upsert(spark, path, rows((2, "c"), (3, None)), "k", ["v"], "v2")
    third = tables.upsert(spark, path, rows((3, "d")), "k", ["v"], "v3")
    assert tables.current(spark, path) == third
    read = lambda p: sorted(tuple(r) for r in spark.read.parquet(p).collect())
    assert read(first) == [(1, "a"), (2, "b")] and read(second) == [(1, "a"), (2, "c"), (3, None)] and read(third) == [(1, "a"), (2, "c"), (3, "d")]


def test_lookup_page_and_order(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "id long, n string")
    assert tables.lookup(df, id=None, n="x").first()["id"] == 1 and tables.lookup(df, id=2, n="x").first()["n"] == "y"
    assert tables.lookup(df, n="none").count() == 0
    with pytest.raises(ValueError):
        tables.lookup(df, id=None, n="")
    assert [r["id"] for r in tables.page(df, ["id"], 2, 1).collect()] == [2, 3]
    assert sorted(r["id"] for r in tables.shuffled(df, 7, 3).collect()) == [1, 2, 3]


def test_responses_are_checked(spark):
    df = spark.createDataFrame([("00", "x"), ("", None), (" ", "error"), ("99", ""), ("success", None), (None, None)], "code string, message string")
    assert [r["ok"] for r in tables.checked(df).collect()] == [True, True, False, False, True, True]


def test_xml_rows_and_runs(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><item><n>1</n><t>x</t></item><item><n>2</n><t>y</t><t>z</t></item></r>")
    rows = tables.xml(spark, str(tmp_path / "a.xml"), "item", "n long, t array<string>").collect()
    assert sorted((r["n"], r["t"]) for r in rows) == [(1, ["x"]), (2, ["y", "z"])]
    tables.write_runs(spark.createDataFrame([("r1", 1), ("r2", 2)], "run string, v long"), str(tmp_path / "runs"), "run")
    assert sorted(p.name for p in (tmp_path / "runs").iterdir() if p.is_dir()) == ["run=r1", "run=r2"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>first paragraph here<p>second paragraph here</p>", ["first paragraph here", "second paragraph here"]),
        ("<ul><li>one item of a list<li>another item of it</ul>", ["one item of a list", "another item of it"]),
        ("<body><p>never closed at all", ["never closed at all"]),
        ("<nav><p>navigation text is hidden</nav><p>this text is shown here", ["this text is shown here"]),
        ("<p>with <b>bold words</b> inside of it</p>", ["with bold words inside of it"]),
        (None, []),
    ],
)
def test_unclosed_tags(spark, page, want):
    df = spark.createDataFrame([(page,)], "html string")
    assert documents.read_html(df, "html", least=10).first()["paragraphs"] == want


def test_sections_within_rows(spark):
    df = spark.createDataFrame([(1, "before\n# One\na\n\nb\n## Two\n# Three\nc"), (2, "no heading"), (3, None)], "id long, t string")
    got = [(r["id"], r["section_no"], r["heading"], r["text"]) for r in documents.sections(df, "id", "t").orderBy("id", "section_no").collect()]
    assert got == [(1, 0, None, "before"), (1, 1, "One", "a\n\nb"), (1, 2, "Two", ""), (1, 3, "Three", "c"), (2, 0, None, "no heading")]
    named = documents.named_sections(spark.createDataFrame([(1, "[Field]\nx\nClaims:\ny\nfield\nz")], "id long, t string"), "id", "t", {"field": ("field",), "claims": ("claims",)}).first()
    assert (named["field"], named["claims"]) == ("z", "y")


def events(start: int, n: int):
    base = dt.datetime(2024, 1, 1, 12)
    return [{"user": f"u{i % 2}", "no": i, "at": (base + dt.timedelta(seconds=7 * i)).isoformat(), "v": str(i)} for i in range(start, start + n)]


def run_stream(spark, folder, make, name, mode):
    schema = "user string, no long, at timestamp, v string"
    (folder / "in").mkdir()
    for k in range(3):
        (folder / "in" / f"{k}.json").write_text("\n".join(json.dumps(e) for e in events(10 * k, 10)))
        os.utime(folder / "in" / f"{k}.json", (1_700_000_000 + 100 * k,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect(), spark.read.schema(schema).json(str(folder / "in"))


def test_stream_of_sliding_limits_equals_the_table(spark, tmp_path):
    rows, table = run_stream(spark, tmp_path, lambda s: state.stream_sliding_limit(s, key="user", at="at", order="no", seconds=30, most=2), "limits", "append")
    want = state.sliding_limit(table, key="user", at="at", order="no", seconds=30, most=2).collect()
    assert sorted((r["no"], r["recent"], r["limited"]) for r in rows) == sorted((r["no"], r["recent"], r["limited"]) for r in want)
    assert any(r["limited"] for r in rows)


def test_stream_of_latest_values_ends_with_the_last(spark, tmp_path):
    rows, _ = run_stream(spark, tmp_path, lambda s: state.stream_latest(s, key="user", at="at", value="v"), "last", "update")
    last = {}
    for r in sorted(rows, key=lambda r: r["at"]):
        last[r["user"]] = r["v"]
    assert last == {"u0": "28", "u1": "29"}


def test_stream_of_window_counts(spark, tmp_path):
    rows, table = run_stream(spark, tmp_path, lambda s: state.stream_window_counts(s, key="user", at="at", window="1 minute"), "counts", "complete")
    assert sum(r["n"] for r in rows) == 30
    want = table.groupBy(F.window("at", "1 minute")["start"].alias("start"), "user").count().collect()
    assert sorted((r["start"], r["user"], r["n"]) for r in rows) == sorted(tuple(r) for r in want)
