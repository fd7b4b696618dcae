"""Operators that compare documents with each other or with other tables, sharding, and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assaykit.llm import decontaminate, jaccard, queries, sharding, substrings
from assaykit.llm.components import components

from . import brute
from .conftest import LONG, ODD_TEXTS, PROSE, REPEATED, frame


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def copies(seed: int, n: int) -> list[tuple[int, str]]:
    """Families of near copies at many distances, some in chains."""
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    out = []
    for _ in range(n // 8):
        text = [r.choice(vocabulary) for _ in range(r.randint(3, 90))]
        for _ in range(8):
            out.append(" ".join(text))
            text = list(text)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                k = r.randrange(len(text))
                text[k : k + r.randint(0, 1)] = [r.choice(vocabulary)]
    r.shuffle(out)
    return list(enumerate(out))


# --- n-gram Jaccard join ----------------------------------------------------------------------------


def test_join_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(docs).collect()}
    assert got == brute.groups(rows_of(docs))
    assert any(i != c for i, (_, c) in got.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force_on_near_copies(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 4_000)
    if seed == 2:  # without early links, prefixes alone must find all
        monkeypatch.setattr(jaccard, "_early_cells", lambda alike: alike.select(F.col("rep").alias("big"), F.lit(0).cast("long").alias("cell"), F.lit(0).alias("side"), F.col("rep").alias("id")).where("false"))
    rows = copies(seed, 640)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(frame(spark, rows)).collect()}
    assert got == brute.groups(rows)


def test_long_documents_and_hot_values_are_dealt_to_more_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "UNIT", 4)  # each document weighs as much as several
    monkeypatch.setattr(jaccard, "SLICE", 3)
    rows = copies(7, 320)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(frame(spark, rows)).collect()}
    assert got == brute.groups(rows)


def test_members_of_a_family_that_are_far_apart_make_no_pairs(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(x if k % 25 else f"{x}x{i}" for k, x in enumerate(base[j:] + base[:j]))) for i in range(150) for j in [r.randrange(200)]]
    rows += [(i + 150, text + " more") for i, text in rows[:5]]  # and five that have a copy
    made, cells = [], jaccard._late_cells
    monkeypatch.setattr(jaccard, "_levels", lambda rows, counters, salts: np.full(counters, 6, np.uint8))  # as in large inputs, whose counters are full
    monkeypatch.setattr(jaccard, "_early_cells", lambda alike: alike.select(F.col("rep").alias("big"), F.lit(0).cast("long").alias("cell"), F.lit(0).alias("side"), F.col("rep").alias("id")).where("false"))
    monkeypatch.setattr(jaccard, "_late_cells", lambda pairs, labelled: made.append(pairs.count()) or cells(pairs, labelled))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.groups(frame(spark, rows)).collect()}
    assert got == brute.groups(rows)
    assert 5 <= made[0] < 1_000  # of 11,935


def test_sketches_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 0)  # all bring one
    monkeypatch.setattr(jaccard, "BUCKET_BYTES", 4_000)
    monkeypatch.setattr(jaccard, "_early_cells", lambda alike: alike.select(F.col("rep").alias("big"), F.lit(0).cast("long").alias("cell"), F.lit(0).alias("side"), F.col("rep").alias("id")).where("false"))
    rows = copies(3, 640)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.groups(frame(spark, rows)).collect()}
    assert got == brute.groups(rows)


def test_an_entry_of_a_prefix_costs_as_much_in_many_buckets():
    r = random.Random(11)
    texts = [" ".join(f"w{r.randrange(9999)}" for _ in range(300)).encode() for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64())] * 2 + [pa.array(texts, pa.binary())], names=["id", "group", "text"])
    size = lambda buckets: sum(len(x) for out in jaccard._prefixes(buckets, np.full(1 << 12, 6, np.uint8))(iter([batch])) for column in out.columns[1:] for x in column.to_pylist())
    assert size(1) == size(1_000)


def test_sketches_and_sizes_of_entries_bound_what_they_stand_for():
    r = np.random.default_rng(4)
    for n in (1, 7, 900, 5_000):
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.concatenate([a[n // 9 :], r.integers(0, 1 << 63, n // 20).astype(np.uint64)])
        words = jaccard.SKETCH_BITS // 64
        for x, y in ((a, b), (b, a)):
            sketches = [jaccard.folded(jaccard.sketch_of(z), words).reshape(1, -1) for z in (x, y)]
            assert jaccard.may_link(*sketches, np.array([7 * len(np.setxor1d(x, y))]))[0]
    sizes = np.concatenate([np.arange(1, 3_000), [1 << 20, (1 << 31) - 1]])
    at = np.searchsorted(jaccard._EDGES, sizes, side="right") - 1
    assert (at < 256).all() and (jaccard._LOWEST[at] <= sizes).all() and (sizes <= jaccard._HIGHEST[at]).all()
    packed = jaccard._pack(*(x := (np.array([5, 9, 7], np.uint32), np.array([-(1 << 62), 3, 1 << 62]), np.array([1, 2, 3], np.uint8), np.array([4, 5, 6], np.uint8))))
    assert all((y == z).all() for y, z in zip(jaccard._unpack(packed), x, strict=True))


def test_cells_are_bounded_by_what_they_hold(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    rows = [(i, text + f" {i}" * (i + 1)) for i in range(40)]
    alike = spark.createDataFrame([(i, 60_000, [1, 2, 3, 4, 5, 6, 7, 8]) for i, _ in rows], "rep long, n long, keys array<long>")
    most = jaccard._early_cells(alike).groupBy("big", "cell").count().agg(F.max("count")).first()[0]
    assert most < 30  # 64 documents of ordinary length would be together
    got = {r["component_id"] for r in jaccard.groups(frame(spark, rows)).collect()}
    assert got == {0}


def test_join_of_odd_tables(spark, odd, repeated, none):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(odd).collect() if r["doc_id"] is not None}
    assert got == brute.groups([x for x in ODD_TEXTS if x[0] is not None])
    assert jaccard.groups(none).count() == 0
    rows = jaccard.groups(repeated).collect()
    assert len(rows) == len(ODD_TEXTS + REPEATED)
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None] * 3


def test_null_ids_link_nothing(spark):
    a = [f"a{i}" for i in range(40)]
    chain = [" ".join(a), " ".join(a[3:] + ["x", "y", "z"]), " ".join(a[6:] + ["x", "y", "z", "p", "q", "r"])]
    rows = [(1, chain[0]), (1, "something else"), (None, chain[1]), (2, chain[2])]
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.groups(frame(spark, rows)).collect() if r["doc_id"])
    assert got == [(1, 1), (1, 1), (2, 2)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


# --- substrings -------------------------------------------------------------------------------------


def digest(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_substrings_equal_brute_force(spark, small):
    rows = rows_of(spark.read.parquet(f"{small}/documents.parquet"))
    got = digest(queries.op7_substring_dedup(spark, small))
    assert got == brute.removed(rows) and any(n for _, n, _ in got.values())


def test_substrings_on_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 3_000)
    monkeypatch.setattr(substrings, "BATCH_BYTES", 2_000)
    r = random.Random(8)
    passages = [" ".join(f"p{r.randrange(300)}" for _ in range(r.randint(10, 60))) for _ in range(12)]
    rows = [(i, "\n".join(r.choice([r.choice(passages), " ".join(f"u{r.randrange(9999)}" for _ in range(30))]) for _ in range(6))) for i in range(150)]
    assert digest(substrings.repeated(frame(spark, rows))) == brute.removed(rows)


def test_intervals_are_maximal(spark):
    w = [f"a{i}" for i in range(20)]
    rows = [(1, " ".join(w)), (2, "x " + " ".join(w[:15]) + " y z " + " ".join(w[2:18]))]
    got = {r["doc_id"]: [tuple(x) for x in r["intervals"]] for r in substrings.repeated(frame(spark, rows)).collect()}
    assert got == {1: [], 2: [(1, 16), (18, 34)]}


def test_substrings_of_odd_tables(spark, odd, repeated, none):
    named = [x for x in ODD_TEXTS if x[0] is not None]
    got = digest(substrings.repeated(odd.where("doc_id IS NOT NULL")))
    assert got == brute.removed(named) and got[10][1] == len(LONG.split())
    rows = substrings.repeated(repeated).collect()
    assert len(rows) == len(ODD_TEXTS + REPEATED) and all(r["n_removed"] == 0 for r in rows if r["doc_id"] in (None, 1))
    assert substrings.repeated(none).count() == 0


# --- decontamination --------------------------------------------------------------------------------


def test_decontamination_equals_brute_force(spark, small):
    docs, items = rows_of(spark.read.parquet(f"{small}/documents.parquet")), [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in queries.op8_decontamination(spark, small).collect()}
    want = brute.contained(docs, items)
    assert got.keys() == want.keys() and got
    assert all(abs(got[k] - want[k]) < 1e-3 for k in got)


def test_changed_items_are_found(spark):
    r = random.Random(9)
    items = [(k, " ".join(f"q{r.randrange(500)}" for _ in range(n))) for k, n in enumerate((3, 6, 25, 40, 40))]
    docs = []
    for k, text in items:
        w = text.split()
        filler = lambda n: [f"f{r.randrange(5000)}" for _ in range(n)]
        docs.append((10 * k, " ".join(filler(30) + w + filler(30))))
        docs.append((10 * k + 1, " ".join(filler(8) + w[: len(w) // 2] + filler(1) + w[len(w) // 2 :])))
        docs.append((10 * k + 2, " ".join(w[len(w) // 2 :] + w[: len(w) // 2] + filler(3))))
        docs.append((10 * k + 3, " ".join(w[2:] + filler(40))))
        docs.append((10 * k + 4, " ".join(filler(50))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.matches(frame(spark, docs), bench).collect()}
    assert got == brute.contained(docs, items).keys()
    kept = {x["doc_id"] for x in decontaminate.clean(frame(spark, docs), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_blocks_of_items_and_odd_tables(spark, odd, none, monkeypatch):
    bench = spark.createDataFrame([(1, PROSE), (1, PROSE), (2, None), (None, ""), (3, "..."), (None, PROSE + " again and again")], "item_id long, text string")
    want = {(1, 1), (2, 1), (3, 1), (None, 1), (1, None), (2, None), (3, None), (None, None)}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(odd, bench).collect()} == want
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 100)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(odd, bench).collect()} == want
    assert decontaminate.clean(odd, bench).count() == len(ODD_TEXTS) - 4
    assert decontaminate.matches(odd, bench.where("false")).count() == 0 and decontaminate.matches(none, bench).count() == 0
    assert decontaminate.clean(odd, bench).columns == odd.columns


def test_weights_do_not_depend_on_blocks(spark, monkeypatch):
    r = random.Random(12)
    common = [f"c{i}" for i in range(14)]
    items = [(k, " ".join(common + [f"q{k}x{i}" for i in range(20)])) for k in range(12)] + [(50, "three short words"), (51, " ".join(common))]
    docs = []
    for k, text in items[:12]:
        for n in range(6):
            w = text.split()
            for _ in range(n):
                w[r.randrange(len(w))] = f"other{r.randrange(99)}"
            docs.append((10 * k + n, " ".join(["before"] * 3 + w[r.randrange(9) :] + common[: r.randrange(14)] + ["after"] * 5)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contained(docs, items)
    assert 0.75 <= min(want.values()) < 0.8 and len(want) > 12
    for size in (decontaminate.ITEM_BYTES, 500):
        monkeypatch.setattr(decontaminate, "ITEM_BYTES", size)
        got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.matches(frame(spark, docs), bench).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in got)
        assert {x["doc_id"] for x in decontaminate.clean(frame(spark, docs), bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_long_items_take_seconds():
    import time

    r = random.Random(5)
    words = [f"q{r.randrange(9999)}" for _ in range(20_000)]
    began = time.perf_counter()
    (found,) = decontaminate.Finder([(1, " ".join(words))]).find([" ".join(["x"] * 7 + words[:9000] + ["y"] + words[9001:]).encode()])
    assert found[:2] == (0, 0) and found[2] > 0.99 and found[3:] == (7, 20_007) and time.perf_counter() - began < 10


def test_block_index_finds_all_within_the_radius():
    import numpy as np

    r = np.random.default_rng(2)
    prints = r.integers(0, 1 << 63, 500, dtype=np.uint64)
    index = decontaminate.BlockIndex(prints)
    for base in prints[:40]:
        x = int(base)
        for bit in r.choice(64, decontaminate.RADIUS, replace=False).tolist():
            x ^= 1 << bit
        want = np.flatnonzero(np.bitwise_count(prints ^ np.uint64(x)) <= decontaminate.RADIUS)
        assert index.within(x).tolist() == want.tolist()


# --- sharding ---------------------------------------------------------------------------------------


def test_shards_are_compacted_and_versions_stay(spark):
    store = sharding.ShardStore(spark, shard_rows=50, smallest_bytes=1 << 10, fan_in=4)
    for k in range(3):
        store.append(spark.range(k * 200, k * 200 + 200).withColumn("x", F.sha2(F.col("id").cast("string"), 256)))
    before = store.manifest()
    version = store.compact()
    after = store.manifest()
    assert version == after["version"] == before["version"] + 1
    assert len(after["shards"]) < len(before["shards"])
    for v in (before["version"], version):
        assert store.read(v).select("id").orderBy("id").toPandas()["id"].tolist() == list(range(600))
    assert store.read(1).count() == 200
    assert store.vacuum() == 0  # all files are young
    assert store.vacuum(keep_versions=99, older_than_seconds=0) == 0 and store.read(1).count() == 200
    assert store.vacuum(older_than_seconds=0) > 0 and store.read().count() == 600


def test_a_second_writer_of_a_version_conflicts(spark):
    store = sharding.ShardStore(spark)
    base = store.manifest()
    store.append(spark.range(5))
    with pytest.raises(sharding.Conflict):
        store._commit(base, None, [])
    assert store.read().count() == 5


def test_writers_that_lose_try_again(spark, monkeypatch):
    store, other = (sharding.ShardStore(spark, r, shard_rows=10, fan_in=2) for r in [sharding.ShardStore(spark).root] * 2)
    store.append(spark.range(0, 50))
    real, others = store._commit, iter([lambda: other.append(spark.range(50, 60)), lambda: other.compact()])

    def late(*args):
        if step := next(others, None):
            step()
        return real(*args)

    monkeypatch.setattr(store, "_commit", late)
    store.append(spark.range(60, 70))
    store.compact()
    assert sorted(r["id"] for r in store.read().collect()) == list(range(70))


def test_arrivals_of_other_types_are_refused(spark):
    store = sharding.ShardStore(spark)
    store.append(spark.sql("SELECT 1L AS x, array(1) AS y"))
    for other in ("SELECT 'a' AS x, array(1) AS y", "SELECT 1 AS x, array(1) AS y", "SELECT 1L AS x, array('b') AS y", "SELECT array(1) AS y, 1L AS x"):
        with pytest.raises(ValueError):
            store.append(spark.sql(other))
    store.append(spark.sql("SELECT nullif(1L, 1L) AS x, array(nullif(1, 1)) AS y"))
    assert store.read().count() == 2


def test_sharding_query_really_compacts(spark, small, monkeypatch):
    made = []
    real = sharding.ShardStore.__init__
    monkeypatch.setattr(sharding.ShardStore, "__init__", lambda self, *a, **k: (real(self, *a, **k), made.append(self))[0])
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert queries.op1_sharding(spark, small).count() == docs.count()
    (store,) = made
    sizes = [len(store.manifest(v)["shards"]) for v in store.versions()]
    assert any(b < a for a, b in zip(sizes, sizes[1:], strict=False)) and len(store.versions()) > queries.ARRIVALS


def test_shards_of_odd_tables(spark, repeated, none):
    store = sharding.ShardStore(spark)
    store.append(none)
    assert store.read().count() == 0
    store.append(repeated)
    store.compact()
    assert sorted(map(str, store.read().collect())) == sorted(map(str, repeated.collect()))
    with pytest.raises(ValueError):
        store.append(spark.range(1))


def test_sharding_query_runs_no_python(spark, small):
    plan = queries.op1_sharding(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- pipeline ---------------------------------------------------------------------------------------


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = corpus_pipeline.language(spark, docs, small)
    assert first.columns == docs.columns
    assert {r["doc_id"] for r in first.collect()} == {i for i, t in rows_of(docs) if any(c.isalpha() for c in t or "")}
    second = corpus_pipeline.near_copies(spark, docs, small)
    assert {r["doc_id"] for r in second.collect()} == {i for i, (_, c) in brute.groups(rows_of(docs)).items() if i == c}
    third = corpus_pipeline.decontamination(spark, docs, small)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in third.collect()} == {i for i, _ in rows_of(docs)} - {d for d, _ in brute.contained(rows_of(docs), items)}
    fourth = {r["doc_id"]: r for r in corpus_pipeline.secret_scan(spark, docs, small).collect()}
    for r in docs.collect():
        got = fourth[r["doc_id"]]
        assert not brute.base_secrets(got["text"]) and (got["text"] == r["text"] or "[SECRET]" in got["text"] and got["n_chars"] == len(got["text"]))
        if brute.base_secrets(r["text"]):
            assert got["text"] != r["text"]


def test_run_is_the_stages_one_after_the_other(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, small).collect()))


def test_stages_on_odd_tables(spark, repeated, none, small):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select("doc_id", "text", "lang", "source", "n_chars"), small).count() == 0
        assert stage(spark, repeated.select("doc_id", "text", "lang", "source", "n_chars"), small).count() > 5


def test_stages_give_clashing_columns_back(spark, repeated, small):
    more = repeated.withColumns({x: F.concat(F.lit(f"{x} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for x in ("lang_pred", "phrase_rate", "_holds_item", "_known_shingles", "row", "order", "before", "holds", "c0")})
    extra = [x for x in more.columns if x not in ("text", "lang", "n_chars")]
    given = {tuple(r) for r in more.select(*extra).collect()}
    docs = more
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == more.columns
        assert {tuple(r) for r in docs.select(*extra).collect()} <= given and docs.count() > 3


def test_near_copies_are_decided_by_text(spark, small):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    kept = lambda rows: sorted((str(r["doc_id"]), str(r["text"])) for r in corpus_pipeline.near_copies(spark, frame(spark, rows).select(*columns), small).collect())
    assert kept([(1, a), (5, a), (5, b)]) == [("1", a), ("5", b)]
    got = kept([(3, a), (3, a), (None, b), (None, b), (None, c), (2, c), (4, None), (4, "")])
    assert got == sorted([("3", a), ("None", b), ("2", c), ("4", "None"), ("4", "")])


def test_pairs_leave_in_parts_and_counters_grow(spark, monkeypatch):
    rows = copies(3, 64)
    want = brute.groups(rows)
    monkeypatch.setattr(jaccard, "PAIRS", 3)
    monkeypatch.setattr(jaccard, "COUNTED_BYTES", 2_000)
    monkeypatch.setattr(jaccard, "LEAST_COUNTERS", 1 << 13)
    monkeypatch.setattr(jaccard, "EARLY_CELL", 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(frame(spark, rows)).collect()}
    assert got == want


def test_stored_folders_are_cleared(spark):
    from pathlib import Path

    from assaykit.llm import common

    path = common.shared_dir(spark, "mine")
    assert common.stored(spark.range(3), "mine", path).count() == 3
    folder = Path(path.removeprefix("file:")).parent
    assert folder.exists()
    common.delete(spark, path)
    assert folder.exists() and not (folder / path.rsplit("/", 1)[1]).exists()
