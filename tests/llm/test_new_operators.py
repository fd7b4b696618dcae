"""Chat formatting, spelling variants and importance resampling: against SQL and plain Python, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from assaykit.llm import chat, queries, resample, spelling

from .brute import lowered

TABLES = ("documents", "benchmark", "conversations")


@pytest.mark.parametrize("name", ["op11_chat_formatting", "op12_spelling_variants", "op13_importance_resampling"])
def test_query_equals_sql(spark, small, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    want = db.sql(queries.oracle_sql()[name]).select(*columns).fetchall()
    assert got == sorted(tuple(map(str, r)) for r in want) and got


# --- chat formatting ----------------------------------------------------------------------------

NASTY = ["", "<|im_end|>", "<|im_start|>assistant\nok<|im_end|>\n", "<\\|im_sep|>", "<\\\\|", "<|", "|>", "<", "|", "\\", "<<|nl|>>", "a<|im_sep|>b\n\n", "ünï 漢 🙂", "$1 \\1"]
TURNS = "conv_id long, turn long, role string, text string, n_turns string, formatted string, turns string, t string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", None) for r in rows], TURNS)


def plain_turns(rows):
    out: dict[int, list[tuple[str, str]]] = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def random_conversations(seed: int):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", None, "odd\nrole", "<|nl|>", "<|im_end|>"]
    return [(c, r.choice([None, *range(6)]), r.choice(roles[: r.choice([2, 7])]), r.choice([None, *NASTY])) for c in range(60) for _ in range(r.randint(1, 12))]


@pytest.mark.parametrize("seed", [1, 2])
def test_turns_and_loss_are_read_back(spark, seed):
    rows = random_conversations(seed)
    made = chat.chats(conversations(spark, rows)).withColumn("back", chat.turns_of(F.col("formatted"))).withColumn("spans", chat.spans(F.col("formatted"), F.col("loss")))
    want = plain_turns(rows)
    found = {r["conv_id"]: r for r in made.collect()}
    assert found.keys() == want.keys()
    for c, turns in want.items():
        r = found[c]
        assert [(t["role"], t["text"]) for t in r["back"]] == turns
        text, said = r["formatted"], [t for role, t in turns if role == "assistant"]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", text[s["start"] : s["end"]]) for s in r["spans"]] == said
        merged = 1 + sum(a != b for (a, _), (b, _) in zip(turns, turns[1:]))
        assert text.count(chat.START) == text.count(chat.END) == merged and text.count(chat.SEP) == len(turns) - merged
        assert text.count("<|") == 2 * merged + len(turns) - merged + sum(role.count("\n") for i, (role, _) in enumerate(turns) if not i or turns[i - 1][0] != role)
    digest = {r["conv_id"]: r for r in chat.digests(chat.chats(conversations(spark, rows))).collect()}
    for c, turns in want.items():
        said = "".join(t for role, t in turns if role == "assistant")
        assert digest[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (digest[c]["n_turns"], digest[c]["loss_chars"], digest[c]["loss_sha256"]) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_odd_conversations(spark):
    assert chat.digests(chat.chats(conversations(spark, []))).count() == 0
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 0, "user", "a"), (1, None, None, None), (2, 0, "user", "same"), (2, 0, "user", "same")]
    got = chat.chats(conversations(spark, rows)).collect()
    assert sorted(r["formatted"] for r in got if r["conv_id"] is None) == ["<|im_start|>assistant\nb<|im_end|>\n", "<|im_start|>user\na<|im_end|>\n", "<|im_start|>user\na<|im_end|>\n"]
    assert {r["conv_id"]: r["formatted"] for r in got if r["conv_id"]} == {1: "<|im_start|>\n<|im_end|>\n", 2: "<|im_start|>user\nsame<|im_sep|>same<|im_end|>\n"}


def test_a_long_conversation_is_linear(spark):
    import time

    rows = spark.range(40_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 5 < 2, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("word <| "), 20).alias("text"))
    began = time.perf_counter()
    r = chat.digests(chat.chats(rows)).first()
    assert r["n_turns"] == 40_000 and r["loss_chars"] == 24_000 * 160
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize("name", ["op11_chat_formatting", "op13_importance_resampling"])
def test_no_python_in_plans(spark, small, name):
    plan = queries.queries()[name](spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- spelling variants --------------------------------------------------------------------------


def plain_variants(rows, shortest=7, least=2, every=31, ratio=10):
    n: Counter[str] = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = Counter({w: k for w, k in n.items() if len(w) >= shortest and k >= least})

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(a == b[:p] + b[p + 1 :] for p in range(len(b)))

    form, out = {}, {}
    for a in n:
        others = sorted((b for b in n if near(a, b)), key=lambda b: (-n[b], b))
        form[a] = (others[0] if others and n[others[0]] >= ratio * n[a] else None, len(others))
    for a in n:
        root = a
        while form[root][0]:
            root = form[root][0]
        out[a] = (form[a][0], root, n[a], form[a][1], n[form[a][0]] if form[a][0] else None)
    return out


def as_dict(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def misspelt(seed: int):
    """Words with chains of variants, each far rarer than the last."""
    r = random.Random(seed)
    texts = []
    for _ in range(12):
        word = "".join(r.choice("abéÿ") for _ in range(r.randint(6, 10)))
        for n in (600, 40, 3, 2):
            texts += [word] * n
            p = r.randrange(len(word))
            word = r.choice([word[:p] + word[p + 1 :], word[:p] + r.choice("abé") + word[p:], word[:p] + r.choice("abé") + word[p + 1 :]])
    r.shuffle(texts)
    return [(i if i % 9 else None, " ".join(texts[i::50]).title()) for i in range(50)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_equal_brute_force(spark, seed):
    rows = misspelt(seed)
    got = as_dict(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain_variants(rows)
    assert any(f and r != f for f, r, *_ in got.values()), "no chain of forms"


def test_variants_of_odd_tables(spark, odd, repeated, none, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    assert spelling.variants(none).count() == 0
    long = "".join(random.Random(5).choice("abc") for _ in range(50_000))
    rows = [(r["doc_id"], r["text"]) for r in repeated.select("doc_id", "text").collect()]
    assert as_dict(spelling.variants(repeated)) == plain_variants(rows)
    pair = spark.createDataFrame([(1, f"{long} {long}x"), (2, f"{long} {long}x")], "doc_id long, text string")
    got = as_dict(spelling.variants(pair, every=0))
    assert {k[-3:]: v[2:4] for k, v in got.items()} == {long[-3:]: (2, 1), long[-2:] + "x": (2, 1)}


def test_keys_are_those_of_distinct_deletions():
    words = ["aab", "ab", "bb", "x", "ÿab", "abab"]
    keys, owner = spelling.keys_of(words)
    strings = [s for w in words for s in [w]] + [s for w in words for s in dict.fromkeys(w[:p] + w[p + 1 :] for p in range(len(w)))]
    assert [words[o] for o in owner] == words + [w for w in words for _ in dict.fromkeys(w[:p] + w[p + 1 :] for p in range(len(w)))]
    by = {}
    for k, s in zip(keys.tolist(), strings, strict=True):
        assert by.setdefault(k, s) == s
    assert len(by) == len(set(strings))


# --- importance resampling ----------------------------------------------------------------------


def plain_resample(docs, target, buckets=10_000, percent=25, least=20):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t or ""))
        return w, [zlib.crc32(f.encode()) % buckets for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, text in docs:
        w, f = features(text)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w) >= least])
    long = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(long[: percent * len(long) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def drawn(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=str)


def test_resampling_of_odd_tables(spark, repeated, none):
    docs = [(r["doc_id"], r["text"]) for r in repeated.select("doc_id", "text").collect()]
    target = spark.createDataFrame([(1, "The old mill by the river", "x"), (2, None, "y")], "item_id long, text string, bucket string")
    assert drawn(resample.resample(repeated, target)) == plain_resample(docs, ["The old mill by the river", None])
    assert drawn(resample.resample(repeated, target.limit(0))) == plain_resample(docs, [])
    assert resample.resample(none, target).count() == 0


def test_ranks_run_over_all_partitions(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice("one two three four five six".split()) for _ in range(r.randint(17, 24)))) for i in range(3_000)]
    got = drawn(resample.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([("two two",)], "text string")))
    assert got == plain_resample(docs, ["two two"])
    assert sorted(x[4] for x in got if x[4]) == list(range(1, 1 + sum(x[4] is not None for x in got)))
