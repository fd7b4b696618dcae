"""Spelling variant grouping: words one code point apart, by a symmetric-delete join.

1. Words are counted within tasks first, then by word; only counts travel.
2. Every word emits a key of itself and one of each distinct single deletion: 64-bit hashes with the word's number, 16 bytes however
   long the word. Two words that differ by one code point share exactly one string of this kind. A key's group can't grow with the
   data: its members are one insertion away from it, so the alphabet and the length bound it.
3. Keys are joined with keys; both words are fetched and their distance is computed, so a collision of hashes costs time only.
4. Of each word's near words the most frequent is its form, where it is frequent enough; roots follow by joins of links with
   themselves, each of which doubles the steps. Forms are at least `ratio` times as frequent, so there are no loops and few rounds.

Defined for odd rows: a null text has no words, a null id is the empty string in the hash, repeated rows count each time; words of any
length are compared whole; other columns don't matter; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _ODD, _power_tables, delete, mix, shared_dir, stored

#: What a task holds of counts before it hands them on: words, and their code points together.
HELD_WORDS, HELD_CHARS = 100_000, 4_000_000
#: Code points of words whose keys are made together; one longer word stays whole.
KEY_CHARS = 1 << 17
_LOWER = {c: c + 32 for c in range(65, 91)}


def dropped(doc_id: str, run: str, every: int) -> str:
    """The run without one code point where a hash of id and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run[: (p := h % len(run))] + run[p + 1 :] if h % every == 0 else run


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """word, n: lower-cased runs of letters of at least `shortest` code points that occur `least` times or more.

    every: of the runs of a document, those whose hash with its id this number divides lose a code point; 0 leaves all as they are."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{shortest},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        chars = 0
        hand_on = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                found: Counter[str] = Counter()
                for run, n in Counter(runs.findall(t.as_py() or "")).items():
                    found[run.translate(_LOWER)] += n
                for word, n in found.items():
                    if every:
                        word = dropped(i.as_py() or "", word, every)
                    if len(word) >= shortest:
                        if word not in held:
                            chars += len(word)
                        held[word] += n
                if len(held) > HELD_WORDS or chars > HELD_CHARS:
                    yield hand_on()
                    held.clear()
                    chars = 0
        if held:
            yield hand_on()

    plain = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("string"))
    return plain.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of its distinct single deletions, and the number of the word each is of."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    powers, inverses = _power_tables(len(letters) + 2)
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(mix((letters + np.uint64(1)) * _ODD) * powers[: len(letters)], out=sums[1:])
    length = lambda n: n.astype(np.uint64) * _ODD
    whole = (sums[starts[1:]] - sums[starts[:-1]]) * inverses[starts[:-1]] + length(sizes)
    # of a run of one letter, only the first is deleted: the others give the same string
    first = np.ones(len(letters), bool)
    first[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    s, e = starts[owner[at]], starts[owner[at] + 1]
    less = (sums[at] - sums[s]) * inverses[s] + (sums[e] - sums[at + 1]) * inverses[s + 1] + length(e - s - 1)
    return mix(np.concatenate([whole, less])), np.concatenate([np.arange(len(words)), owner[at]])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, ids = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        at = 0
        while at < len(words):
            to, chars = at + 1, len(words[at])
            while to < len(words) and chars + len(words[to]) <= KEY_CHARS:
                chars += len(words[to])
                to += 1
            keys, owner = keys_of(words[at:to])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[at:to][owner])], names=["key", "id"])
            at = to


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: both ways for each two of the words (word, n) that differ by one code point."""
    named = words.select("word", "n", F.xxhash64("word").alias("id"))
    keys = named.select("word", "id").mapInArrow(_keys, "key long, id long")
    pairs = keys.select("key", F.col("id").alias("a")).join(keys.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b")
    left = named.select(F.col("id").alias("a"), F.col("word").alias("u"), F.col("n").alias("u_n"))
    right = named.select(F.col("id").alias("b"), F.col("word").alias("v"), F.col("n").alias("v_n"))
    found = pairs.join(left, "a").join(right, "b").where(F.levenshtein("u", "v", 1) == 1)
    ways = F.array(*(F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in (("u", "v"), ("v", "u"))))
    return found.select(F.inline(ways))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of links word, form: forms followed to the last. A word leads to one form only, and there are no loops."""
    spark, path = forms.sparkSession, shared_dir(forms.sparkSession, "links")
    links = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "links", path)
    while links.where("moved").limit(1).count():
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        last, path = path, shared_dir(spark, "links")
        links = stored(links.select("word", "root").join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links", path)
        delete(spark, last)
    return links.select("word", "root")


def variants(docs: DataFrame, ratio: int = 10, **how) -> DataFrame:
    """word, form, root, n, n_near, form_n of all counted words; how: as count_words takes it."""
    words = stored(count_words(docs, **how), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))).alias("best"))
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    told = stored(words.join(best, "word", "left").select("word", form["word"].alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-form["less"]).alias("form_n")), "forms")
    ends = roots(told.where("form IS NOT NULL").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
