"""A stated set of queries against all rows, in blocks: nearest vectors and most similar word sets.

Queries are cut into blocks of bounded bytes by a hash of their keys. Each block goes to the tasks that scan the rows; a task keeps the
best k of each query, so what is shuffled is k rows a query and task, however many rows there are, and no row is dealt by a key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.patents import let

#: Bytes of queries that are sent to tasks at once.
BLOCK_BYTES = 8 << 20
#: Rows compared with a block together.
ROWS = 512
#: Queries compared with these at once: ROWS x QUERIES similarities of 8 bytes, and a few copies of them, are what a task holds.
QUERIES = 1_024


def _blocks(queries: DataFrame, key: str, size: Column, block_bytes: int) -> Iterator[list]:
    """Queries as lists of rows, one block after the other: a hash deals them, so a block is about as large as asked for. Lazily collected."""
    n, most = queries.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    count = max(1, math.ceil(n / max(1, block_bytes)))
    for b in range(count):
        rows = queries.where(F.pmod(F.xxhash64(key), F.lit(count)) == b).collect() if count > 1 else queries.collect()
        if rows:
            yield rows


def _best(sims: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each column of sims, ties to the smaller key."""
    by_key = np.argsort(keys, axis=0, kind="stable")
    sims, keys = np.take_along_axis(sims, by_key, 0), np.take_along_axis(keys, by_key, 0)
    top = np.argsort(-sims, axis=0, kind="stable")[:k]
    return np.take_along_axis(sims, top, 0), np.take_along_axis(keys, top, 0)


def _scan(rows: list, k: int, places: int, grouped: bool):
    ids = np.array([r["q"] for r in rows], np.int64)
    groups = [r["g"] for r in rows]
    vectors = [np.asarray(r["v"] if r["v"] is not None else (), np.float64) for r in rows]
    lengths = np.array([len(v) for v in vectors])

    def unit(m: np.ndarray) -> np.ndarray:
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    of_length = {n: (np.flatnonzero(lengths == n), unit(np.array([v for v in vectors if len(v) == n]))) for n in set(lengths.tolist()) - {0}}
    known = {g: i for i, g in enumerate(dict.fromkeys(groups))}
    wanted = np.array([known[g] for g in groups])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {lo: (np.full((0, n), -np.inf), np.zeros((0, n), np.int64)) for lo in range(0, len(ids), QUERIES) for n in [min(QUERIES, len(ids) - lo)]}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                keys = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                vs = [np.asarray(v if v is not None else (), np.float64) for v in part.column(1).to_pylist()]
                size = np.array([len(v) for v in vs])
                units = [(own, unit(np.array([vs[i] for i in own])), columns, matrix) for n, (columns, matrix) in of_length.items() if len(own := np.flatnonzero(size == n))]
                codes = np.array([known.get(g, -1) for g in part.column(2).to_pylist()]) if grouped else None
                for lo in range(0, len(ids), QUERIES):  # a slice of queries at a time: what a task holds doesn't grow with the block
                    some = slice(lo, min(lo + QUERIES, len(ids)))
                    sims = np.zeros((len(keys), some.stop - lo))
                    for own, rows_, columns, matrix in units:
                        first, last = np.searchsorted(columns, (lo, some.stop))
                        sims[np.ix_(own, columns[first:last] - lo)] = np.round(rows_ @ matrix[first:last].T, places) + 0.0  # no negative zeros
                    sims[keys[:, None] == ids[None, some]] = -np.inf
                    if grouped:
                        sims[codes[:, None] != wanted[None, some]] = -np.inf
                    best[lo] = _best(np.concatenate([best[lo][0], sims]), np.concatenate([best[lo][1], np.repeat(keys[:, None], some.stop - lo, axis=1)]), k)
        for lo, (top, matches) in best.items():
            there = np.isfinite(top)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[lo : lo + QUERIES], there.shape)[there]), pa.array(matches[there]), pa.array(top[there])], names=["query", "match", "similarity"])

    return run


def nearest(df: DataFrame, queries: DataFrame, *, vector: str, key: str, k: int, by: str | None = None, places: int = 4, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query, match, similarity, rank: the k rows with the largest cosine to each query, ties to the smaller key; a row isn't its own match.

    key is an integer and not null. by: only rows of the query's group are compared; a null group has no rows. Null and empty vectors, unequal lengths and zero norms have similarity 0."""
    group = F.col(by).cast("string") if by else F.lit("")
    rows = df.where(group.isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("m"), F.col(vector).cast("array<double>").alias("v"), group.alias("g"))
    asked = queries.where(group.isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"), group.alias("g"))
    size = F.coalesce(F.size("v"), F.lit(0)) * 8 + 64
    parts = [rows.mapInArrow(_scan(block, k, places, by is not None), "query long, match long, similarity double") for block in _blocks(asked, "q", size, block_bytes)]
    every = reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], "query long, match long, similarity double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "match"))
    return every.withColumn("rank", place).where(F.col("rank") <= k)


def most_alike(df: DataFrame, key: str, words: Column, queries: DataFrame, query: str, query_words: Column, *, k: int, places: int = 4, block_bytes: int = 1 << 20) -> DataFrame:
    """query, key, similarity, rank: the k rows whose word sets have the largest Jaccard similarity to each query's, above 0, ties to the smaller key.

    Sets of a block of queries are constants; each row meets them where it is read, and tasks keep k a query before anything is shuffled."""
    asked = queries.select(F.col(query).alias("q"), query_words.alias("w")).where(F.size("w") > 0)
    def compared(sets: list[Column]):
        def of(own: Column) -> Column:
            def one(s: Column) -> Column:
                shared = F.size(F.array_intersect(own, s["w"]))
                return F.struct(s["q"].alias("q"), shared.alias("n"), (F.size(own) + F.size(s["w"]) - shared).alias("all"))

            return F.filter(F.transform(F.array(*sets), one), lambda x: x["n"] > 0)

        return of

    parts = []
    for block in _blocks(asked, "q", F.aggregate("w", F.lit(0), lambda n, x: n + F.length(x) + 16), block_bytes):
        sets = [F.struct(F.lit(r["q"]).alias("q"), F.array(*map(F.lit, r["w"])).alias("w")) for r in block]
        hits = df.select(F.col(key), F.explode(let(words, compared(sets))).alias("h"))
        scored = hits.select(F.col("h.q").alias(query), key, F.round(F.col("h.n") / F.col("h.all"), places).alias("similarity"))
        place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("similarity"), key))
        parts.append(scored.withColumn("rank", place).where(F.col("rank") <= k))
    if not parts:
        kind = dict(queries.dtypes)[query], dict(df.dtypes)[key]
        return df.sparkSession.createDataFrame([], f"{query} {kind[0]}, {key} {kind[1]}, similarity double, rank int")
    return reduce(DataFrame.unionByName, parts)
