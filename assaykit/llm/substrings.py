"""Substring deduplication: Rabin-Karp hashes of every window of WINDOW words, joined in Spark.

A word is removed if a window over it also starts in a document with a smaller id; windows are judged on the
input. Repeated windows merge into maximal removal intervals.

1. Each task hashes the windows of a batch of documents at a time. A window that a smaller document of the same batch
   has too is answered at once: its bit goes straight to the document's home, and nothing of it to a bucket. So a window that millions of
   documents share is in its bucket once for each batch, whatever the documents. The hashes of the others are packed by bucket.
2. Each bucket of hashes finds the smallest document of each window and answers with a bit for each window, packed by
   homes: groups of documents by a hash of id and text.
3. In each home, documents meet their bits, recompute the windows, and merge them. Rows with equal ids and texts share a
   home and are told apart by the batch that they were hashed in.

Buckets hold about BUCKET_BYTES of text each and homes HOME_BYTES, at any size of input. Hashes have as many bytes as keep the chance of any
false match in the whole input below 1 in 64 (7 for 1 GB, 10 for 100 TB); words themselves are not compared.

Null texts have no words. Documents with null ids keep all words and take none from others. Rows with equal ids don't take
words from each other. Texts with fewer words than a window stay whole.
Ids must be numbers, or texts of numbers. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix, slices, utf8, windows_of, words_of

WINDOW = 13
#: Text that one bucket's hashes come from, that one batch of a task holds, and that meets its answers in one home.
BUCKET_BYTES, BATCH_BYTES, HOME_BYTES = 8 << 20, 4 << 20, 4 << 20

_SECOND = np.uint64(0xA0761D6478BD642F)


def _keys(texts: list[bytes], window: int, buckets: int) -> tuple[np.ndarray, ...]:
    """Of each window its hash, its bucket, its text, and its first word's index in the whole batch; then of each word its text and its place."""
    hashes, owner, starts, ends = words_of(texts)
    grams, at = windows_of(hashes, owner, window)
    bucket = ((mix(grams ^ _SECOND) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return grams, bucket.astype(np.int64), owner[at], at, hashes, owner, starts, ends


def _wide(grams: np.ndarray, hashes: np.ndarray, owner: np.ndarray, window: int, width: int) -> np.ndarray:
    """Hashes of width bytes: those beyond 8 come from a second, independent hash of the same words."""
    out = grams.astype("<u8").view(np.uint8).reshape(-1, 8)
    if width <= 8:
        return np.ascontiguousarray(out[:, :width])
    second = windows_of(mix(hashes ^ _SECOND), owner, window)[0]
    return np.ascontiguousarray(np.concatenate([out, second.astype("<u8").view(np.uint8).reshape(-1, 8)], axis=1)[:, :width])


def _narrow(data: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    full = np.zeros((len(data) // width, 8 if width <= 8 else 16), np.uint8)
    full[:, :width] = data.reshape(-1, width)
    return tuple(full.view("<u8").T)


def _order(keys: tuple[np.ndarray, ...], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries by key, then rank; and where a new key starts."""
    order = np.lexsort((rank, *keys))
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        s = k[order]
        fresh[1:] |= s[1:] != s[:-1]
    return order, fresh


def _marked(keys: tuple[np.ndarray, ...], rank: np.ndarray) -> np.ndarray:
    """True for entries whose key also occurs with a smaller rank."""
    if not len(rank):
        return np.zeros(0, bool)
    order, fresh = _order(keys, rank)
    ranks = rank[order]
    least = ranks[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    out = np.empty(len(order), bool)
    out[order] = ranks > least
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Ids, text keys and texts of about BATCH_BYTES at a time, by id."""
    ids, keys, texts, size = [], [], [], 0
    for batch in batches:
        for part in slices(batch):
            for i, k, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2)), strict=True):
                ids.append(i), keys.append(k), texts.append(x)
                size += len(x)
                if size >= BATCH_BYTES:
                    yield _by_id(ids, keys, texts)
                    ids, keys, texts, size = [], [], [], 0
    if ids:
        yield _by_id(ids, keys, texts)


def _by_id(ids: list[int], keys: list[int], texts: list[bytes]):
    order = sorted(range(len(ids)), key=lambda i: (ids[i], keys[i]))
    return np.array([ids[i] for i in order], np.int64), np.array([keys[i] for i in order], np.int64), [texts[i] for i in order]


_HEAD = [("id", "<i8"), ("key", "<i8"), ("n", "<u4")]
_PACKED = "bucket long, batch long, docs binary, data binary"


def _home(keys: np.ndarray, homes: int) -> np.ndarray:
    return (((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(homes)) >> np.uint64(32)).astype(np.int64)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where equal neighbours start and end."""
    edges = np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values)) if len(values) else np.zeros(1, np.int64)
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _hash_windows(window: int, buckets: int, homes: int, width: int):
    """Rows of buckets (documents' heads and their open windows' hashes) and, numbered from -1 down, of homes (heads and bits of the windows that the batch answers)."""

    def of_homes(ids, keys, doc, known):
        total = np.bincount(doc, minlength=len(ids))
        ends = np.cumsum(total)
        some = np.unique(doc[known])
        some = some[np.argsort(_home(keys[some], homes), kind="stable")]
        for a, b in _runs(_home(keys[some], homes)):
            own = some[a:b]
            head = np.empty(len(own), _HEAD)
            head["id"], head["key"], head["n"] = ids[own], keys[own], total[own]
            yield -1 - int(_home(keys[own[:1]], homes)[0]), head.tobytes(), b"".join(np.packbits(known[ends[i] - total[i] : ends[i]]).tobytes() for i in own.tolist())

    def of_buckets(ids, keys, doc, known, bucket, wide):
        open_ = np.flatnonzero(~known)
        open_ = open_[np.argsort(bucket[open_].astype(np.uint32), kind="stable")]
        for a, b in _runs(bucket[open_]):
            at = open_[a:b]
            of, counts = np.unique(doc[at], return_counts=True)
            head = np.empty(len(of), _HEAD)
            head["id"], head["key"], head["n"] = ids[of], keys[of], counts
            yield int(bucket[at[0]]), head.tobytes(), wide[at].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, texts in _texts(batches):
            grams, bucket, doc, _, hashes, owner, _, _ = _keys(texts, window, buckets)
            if not len(grams):
                continue
            name = int(np.sum(mix(keys.view(np.uint64)), dtype=np.uint64).view(np.int64))  # the batch, by what is in it
            rank = np.unique(ids, return_inverse=True)[1]  # rows with equal ids rank alike
            wide = _wide(grams, hashes, owner, window, width)
            known = _marked((grams,) if width <= 8 else (grams, _narrow(wide.ravel(), width)[1]), rank[doc])
            rows = [*of_homes(ids, keys, doc, known), *of_buckets(ids, keys, doc, known, bucket, wide)]
            for i in range(0, len(rows), 64):
                places, docs, data = zip(*rows[i : i + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([name] * len(docs), pa.int64()), pa.array(docs, pa.binary()), pa.array(data, pa.binary())], names=["bucket", "batch", "docs", "data"])

    return run


_ANSWERS = "home long, bucket long, keys binary, batches binary, counts binary, bits binary"


def _judge_bucket(width: int, homes: int):
    def answers(rows) -> pa.Table:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.table({c: pa.array(x, pa.int64() if i < 2 else pa.binary()) for i, (c, x) in enumerate(zip(("home", "bucket", "keys", "batches", "counts", "bits"), columns, strict=True))})

    def run(key, table):
        place = key[0].as_py()
        heads = [np.frombuffer(x, _HEAD) for x in table.column("docs").to_pylist()]
        batches, data = table.column("batch").to_numpy(), table.column("data").to_pylist()
        if place < 0:  # answered already
            return answers([(-1 - place, -1, h["key"].tobytes(), np.full(len(h), b).tobytes(), h["n"].tobytes(), x) for h, b, x in zip(heads, batches, data, strict=True)])
        batch, head = np.repeat(batches, list(map(len, heads))), np.concatenate(heads)
        bits = _marked(_narrow(np.frombuffer(b"".join(data), np.uint8), width), np.repeat(head["id"], head["n"]))
        ends = np.cumsum(head["n"], dtype=np.int64)
        some = np.flatnonzero(np.add.reduceat(bits, ends - head["n"], dtype=np.int64) > 0) if len(bits) else np.zeros(0, np.int64)
        some = some[np.argsort(_home(head["key"][some], homes), kind="stable")]
        rows = []
        for a, b in _runs(_home(head["key"][some], homes)):
            own = some[a:b]
            packed = b"".join(np.packbits(bits[ends[i] - head["n"][i] : ends[i]]).tobytes() for i in own.tolist())
            rows.append((int(_home(head["key"][own[:1]], homes)[0]), place, head["key"][own].tobytes(), batch[own].tobytes(), head["n"][own].tobytes(), packed))
        return answers(rows)

    return run


def _answers(table: pa.Table) -> dict[int, dict[int, dict[int, bytes]]]:
    """By text key, by batch, by bucket (-1: answered in the batch): packed bits."""
    out: dict[int, dict[int, dict[int, bytes]]] = {}
    for bucket, keys, batches, counts, bits in zip(*(table.column(c).to_pylist() for c in ("bucket", "keys", "batches", "counts", "bits")), strict=True):
        at = 0
        for key, batch, n in zip(np.frombuffer(keys, "<i8").tolist(), np.frombuffer(batches, "<i8").tolist(), np.frombuffer(counts, "<u4").tolist(), strict=True):
            size = -(-n // 8)
            out.setdefault(key, {}).setdefault(batch, {})[bucket] = bits[at : at + size]
            at += size
    return out


def repeated(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """df's ids and texts with intervals: maximal runs of words [first, end) to remove, and keep: the words' number."""
    import pyspark.sql.types as T

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(doc_id).cast("long").alias("_id")).withColumn("_key", F.xxhash64("_id", "text"))
    size = max(1, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    buckets, homes = -(-size // BUCKET_BYTES), -(-size // HOME_BYTES)
    width = min(16, max(5, math.ceil((2 * math.log2(size) + 3 - math.log2(buckets)) / 8)))  # words have two bytes or more: size / 2 windows at most
    named = rows.where("_id IS NOT NULL AND text IS NOT NULL")
    packed = named.select("_id", "_key", "text").mapInArrow(_hash_windows(window, buckets, homes, width), _PACKED)
    judged = packed.groupBy("bucket").applyInArrow(_judge_bucket(width, homes), _ANSWERS)
    interval = T.StructType([T.StructField("first", T.LongType(), False), T.StructField("end", T.LongType(), False)])
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("text", T.StringType()), T.StructField("intervals", T.ArrayType(interval, False)), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())])

    def merged(ids: pa.ChunkedArray | pa.Array, texts: pa.ChunkedArray | pa.Array, marks: Iterator) -> list:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = [_merge(x, m, window, buckets) for x, m in zip(utf8(texts), marks, strict=True)]
        forms = list(to_arrow_schema(schema))[2:]
        columns = zip(*out, strict=True) if out else [[]] * len(forms)
        return [ids, texts, *(pa.array(c, f.type) for c, f in zip(columns, forms, strict=True))]

    def at_home(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = _answers(right)
        return pa.table(merged(left.column("doc_id"), left.column("text"), (answers.get(k) for k in left.column("_key").to_pylist())), names=schema.names)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(merged(part.column(0), part.column(1), (None for _ in range(part.num_rows))), names=schema.names)

    home = F.shiftright(F.shiftrightunsigned("_key", 32) * F.lit(homes).cast("long"), 32)
    texts = named.select("doc_id", "text", "_key", home.alias("home"))
    known = texts.groupBy("home").cogroup(judged.groupBy("home")).applyInArrow(at_home, schema)
    return known.unionByName(rows.where("_id IS NULL OR text IS NULL").select("doc_id", "text").mapInArrow(alone, schema))


def _merge(text: bytes, marks: dict[int, dict[int, bytes]] | None, window: int, buckets: int):
    words = text.split()
    n = len(words)
    intervals, kept = [], words
    if marks:
        grams, bucket, _, at, *_ = _keys([text], window, buckets)
        bits = np.zeros(len(grams), bool)
        unpacked = lambda packed, n: np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
        for of in marks.values():  # one batch, but for repeated rows
            known = unpacked(of[-1], len(grams)) if -1 in of else np.zeros(len(grams), bool)
            bits |= known
            order = np.flatnonzero(~known)
            order = order[np.argsort(bucket[order], kind="stable")]
            rest = sorted(set(of) - {-1})
            firsts, lasts = np.searchsorted(bucket[order], rest), np.searchsorted(bucket[order], rest, side="right")
            for k, a, b in zip(rest, firsts.tolist(), lasts.tolist(), strict=True):
                bits[order[a:b]] |= unpacked(of[k], b - a)
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, at[bits], 1)
        np.add.at(change, at[bits] + window, -1)
        covered = np.cumsum(change[:-1]) > 0
        edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
        intervals = [{"first": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]
        kept, last = [], 0
        for x in intervals:
            kept += words[last : x["first"]]
            last = x["end"]
        kept += words[last:]
    joined = b" ".join(kept)
    return intervals, n, n - len(kept), joined.decode(), hashlib.sha256(joined).hexdigest()
