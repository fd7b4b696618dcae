"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.75 or more, and their groups.

Exact, without pairs of all copies and without caps:

1. Documents with the same set are one from here on, under the smallest id.
2. Near copies are merged early: documents that share MinHash values meet the one of them whose values most documents share (the
   likeliest centre of a family), and pairs with 0.75 or more, by their full sets, are links. What is still apart then, one document
   for each group, does so once more. This only spares later work; it decides nothing else.
3. Multiple-global-order filtering: under any order of all shingles, two documents that link share one of the first
   n - ceil(0.75 n) + 1 of each. ORDERS orders are used, all rare before frequent by a table of hashed counts that grows with the
   input up to MOST_COUNTERS (which only decides speed), then each by a hash of its own. Groups of step 2 that share such a shingle under every order, with fitting lengths and places, are candidates; the
   orders' pairs of groups are intersected. A shingle of more than FREQUENT groups is set aside, and these meet again with sketches of
   their sets: bits that differ are a lower bound of shingles that differ, so most pairs of a large family whose members are too far
   from each other aren't made at all. An entry of a shingle has what it needs in itself, so it costs as much however many buckets
   there are.
4. Candidates are verified by full sets: the larger group's members in blocks, each against the members of all
   groups paired with it, in cells of about two times CELL documents, fewer where documents are long.
5. Groups are the connected components of all links.

Rows: null and empty texts have no shingles and link with nothing; so do rows with null ids. Rows with equal ids are one
node. Words are [^\\x20\\x09-\\x0D]+ with A-Z lowered; a text with fewer than five words has its whole sequence as its
one shingle. Sets are compared by 64-bit shingle hashes. Ids must be numbers, or texts of numbers. Columns other than
the id and the text are not looked at, whatever their names; the result has neither.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import byte_batches, delete, mix, shared_dir, stored, thrifty, utf8, windows_of, words_of
from .components import components

K, ORDERS, KEYS = 5, 3, 8
#: Documents on each side of a cell; members that meet a leader in one cell; text for one bucket of prefixes; pairs of a bucket that leave it together.
CELL, EARLY_CELL, BUCKET_BYTES, PAIRS = 128, 64, 32 << 20, 1 << 20
#: Shingles of a document of which cells hold CELL; a larger one counts as several, so cells are bounded by what they hold.
UNIT = 8_192
#: Rows of a MinHash value that meet its leader together; a value that more documents have is dealt to several tasks.
SLICE = 1_024
#: Counters of shingles: one for each KiB of text between these bounds; they travel in chunks.
LEAST_COUNTERS, MOST_COUNTERS, CHUNK = 1 << 18, 1 << 23, 4096
#: Text whose counters are summed in one group before the groups are summed.
COUNTED_BYTES = 8 << 30
#: Bits of a set's sketch, and the groups that may share a shingle before their sketches are asked: so many make few pairs.
SKETCH_BITS, FREQUENT = 1024, 32
#: Bits of the filter that tells which texts a join needs: a bound for what is broadcast; more ids only make it pass more.
FILTER_BITS = 1 << 24

_KEY_SEEDS = mix(np.arange(101, 101 + KEYS, dtype=np.uint64))
_ORDER_SEEDS = mix(np.arange(201, 201 + ORDERS, dtype=np.uint64))
_COUNTER_SEED = mix(np.arange(301, 302, dtype=np.uint64))[0]
_SKETCH_SEED = mix(np.arange(401, 402, dtype=np.uint64))[0]


def sets_of(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for lo, hi in byte_batches(texts):
        hashes, owner, _, _ = words_of(texts[lo:hi], lower=True)
        grams, at = windows_of(hashes, owner, K)
        edges = np.searchsorted(owner[at], np.arange(hi - lo + 1))
        words = np.searchsorted(owner, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            a, b = edges[i], edges[i + 1]
            n = words[i + 1] - words[i]
            if b > a or not n:
                out.append(np.unique(grams[a:b]))
            else:
                out.append(windows_of(hashes[words[i] : words[i + 1]], np.zeros(n, np.int64), int(n))[0])
    return out


def similar(shared: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    return 100 * shared >= 75 * (n + m - shared)


def _counter(tokens: np.ndarray, counters: int) -> np.ndarray:
    return (mix(tokens ^ _COUNTER_SEED) & np.uint64(counters - 1)).astype(np.uint32)


# --- step 1: one row for each document, and the counters of each task ----------------------------------

_FEATURES = "id long, n long, s1 long, s2 long, keys array<long>, sketch array<long>, chunk int, salt int, counts binary"


def _features(counters: int = 0, salts: int = 1):
    """Rows of (id, text) to their features; with counters, each task adds its own in chunks that hold any."""

    def batch_of(size, **columns):
        kinds = {"id": pa.int64(), "n": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "keys": pa.list_(pa.int64()), "sketch": pa.list_(pa.int64()), "chunk": pa.int32(), "salt": pa.int32(), "counts": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * size), t) for c, t in kinds.items()], names=list(kinds))

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, waiting, held = np.zeros(counters, np.uint32), [], 0

        def add():
            if waiting:
                np.add(total, np.bincount(np.concatenate(waiting), minlength=counters), out=total, casting="unsafe")
                waiting.clear()

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = sets_of(utf8(part.column(1)))
                n, s1, s2, keys, sketch = [], [], [], [], []
                for s in sets:
                    n.append(len(s))
                    mixed = mix(s)
                    s1.append(int(mixed.sum(dtype=np.uint64).view(np.int64)))
                    s2.append(int(mix(mixed).sum(dtype=np.uint64).view(np.int64)))
                    keys.append([int(mix(s ^ seed).min().view(np.int64)) for seed in _KEY_SEEDS] if len(s) else [])
                    sketch.append(sketch_of(s).tolist())
                if counters:
                    waiting.append(_counter(np.concatenate(sets), counters))
                    held += len(waiting[-1])
                    if held >= 1 << 20:
                        add()
                        held = 0
                yield batch_of(len(sets), id=part.column(0), n=n, s1=s1, s2=s2, keys=keys, sketch=sketch)
        add()
        chunks = total.reshape(-1, CHUNK)
        some = np.flatnonzero(chunks.any(axis=1)).tolist()
        salt = TaskContext.get().partitionId() % salts
        for i in range(0, len(some), 64):
            own = some[i : i + 64]
            yield batch_of(len(own), chunk=own, salt=[salt] * len(own), counts=[_packed_counts(chunks[k]) for k in own])

    return run


def _packed_counts(counts: np.ndarray) -> bytes:
    """In the fewest bytes that hold the largest: most tasks count less than 256 of a shingle."""
    return counts.astype(f"<u{next(k for k in (1, 2, 4, 8) if int(counts.max()) < 256**k)}").tobytes()


def _sum_counts(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CHUNK, np.int64)
    for batch in batches:
        for x in batch.column("counts").to_pylist():
            total += np.frombuffer(x, f"<u{len(x) // CHUNK}").astype(np.int64)
    yield pa.RecordBatch.from_pydict({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([_packed_counts(total)], pa.binary())})


def _levels(rows: DataFrame, counters: int, salts: int) -> np.ndarray:
    """The binary logarithm of each counter: a byte each on the driver."""
    if salts > 1:
        rows = rows.groupBy("chunk", "salt").applyInArrow(_sum_counts, "chunk int, counts binary")

    def level(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sum_counts(key, batches):
            packed = batch.column("counts")[0].as_py()
            counts = np.frombuffer(packed, f"<u{len(packed) // CHUNK}")
            yield pa.RecordBatch.from_pydict({"chunk": batch.column("chunk"), "levels": pa.array([np.log2(counts + 1.0).astype(np.uint8).tobytes()], pa.binary())})

    levels = np.zeros(counters, np.uint8)
    for r in rows.groupBy("chunk").applyInArrow(level, "chunk int, levels binary").collect():
        levels[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["levels"]), np.uint8)
    return levels


# --- joins with texts -----------------------------------------------------------------------------------


def _place(column: str):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def _filter(ids: DataFrame) -> DataFrame:
    """A bit for each id's place, 64 of them a row: at most FILTER_BITS / 64 rows."""
    return ids.select(_place("id").alias("p")).groupBy(F.shiftright("p", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("_bits"))


def _passing(texts: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts whose ids may be in the filter, and those whose ids are not."""
    marked = texts.withColumn("_word", F.shiftright(_place("id"), 6)).join(F.broadcast(kept), "_word", "left")
    hit = F.coalesce(F.expr(f"(_bits & shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_BITS}L) % 64 as int))) != 0"), F.lit(False))
    return marked.where(hit).drop("_word", "_bits"), marked.where(~hit).drop("_word", "_bits")


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is none of the ids; only rows that the filter can't tell from these travel."""
    some, others = _passing(rows, _filter(ids))
    return others.unionByName(some.join(ids, "id", "left_anti"))


@thrifty
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (big, cell, side, id, text) by cell, then side: links of left documents with right ones; a left one needs one link a cell."""

    def links(rows):
        left = [(i, s) for (side, i), s in rows.items() if side == 0]
        right = [(i, s) for (side, i), s in rows.items() if side == 1]
        if not left or not right:
            return
        sizes = np.array([len(s) for _, s in right])
        tokens = np.concatenate([s for _, s in right])
        owner = np.repeat(np.arange(len(right)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        for i, s in left:
            lo, hi = np.searchsorted(tokens, s), np.searchsorted(tokens, s, side="right")
            n = hi - lo
            spots = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            shared = np.bincount(owner[spots], minlength=len(right))
            found = np.flatnonzero(similar(shared, len(s), sizes))
            if len(found):
                yield i, right[int(found[0])][0]

    at, rows, out = None, {}, []
    for batch in batches:
        cells = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        sides, ids, sets = batch.column(2).to_pylist(), batch.column(3).to_pylist(), sets_of(utf8(batch.column(4)))
        for cell, side, i, s in zip(cells, sides, ids, sets, strict=True):
            if cell != at:
                out += links(rows)
                at, rows = cell, {}
            rows[side, i] = s
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
            out = []
    out += links(rows)
    if out:
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _links(texts: DataFrame, cells: DataFrame) -> DataFrame:
    """cells: big, cell, side, id. Links (a, b) by full sets."""
    path = shared_dir(cells.sparkSession, "cells")
    cells = stored(cells, "cells", path)
    needed, _ = _passing(texts, _filter(cells))
    rows = needed.join(cells, "id").select("big", "cell", "side", "id", "text")
    links = stored(rows.repartition("big", "cell").sortWithinPartitions("big", "cell", "side").mapInArrow(_verify, "a long, b long"), "links")
    delete(cells.sparkSession, path)
    return links


# --- step 3: prefixes ------------------------------------------------------------------------------------

#: An entry of a prefix: 14 bytes before compression. Groups are differences, and their bytes lie apart, so that near ones are mostly zeros.
_ENTRY_BYTES, PLACES = 14, 128
#: Sizes of sets travel as eighths of their binary logarithm: the least and the largest size of each.
_EDGES = np.ceil(2.0 ** (np.arange(257) / 8)).astype(np.int64)
_LOWEST, _HIGHEST = _EDGES[:-1], np.maximum(_EDGES[1:] - 1, _EDGES[:-1])


def sketch_of(s: np.ndarray) -> np.ndarray:
    """For each class of shingles, whether the set holds an odd number. Two sets differ in no fewer shingles than sketches in bits.

    There are SKETCH_BITS classes, twice as many for each doubling of a set of more than two times these."""
    bits = SKETCH_BITS
    while 2 * bits < len(s):
        bits *= 2
    return np.packbits(np.bincount((mix(s ^ _SKETCH_SEED) % np.uint64(bits)).astype(np.int64), minlength=bits) % 2 == 1).view("<i8")


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set with fewer classes."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def may_link(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets with these sketches and this many shingles together can have 0.75: 7 times their difference is their sum at most."""
    return 7 * np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1, dtype=np.int64) <= sizes  # of signed ones it would count the absolute value's


def _pack(token: np.ndarray, group: np.ndarray, size: np.ndarray, place: np.ndarray) -> bytes:
    step = np.diff(group, prepend=np.int64(0))
    return token.astype("<u4").tobytes() + step.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() + size.tobytes() + place.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k = len(data) // _ENTRY_BYTES
    raw = np.frombuffer(data, np.uint8)
    step = np.ascontiguousarray(raw[4 * k : 12 * k].reshape(8, k).T).view("<i8").ravel()
    return raw[: 4 * k].view("<u4"), np.cumsum(step), raw[12 * k : 13 * k], raw[13 * k :]


def _prefixes(buckets: int, levels: np.ndarray):
    """Rows of (id, group, text) to packed prefix shingles of each bucket: token, group, size and place of each."""

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[] for _ in range(ORDERS)], 0

        def packed():
            out: dict[int, list[bytes]] = {}
            for j, parts in enumerate(held):
                if parts:
                    bucket, token, group, n, place = (np.concatenate(x) for x in zip(*parts, strict=True))
                    order = np.lexsort((group, bucket))
                    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)).tolist()
                    for a, b in zip(edges, edges[1:], strict=False):
                        at = order[a:b]
                        out.setdefault(int(bucket[at[0]]), [b""] * ORDERS)[j] = _pack(token[at], group[at], n[at], place[at])
                parts.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), *(pa.array([x[j] for x in out.values()], pa.binary()) for j in range(ORDERS))], names=["bucket", *(f"e{j}" for j in range(ORDERS))])

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = utf8(part.column(2))
                for group, s in zip(part.column(1).to_pylist(), sets_of(texts), strict=True):
                    n = len(s)
                    if not n:
                        continue
                    p = n - -(-3 * n // 4) + 1
                    sized = np.full(p, np.searchsorted(_EDGES, n, side="right") - 1, np.uint8)
                    level = levels[_counter(s, len(levels))].astype(np.uint64) << np.uint64(58)
                    places, groups = (np.arange(p) * PLACES // p).astype(np.uint8), np.full(p, group, np.int64)
                    for j, seed in enumerate(_ORDER_SEEDS):
                        rank = level | (mix(s ^ seed) >> np.uint64(6))
                        first = np.argpartition(rank, p - 1)[:p] if p < n else np.arange(n)
                        first = first[np.argsort(rank[first])][:p]
                        token = mix(s[first] ^ _COUNTER_SEED)
                        bucket = ((token >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
                        held[j].append((bucket, token.astype(np.uint32), groups, sized, places))
                size += sum(map(len, texts))
                if size > 16 << 20:
                    yield from packed()
                    size = 0
        yield from packed()

    return run


_PARTS = "part long, ord int, pairs binary"
#: Pairs of groups by part, or groups that share a hot token.
_MET = f"{_PARTS}, token long, group long, low long, high long, rest long"


def _dealt(pairs: np.ndarray, j: int, parts: int) -> dict[str, pa.Array]:
    part = ((mix(pairs[:, 0].view(np.uint64)) ^ mix(mix(pairs[:, 1].view(np.uint64)))) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1)).tolist()
    data = [pairs[order[a:b]].astype("<i8").tobytes() for a, b in zip(edges, edges[1:], strict=False)]
    return {"part": pa.array(part[order[edges[:-1]]], pa.int64()), "ord": pa.array([j] * len(data), pa.int32()), "pairs": pa.array(data, pa.binary())}


def _pairs(parts: int):
    names = ("token", "group", "low", "high", "rest")

    @thrifty
    def found(bucket: int, tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = next(tables)
        for j in range(ORDERS):
            met = _met(*(np.concatenate(x) for x in zip(*map(_unpack, table.column(f"e{j}").to_pylist()), strict=True)))
            edges = np.flatnonzero(np.diff(met[0].astype(np.int64), prepend=-1, append=-1))
            hot = np.repeat(np.diff(edges) > FREQUENT, np.diff(edges))
            for pairs in _group_pairs(*(x[~hot] for x in met)):
                own = _dealt(pairs, j, parts)
                yield pa.RecordBatch.from_pydict(own | {c: pa.nulls(len(own["part"]), pa.int64()) for c in names})
            rows = dict(zip(names, (x[hot].astype(np.int64) for x in met), strict=True))
            rows["token"] |= bucket << 32
            k = len(rows["token"])
            yield pa.RecordBatch.from_pydict({"part": pa.nulls(k, pa.int64()), "ord": pa.array([j] * k, pa.int32()), "pairs": pa.nulls(k, pa.binary())} | {c: pa.array(x, pa.int64()) for c, x in rows.items()})

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from found(key[0].as_py(), iter([pa.Table.from_batches(list(batches))]))

    return run


def _hot_pairs(parts: int):
    """Groups that share a token (ord, token, group, low, high, rest, sketch) to pairs; a group of several documents has no sketch and isn't asked."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("low")
        g, low, high, rest = (table.column(c).to_numpy() for c in ("group", "low", "high", "rest"))
        data = table.column("sketch").to_pylist()
        has = np.array([x is not None for x in data], bool)
        sketches = np.array([folded(np.array(x, np.int64), SKETCH_BITS // 64) for x in data if x is not None], np.int64).reshape(-1, SKETCH_BITS // 64)
        for pairs in _group_pairs(np.zeros(len(g), np.uint32), g, low, high, rest, np.where(has, np.cumsum(has) - 1, -1), sketches):
            yield pa.RecordBatch.from_pydict(_dealt(pairs, key[0].as_py(), parts))

    return run


def _met(token: np.ndarray, group: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens of several groups: token, group, the least and largest set of the group that has it, and the most shingles from there on, by token and least set."""
    # only tokens of two entries or more
    order = np.argsort(token, kind="stable")
    token = token[order]
    cut = np.flatnonzero(np.diff(token.astype(np.int64), prepend=-1, append=-1))
    several = np.repeat(np.diff(cut) > 1, np.diff(cut))
    order, token = order[several], token[several]
    if not len(order):
        return token, *(np.zeros(0, np.int64),) * 4
    inner = np.lexsort((group[order], token))
    order, token = order[inner], token[inner]
    g, low, high, place = group[order], _LOWEST[size[order]], _HIGHEST[size[order]], place[order].astype(np.int64)
    rest = high - place * (high - -(-3 * high // 4) + 1) // PLACES  # shingles from this place on, or a few more
    new = np.ones(len(order), bool)
    new[1:] = (token[1:] != token[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(new)
    token, g = token[at], g[at]
    low, high, rest = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(rest, at)
    # within each token by size, so that the partners of each lie next to it
    order = np.lexsort((low, token))
    return token[order], g[order], low[order], high[order], rest[order]


def _group_pairs(token: np.ndarray, g: np.ndarray, low: np.ndarray, high: np.ndarray, rest: np.ndarray, sketch: np.ndarray | None = None, sketches: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Pairs of groups (smaller, larger) that share a token with lengths, places and sketches that allow a link, distinct ones of about PAIRS at a time.

    Entries come by token and low. sketch: the row of sketches of each one, or -1."""
    last = np.searchsorted(token, token, side="right")
    out, seen = [], 0
    step = 1
    alive = np.arange(len(token))
    while len(alive):
        # partner = the entry `step` further on in the same token
        alive = alive[alive + step < last[alive]]
        other = alive + step
        fits = (4 * high[alive] >= 3 * low[other]) & (4 * high[other] >= 3 * low[alive])
        fits &= 7 * np.minimum(rest[alive], rest[other]) >= 3 * (low[alive] + low[other])
        if sketch is not None:
            asked = np.flatnonzero(fits & (sketch[alive] >= 0) & (sketch[other] >= 0))
            x, y = alive[asked], other[asked]
            fits[asked] = may_link(sketches[sketch[x]], sketches[sketch[y]], high[x] + high[y])
        pair = np.stack([g[alive[fits]], g[other[fits]]], axis=1)
        if len(pair):
            pair.sort(axis=1)
            out.append(pair)
            seen += len(pair)
        if seen > 2 * PAIRS:
            out = [np.unique(np.concatenate(out), axis=0)]
            seen = len(out[0])
            if seen > PAIRS:  # many different ones: they leave now, and repeats are met where orders are intersected
                yield out[0]
                out, seen = [], 0
        # lows only grow along a token: beyond 4/3 of the group's largest none fits
        alive = alive[4 * high[alive] >= 3 * low[other]]
        step += 1
    if out:
        yield np.unique(np.concatenate(out), axis=0)


def _intersect(key, table):
    found = {}
    for j, data in zip(table.column("ord").to_pylist(), table.column("pairs").to_pylist(), strict=True):
        found.setdefault(j, []).append(np.frombuffer(data, "<i8").reshape(-1, 2))
    both = np.zeros((0, 2), np.int64)
    if len(found) == ORDERS:
        every = np.concatenate([np.unique(np.concatenate(x), axis=0) for x in found.values()])
        pairs, times = np.unique(every, axis=0, return_counts=True)
        both = pairs[times == ORDERS]
    return pa.table({"g": pa.array(both[:, 0], pa.int64()), "h": pa.array(both[:, 1], pa.int64())})


# --- the join --------------------------------------------------------------------------------------------


def groups(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, n_shingles, component_id (the smallest id in reach by links, its own included)."""
    texts = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (total >> 10).bit_length()))
    salts = -(-total // COUNTED_BYTES) or 1
    all_rows = stored(texts.mapInArrow(_features(counters, salts), _FEATURES), "features")
    features = all_rows.where("chunk IS NULL").select("id", "n", "s1", "s2", "keys", "sketch")
    levels = _levels(all_rows.where("chunk IS NOT NULL").select("chunk", "salt", "counts"), counters, salts)

    nodes = features.where("id IS NOT NULL AND n > 0")
    # Rows that share an id are one node: each id leads, and so do ids that share a set
    alike = nodes.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.min("keys").alias("keys"))
    alike = stored(alike, "alike")
    texts = texts.where("id IS NOT NULL AND text IS NOT NULL")
    reps = alike.groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("sets"))
    several = reps.where("sets > 1").limit(1).count() > 0 or nodes.groupBy("id").count().where("count > 1").limit(1).count() > 0
    if several:  # equal ids: number the distinct texts instead, and tie those of one id together at the end
        return _with_equal_ids(df, doc_id, text)

    first_links = _links(texts, _early_cells(alike))
    early = stored(components(first_links), "early")
    apart = alike.join(early, F.col("rep") == F.col("id"), "left").where("component IS NULL OR component = rep").select("rep", "n", "keys")
    again = _early_cells(stored(apart, "apart"))
    if again.limit(1).count():
        first_links = first_links.unionByName(_links(texts, again))
        early = stored(components(first_links), "early")
    labelled = alike.select(F.col("rep").alias("id"), "n").join(early, "id", "left").select("id", "n", F.coalesce("component", "id").alias("group"))
    labelled = stored(labelled, "labelled")

    # texts with their groups; copies of a set are left out. Most documents are alone: the filter tells which can't be
    moved = labelled.where("id != group").select("id", "group").unionByName(nodes.select("id").join(labelled.select("id"), "id", "left_anti").select("id", F.lit(None).cast("long").alias("group")))
    moved = stored(moved.distinct(), "moved")
    some, alone = _passing(texts, _filter(moved))
    told = some.join(moved.withColumn("moved", F.lit(True)), "id", "left").where("moved IS NULL OR group IS NOT NULL").select("id", F.coalesce("group", "id").alias("group"), "text")
    prefixed = alone.select("id", F.col("id").alias("group"), "text").unionByName(told)
    buckets = max(1, -(-total // BUCKET_BYTES))
    packed = prefixed.mapInArrow(_prefixes(buckets, levels), "bucket long, " + ", ".join(f"e{j} binary" for j in range(ORDERS)))
    met = stored(packed.groupBy("bucket").applyInArrow(_pairs(buckets), _MET), "met")
    # sketches of the groups that are one document
    families = labelled.where("id != group").select("group").distinct()
    single = nodes.select(F.col("id").alias("group"), "n", "sketch").join(families, "group", "left_anti")
    exact = lambda c: F.coalesce("n", c).alias(c)
    hot = met.where("token IS NOT NULL")
    hot = hot.join(_of(single, hot.select(F.col("group").alias("id"))), "group", "left").select("ord", "token", "group", exact("low"), exact("high"), "rest", "sketch")
    more_pairs = hot.groupBy("ord", "token").applyInArrow(_hot_pairs(buckets), _PARTS)
    pairs = met.where("pairs IS NOT NULL").select("part", "ord", "pairs").unionByName(more_pairs)
    pairs = stored(pairs.groupBy("part").applyInArrow(_intersect, "g long, h long"), "candidates")
    pairs = stored(_sketched(pairs, single), "pairs")

    more_links = _links(texts, _late_cells(pairs, labelled))
    final = components(first_links.unionByName(more_links))
    ends = alike.select("n", "s1", "s2", "rep").join(final, F.col("rep") == F.col("id"), "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = features.join(ends, ["n", "s1", "s2"], "left")
    alone_id = F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), alone_id.alias("component_id"))


def _of(single: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of single whose group may be one of the ids."""
    return _passing(single.withColumnRenamed("group", "id"), _filter(ids))[0].withColumnRenamed("id", "group")


def _sketched(pairs: DataFrame, single: DataFrame) -> DataFrame:
    """Pairs of groups without those whose sketches allow no link."""
    single = _of(single, pairs.select(F.explode(F.array("g", "h")).alias("id")))
    of = lambda side: single.select(F.col("group").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch"))
    known = pairs.join(of("g"), "g", "left").join(of("h"), "h", "left")
    return known.select("g", "h", "g_n", "h_n", "g_sketch", "h_sketch").mapInArrow(_near, "g long, h long")


@thrifty
def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, h, g_n, h_n, g_sketch, h_sketch) whose sizes and sketches allow a link, or aren't known."""
    for batch in batches:
        near = []
        for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True):
            if fits := n is None or m is None or 3 * max(n, m) <= 4 * min(n, m):
                if n is not None and m is not None:
                    words = min(len(x), len(y))
                    both = (folded(np.array(z, np.int64), words).reshape(1, -1) for z in (x, y))
                    fits = bool(may_link(*both, np.array([n + m]))[0])
            near.append(fits)
        kept = batch.filter(pa.array(near, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["g", "h"])


def _weight(n: Column) -> Column:
    return F.greatest(F.lit(1.0), n / UNIT)


def _early_cells(alike: DataFrame) -> DataFrame:
    """Each document with up to three leaders of the MinHash values that it shares with them, at least three values of KEYS."""
    keyed = alike.select(F.col("rep").alias("id"), "n", F.posexplode("keys").alias("j", "key"))
    several = keyed.groupBy("j", "key").agg(F.count("*").alias("c")).where("c > 1")
    common = stored(keyed.join(several, ["j", "key"]), "common")
    known = F.sum("c").over(Window.partitionBy("id"))  # of KEYS rows at most
    leaders = common.withColumn("known", known).groupBy("j", "key").agg(F.max(F.struct("known", F.bitwise_not("id").alias("i")))["i"].alias("i"), F.max("c").alias("c")).select("j", "key", F.bitwise_not("i").alias("leader"), "c")
    parts = F.ceil(F.col("c") / SLICE)
    dealt = common.withColumn("slice", F.pmod(F.xxhash64("id"), parts)).drop("c")
    met = leaders.select("j", "key", "leader", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("slice"))
    shared = dealt.join(met, ["j", "key", "slice"]).where("id != leader").groupBy("id", "leader", "n").count().where("count >= 3")
    best = shared.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("count"), "leader"))).where("r <= 3")
    best = stored(best.select("id", "leader", "n"), "early-pairs")
    sizes = stored(best.groupBy("leader").agg(F.ceil(F.sum(_weight(F.col("n"))) / EARLY_CELL).alias("cells")), "sizes")
    members = best.join(sizes, "leader").select(F.col("leader").alias("big"), F.pmod(F.xxhash64("id"), F.col("cells")).alias("cell"), F.lit(0).alias("side"), "id")
    centres = sizes.select(F.col("leader").alias("big"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"), F.lit(1).alias("side"), F.col("leader").alias("id"))
    return members.unionByName(centres)


def _late_cells(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
    """For each pair of groups: the larger one's members in blocks against blocks of the members of all its partners."""
    sizes = labelled.groupBy("group").agg(F.sum(_weight(F.col("n"))).alias("size")).where("size > 1")
    size = lambda side: sizes.select(F.col("group").alias(side), F.col("size").alias(f"{side}_size"))
    sized = pairs.join(size("g"), "g", "left").join(size("h"), "h", "left").fillna(1.0, ["g_size", "h_size"])
    turn = F.col("g_size") >= F.col("h_size")
    ordered = sized.select(F.when(turn, F.col("g")).otherwise(F.col("h")).alias("big"), F.when(turn, F.col("h")).otherwise(F.col("g")).alias("small"), F.greatest("g_size", "h_size").alias("big_size"), F.least("g_size", "h_size").alias("small_size"))
    grid = ordered.groupBy("big").agg(F.ceil(F.max("big_size") / CELL).alias("across"), F.ceil(F.sum("small_size") / CELL).alias("down"))
    ids = labelled.select("id", "group")
    spot = lambda column, n, seed: F.pmod(F.xxhash64(column, F.lit(seed)), F.col(n))
    right = grid.join(ids, F.col("big") == F.col("group")).select("big", F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)).alias("d"), spot("id", "across", 1).alias("a"), "across", F.lit(1).alias("side"), "id")
    left = ordered.select("big", "small").join(grid, "big").join(ids, F.col("small") == F.col("group")).select("big", F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)).alias("a"), spot("id", "down", 2).alias("d"), "across", F.lit(0).alias("side"), "id")
    both = right.select("big", "a", "d", "across", "side", "id").unionByName(left.select("big", "a", "d", "across", "side", "id"))
    return both.select("big", (F.col("d") * F.col("across") + F.col("a")).cast("long").alias("cell"), "side", "id")


def _with_equal_ids(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows with one id and different texts: each distinct (id, text) gets a number, and texts of one id are tied."""
    every = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    unnamed = every.where("doc_id IS NULL").mapInArrow(_features(), _FEATURES).where("chunk IS NULL").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    rows = every.where("doc_id IS NOT NULL").withColumn("number", F.xxhash64("doc_id", "text"))
    found = stored(groups(rows.dropDuplicates(["doc_id", "text"]), doc_id="number", text="text").withColumnsRenamed({"doc_id": "number", "component_id": "c"}), "numbered")
    known = rows.select("doc_id", "number").join(found, "number")
    # components over ids: ids that share a text's component are tied through the smallest of them
    ties = stored(known.where("n_shingles > 0").select("doc_id", "c").distinct(), "ties")
    least = ties.groupBy("c").agg(F.min("doc_id").alias("m"))
    over = components(ties.join(least, "c").select("doc_id", "m"))
    out = known.join(over, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.unionByName(unnamed)
