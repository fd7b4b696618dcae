"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity.

Words are lower-cased (A-Z) and freed of ASCII punctuation around them; shingles are five words (the whole item, if it
has fewer). Windows have an item's number of words, at every position; where they reach over the document's ends they are cut
there. A window without any shingle of an item can't be similar to it, so only windows around shared shingles are hashed.

Each window and item has a 64-bit SimHash of its shingles; windows meet items of their own number of words only. Bits are dealt over
BLOCKS blocks; two fingerprints within RADIUS bits agree up to RADIUS // BLOCKS bits in one of the blocks, so looking up each block's
value and its neighbours finds all items within the radius: about a quarter of random ones meet in some block (21 bits, 7 of them
off), and the full fingerprint leaves one in sixty of them. Those found are verified: the weight of shared shingles over
the weight of all shingles of both must be LEAST or more. A shingle weighs 1 + ln((items + 1) / (items with it + 1)). At a
similarity of exactly 0.75 fingerprints differ in 11 bits on average, with a deviation of 3; RADIUS is four deviations more.

Items are sent to every task in blocks of at most ITEM_BYTES of text, each block against all documents. Weights are of all
items of the benchmark, whatever the blocks: where there are several, Spark counts the items of each shingle, documents first
get the counts of their own shingles (a block of counts at a time), and each block's items come with theirs. Null and empty texts match nothing, nor do null and empty items. Repeated items match alike, under their ids;
repeated documents too. Of each pair the most similar window is returned, the first of equals. Other columns do no harm, whatever their names.
Work on a text grows with its length times the number of item lengths that it shares shingles with.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import _ODD, _STEP, annotate, byte_batches, fresh, mix, stored, utf8, windows_of, words_of

K, LEAST, RADIUS, BLOCKS = 5, 0.75, 23, 3
#: Bytes of items that one pass over the documents carries.
ITEM_BYTES = 8 << 20
#: Words of windows that are hashed together, and pairs of block values that are looked up together.
WINDOWS, LOOKUPS = 1 << 18, 1 << 20

_FAR = 1 << 40  # beyond any number of words in a batch
_SIZES = [64 // BLOCKS + (b < 64 % BLOCKS) for b in range(BLOCKS)]
_SHIFTS = [sum(_SIZES[:b]) for b in range(BLOCKS)]


def _fixed(weights: np.ndarray) -> np.ndarray:
    """Weights as whole numbers, whose sums are exact in any order."""
    return np.rint(weights * (1 << 28)).astype(np.int64)


def simhash(grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of shingle hashes with their weights."""
    out = np.zeros(len(grams), np.uint64)
    for bit in range(64):
        signs = ((grams >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) * 2 - 1
        out |= ((signs * weights).sum(axis=1) > 0).astype(np.uint64) << np.uint64(bit)
    return out


class BlockIndex:
    """Multi-index of fingerprints: all within RADIUS bits are found.

    Each block knows its distinct values and the items that have them; a lookup takes the items of the values that are near enough."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.tables = []
        for b in range(BLOCKS):
            values, inverse, counts = np.unique(_block(prints, b), return_inverse=True, return_counts=True)
            self.tables.append((values, np.argsort(inverse, kind="stable"), np.cumsum(counts) - counts, counts))

    def within(self, fingerprint: int) -> np.ndarray:
        return self.pairs(np.array([fingerprint], np.uint64))[1]

    def pairs(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices (of prints, of items) of all pairs within the radius, in order."""
        found = []
        for b, (values, items, first, counts) in enumerate(self.tables):
            own, inverse = np.unique(_block(prints, b), return_inverse=True)
            width = max(1, LOOKUPS // max(1, len(values)))
            near = [np.flatnonzero(np.bitwise_count(own[i : i + width, None] ^ values[None, :]) <= RADIUS // BLOCKS) + i * len(values) for i in range(0, len(own), width)]
            u, v = np.divmod(np.concatenate(near), len(values)) if len(values) and near else (np.zeros(0, np.int64),) * 2
            # rows of u's value against items of v's value
            order = np.argsort(inverse, kind="stable")
            size = np.bincount(inverse, minlength=len(own))
            start = np.cumsum(size) - size
            total = size[u] * counts[v]
            for lo, hi in _ranges(total, LOOKUPS):
                each = np.repeat(np.arange(lo, hi), total[lo:hi])
                k = np.arange(len(each)) - np.repeat(np.cumsum(total[lo:hi]) - total[lo:hi], total[lo:hi])
                row, item = order[start[u[each]] + k // counts[v[each]]], items[first[v[each]] + k % counts[v[each]]]
                close = np.bitwise_count(self.prints[item] ^ prints[row]) <= RADIUS
                found.append(np.unique(row[close] * len(self.prints) + item[close]))
        every = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.divmod(every, max(1, len(self.prints)))


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    return (prints >> np.uint64(_SHIFTS[b])) & np.uint64((1 << _SIZES[b]) - 1)


def _ranges(sizes: np.ndarray, most: int):
    """Ranges of entries with about so much in all; one larger entry stays whole."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


class _Length:
    """The items of one number of words."""

    def __init__(self, items: np.ndarray, prints: np.ndarray):
        self.items, self.index = items, BlockIndex(prints)


class Finder:
    def __init__(self, items: list[tuple[object, str]], counts: tuple[np.ndarray, np.ndarray] | None = None, total: int | None = None):
        """items: (id, text); those without words are left out. If they are a block of more: the items' shingles in order, how many of all items have each, and the number of all."""
        data = [(i, t.encode()) for i, t in items if t]
        hashes, owner, _, _ = words_of([t for _, t in data], lower=True, trim=True)
        lengths = np.bincount(owner, minlength=len(data))
        first = np.cumsum(lengths) - lengths
        self.ids, self.words, self.sets, grams_of = [], [], [], {}
        for j, (i, _) in enumerate(data):
            if n := int(lengths[j]):
                k = min(K, n)
                grams = np.unique(windows_of(hashes[first[j] : first[j] + n], np.zeros(n, np.int64), k)[0])
                grams_of.setdefault(k, []).append((n, grams))
                self.ids.append(i), self.words.append(n), self.sets.append(grams)
        #: by shingle length: known shingles in order, where each one's item lengths start, and these; and a first test by the shingle's last bits
        self.sizes = {}
        for k, of in grams_of.items():
            grams = np.concatenate([g for _, g in of])
            n = np.repeat(np.array([n for n, _ in of]), [len(g) for _, g in of])
            order = np.lexsort((n, grams))
            grams, n = grams[order], n[order]
            new = np.ones(len(n), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (n[1:] != n[:-1])
            grams, n = grams[new], n[new]
            known, starts = np.unique(grams, return_index=True)
            some = np.zeros(1 << max(10, len(known).bit_length() + 3), bool)
            some[(known & np.uint64(len(some) - 1)).astype(np.int64)] = True
            self.sizes[k] = known, np.append(starts, len(n)), n, some
        if counts is None:
            counts = np.unique(np.concatenate(self.sets), return_counts=True) if self.sets else (np.zeros(0, np.uint64), np.zeros(0))
        self.total = len(self.ids) if total is None else total
        self.rare = int(_fixed(1 + np.log(self.total + 1.0)))
        self.know(*counts)
        prints = np.array([simhash(s[None, :], self.weights(s)[None, :])[0] for s in self.sets], np.uint64)
        self.totals = np.array([self.weights(s).sum() for s in self.sets])
        words = np.array(self.words, np.int64)
        self.lengths = {n: _Length(np.flatnonzero(words == n), prints[words == n]) for n in set(self.words)}

    def know(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """Weigh by these shingles, in order, and their numbers of items; all others are in no item."""
        self.known, self.weight = grams, _fixed(1 + np.log((self.total + 1) / (counts + 1)))

    def weights(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(grams.shape, self.rare)
        spot = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return np.where(self.known[spot] == grams, self.weight[spot], self.rare)

    def _starts(self, k: int, hashes: np.ndarray, owner: np.ndarray):
        """For each item length: windows around shared shingles, as runs (text, first start, start after the last)."""
        known, edges, lengths, some = self.sizes[k]
        grams, at = windows_of(hashes, owner, k)
        maybe = np.flatnonzero(some[(grams & np.uint64(len(some) - 1)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(known, grams[maybe]), len(known) - 1)
        hit = known[spot] == grams[maybe]
        p, spot = at[maybe[hit]], spot[hit]
        if not len(p):
            return
        times = edges[spot + 1] - edges[spot]
        each = np.repeat(np.arange(len(p)), times)
        n = lengths[np.repeat(edges[spot] - np.cumsum(times) + times, times) + np.arange(len(each))]
        for length in np.unique(n).tolist():
            q = p[each[n == length]]  # grows along the batch
            d = owner[q]
            fresh = np.ones(len(q), bool)
            fresh[1:] = (d[1:] != d[:-1]) | (q[1:] - q[:-1] > length - k + 1)
            head = np.flatnonzero(fresh)
            last = q[np.append(head[1:], len(q)) - 1]
            yield length, d[head], q[head] - (length - k), last + 1

    def find(self, texts: list[bytes]) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, word after the last) of each matching pair."""
        hashes, owner, _, _ = words_of(texts, lower=True, trim=True)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for k in self.sizes:
            for n, d, a, b in self._starts(k, hashes, owner):
                for lo, hi in _ranges(b - a + n, WINDOWS):
                    self._compare(k, n, d[lo:hi], a[lo:hi], b[lo:hi], hashes, bounds, best)
        return [(d, j, -s, a, b) for (d, j), (s, a, b) in sorted(best.items())]

    def _compare(self, k: int, n: int, d: np.ndarray, a: np.ndarray, b: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, best: dict) -> None:
        """Runs of starts [a, b) of windows of n words, laid end to end, against the items of n words.

        A shingle counts once in a window. So the one at place q counts for the starts after its last occurrence before q, from q - (n - k)
        up to q, and sums over all windows are running sums of what begins and ends to count at each start."""
        left, right = np.maximum(a, bounds[d]), np.minimum(b + n - 1, bounds[d + 1]) - k + 1  # places of shingles
        run = np.repeat(np.arange(len(a)), right - left)
        q = np.arange(len(run)) - np.repeat(np.cumsum(right - left) - (right - left), right - left) + np.repeat(left, right - left)
        grams = hashes[q].copy()
        for j in range(1, k):
            grams *= _STEP
            grams += hashes[q + j]
        grams = mix(grams + np.uint64(k * int(_ODD) & (1 << 64) - 1))
        order = np.lexsort((q, grams, run))
        again = (grams[order][1:] == grams[order][:-1]) & (run[order][1:] == run[order][:-1])
        before = np.full(len(q), -_FAR)
        before[order[1:][again]] = q[order[:-1][again]]
        base = np.cumsum(b - a) - (b - a) - a  # where start s of a run lies: s + base
        from_ = np.maximum(np.maximum(before + 1, q - (n - k)), a[run]) + base[run]
        to = np.minimum(q + 1, b[run]) + base[run]
        live = from_ < to
        size = int((b - a).sum())

        def sums(values: np.ndarray) -> np.ndarray:
            v = values[live]  # a start's own sum is far below 2 ** 53, and so exact
            return np.cumsum((np.bincount(from_[live], v, size + 1) - np.bincount(to[live], v, size + 1)).astype(np.int64))[:size]

        weights = self.weights(grams)
        prints = np.zeros(size, np.uint64)
        for bit in range(64):
            signs = ((grams >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) * 2 - 1
            prints |= (sums(signs * weights) > 0).astype(np.uint64) << np.uint64(bit)
        of = self.lengths[n]
        distinct, inverse = np.unique(prints, return_inverse=True)
        rows, items = of.index.pairs(distinct)
        if not len(rows):
            return
        own, total = np.repeat(np.arange(len(a)), b - a), sums(weights)
        for j in np.unique(items).tolist():
            near = np.zeros(len(distinct), bool)
            near[rows[items == j]] = True
            item = int(of.items[j])
            spot = np.minimum(np.searchsorted(self.sets[item], grams), len(self.sets[item]) - 1)
            shared = sums(np.where(self.sets[item][spot] == grams, weights, 0))
            union = total + self.totals[item] - shared
            hits = np.flatnonzero(near[inverse] & (shared >= LEAST * union))
            for i, x in zip(hits.tolist(), (shared[hits] / union[hits]).tolist(), strict=True):
                r = own[i]
                start, text = i - int(base[r]), int(d[r])
                first = max(start, int(bounds[text]))
                value = (-x, first - int(bounds[text]), min(start + n, int(bounds[text + 1])) - int(bounds[text]))
                if (text, item) not in best or value < best[text, item]:
                    best[text, item] = value


_COUNT = T.ArrayType(T.StructType([T.StructField("gram", T.LongType()), T.StructField("items", T.LongType())]))


def _grams_of(batches):
    """Rows (block, text) of items to their distinct shingles; a null shingle for each item with words."""
    for batch in batches:
        texts, blocks = utf8(batch.column(1)), batch.column(0).to_pylist()
        for lo, hi in byte_batches(texts):
            hashes, owner, _, _ = words_of(texts[lo:hi], lower=True, trim=True)
            edges = np.searchsorted(owner, np.arange(hi - lo + 1))
            for j in range(hi - lo):
                if n := int(edges[j + 1] - edges[j]):
                    own = hashes[edges[j] : edges[j + 1]]
                    grams = np.unique(windows_of(own, np.zeros(n, np.int64), min(K, n))[0]).view(np.int64).tolist()
                    yield pa.RecordBatch.from_pydict({"block": pa.array([blocks[lo + j]] * (len(grams) + 1), pa.int64()), "gram": pa.array([None, *grams], pa.int64())})


def _arrays(rows) -> tuple[np.ndarray, np.ndarray]:
    grams = np.array([r["gram"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.array([r["items"] for r in rows], np.int64)[order]


class Benchmark:
    """The items, in blocks of at most about ITEM_BYTES: how many follows from the table's size."""

    def __init__(self, benchmark: DataFrame, item_id: str, text: str):
        rows = benchmark.where(F.length(F.trim(text)) > 0).select(F.col(item_id).alias("i"), F.col(text).alias("t"))
        size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        self.n = -(-size // ITEM_BYTES)
        self.rows = rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(max(1, self.n))))
        self.counts = self.total = None
        if self.n > 1:
            grams = self.rows.select("block", "t").mapInArrow(_grams_of, "block long, gram long")
            self.counts = stored(grams.groupBy("gram").agg(F.count("*").alias("items"), F.collect_set("block").alias("blocks")), "item-shingles")
            self.total = self.counts.where("gram IS NULL").agg(F.sum("items")).first()[0] or 0
            self.counts = self.counts.where("gram IS NOT NULL")

    def finders(self):
        """For each block what makes its Finder in a task."""
        total = self.total
        for b in range(self.n):
            part = self.rows.where(F.col("block") == b) if self.n > 1 else self.rows
            items = sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda x: (x[0] is None, x))  # about ITEM_BYTES
            counts = _arrays(self.counts.where(F.array_contains("blocks", F.lit(b).cast("long"))).select("gram", "items").collect()) if self.n > 1 else None
            yield lambda items=items, counts=counts: Finder(items, counts, total)

    def known(self, docs: DataFrame, text: str, name: str) -> DataFrame:
        """docs with a column of the benchmark's shingles in each text and their numbers of items."""
        docs = docs.withColumn(name, F.array().cast(_COUNT))
        for b in range(self.n):
            part = self.counts.where(F.pmod(F.xxhash64("gram"), F.lit(self.n)) == b).select("gram", "items")
            grams, items = _arrays(part.collect())  # the shingles of about ITEM_BYTES

            def make(grams=grams, items=items):
                def compute(texts: pa.Array):
                    data, out = utf8(texts), []
                    for lo, hi in byte_batches(data):
                        hashes, owner, _, _ = words_of(data[lo:hi], lower=True, trim=True)
                        found: list[list[np.ndarray]] = [[] for _ in range(hi - lo)]
                        for k in range(1, K + 1):
                            own, at = windows_of(hashes, owner, k)
                            if len(own) and len(grams):
                                spot = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
                                hit = np.flatnonzero(grams[spot] == own)
                                edges = np.searchsorted(owner[at[hit]], np.arange(hi - lo + 1))
                                for d in np.unique(owner[at[hit]]).tolist():
                                    found[d].append(np.unique(spot[hit[edges[d] : edges[d + 1]]]))
                        for spots in found:
                            some = np.concatenate(spots) if spots else np.zeros(0, np.int64)
                            out.append([{"gram": g, "items": c} for g, c in zip(grams[some].view(np.int64).tolist(), items[some].tolist(), strict=True)])
                    return [out]

                return compute

            some = fresh(docs.columns, "some")
            docs = annotate(docs, [text], [T.StructField(some, _COUNT)], make).withColumn(name, F.concat(name, some)).drop(some)
        return docs


def _found(finder: Finder, data: list[bytes], known: list | None):
    """(text, item, similarity, first word, end) of all matches of a call."""
    for a, b in byte_batches(data):
        if known is not None:
            counts = {x["gram"]: x["items"] for each in known[a:b] for x in each}
            finder.know(*_arrays([{"gram": g, "items": c} for g, c in counts.items()]))
        for d, *rest in finder.find(data[a:b]):
            yield a + d, *rest


def matches(df: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each pair of a document and an item that it contains: doc_id, item_id, similarity, first_word, end_word."""
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = benchmark.schema[item_id].dataType
    match = T.StructType([T.StructField("item_id", kind), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())])
    bench = Benchmark(benchmark, item_id, item_text)
    inputs = ["text"]
    if bench.n > 1:  # texts without any shingle of an item match nothing
        docs = stored(bench.known(docs, "text", "known").where(F.size("known") > 0), "known")
        inputs.append("known")

    def against(finder_of) -> DataFrame:
        def make():
            finder = finder_of()

            def compute(texts: pa.Array, known: pa.Array | None = None):
                out: list[list[dict]] = [[] for _ in range(len(texts))]
                for d, j, score, start, end in _found(finder, utf8(texts), None if known is None else known.to_pylist()):
                    out[d].append({"item_id": finder.ids[j], "similarity": round(score, 4), "first_word": start, "end_word": end})
                return [out]

            return compute

        found = annotate(docs, inputs, [T.StructField("found", T.ArrayType(match))], make)
        return found.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")

    parts = [against(finder_of) for finder_of in bench.finders()]
    if not parts:
        return docs.where(F.lit(False)).select("doc_id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in match))
    return reduce(DataFrame.unionByName, parts)


def clean(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of df that contain no item; all columns stay as they are."""
    bench = Benchmark(benchmark, item_id, item_text)
    columns, inputs = df.columns, [text]
    if bench.n > 1:
        inputs.append(fresh(columns, "known"))
        df = bench.known(df, text, inputs[1])
    for finder_of in bench.finders():

        def make(finder_of=finder_of):
            finder = finder_of()

            def compute(texts: pa.Array, known: pa.Array | None = None):
                out = [False] * len(texts)
                for d, *_ in _found(finder, utf8(texts), None if known is None else known.to_pylist()):
                    out[d] = True
                return [out]

            return compute

        name = fresh(df.columns, "holds")
        df = annotate(df, inputs, [T.StructField(name, T.BooleanType())], make).where(~F.col(name)).drop(name)
    return df.select(*columns)
