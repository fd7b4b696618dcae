"""What the operators share: reading tables, the shared folder, Arrow batches and word hashes."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

#: Rows that one call of a compute function gets at most; bounds a task's memory when texts are long.
ROWS_PER_CALL = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: By application: the temporary folder of a session on one machine.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder that the driver and all executors see: under spark.checkpoint.dir where the session sets it, else (tests on one machine) a temporary one.

    All folders of an application lie in one; `clear` deletes it when their results are no longer needed."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='assaykit-')}"
        _local[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/assaykit-{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all that the operators have stored in this application: results that read it can't be computed any more."""
    path = shared_dir(spark, "none").rsplit("/", 1)[0]
    delete(spark, path)


def stored(df: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and lost executors take nothing with them."""
    path = path or shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], name: str) -> str:
    """A column name beginning with name that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, rows: int = ROWS_PER_CALL) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def give_back() -> None:
    """Hand memory that a task has freed back to the system: workers live on, and what they keep adds to the next stage's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def thrifty(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's function that gives its memory back when it ends."""

    @functools.wraps(run)
    def wrapped(*args):
        try:
            yield from run(*args)
        finally:
            give_back()

    return wrapped


def annotate(df: DataFrame, inputs: list[str], fields: list[T.StructField], make: Callable[[], Callable[..., list]]) -> DataFrame:
    """All rows and columns of df with new columns computed from the input columns.

    make() runs once in each task and returns compute(*arrays) -> one list or array for each field.
    A column of df that has the name of a new field is replaced.
    """
    new = [f.name for f in fields]
    at = [df.columns.index(c) for c in inputs]
    keep = [i for i, c in enumerate(df.columns) if c not in new]
    schema = T.StructType([df.schema.fields[i] for i in keep] + fields)

    @thrifty
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        compute = make()
        types = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for part in slices(batch):
                got = compute(*(part.column(i) for i in at))
                arrays = [part.column(i) for i in keep] + [pa.array(x, t) for x, t in zip(got, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.mapInArrow(run, schema)


def utf8(array: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]


# --- words and their hashes ---------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_STEP_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_STEP, _STEP_INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


#: Bytes of text whose words are hashed together.
SPAN = 1 << 18
_PLAIN = np.ones(256, bool)
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = False


def words_of(texts: list[bytes], lower: bool = False, trim: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of some texts, laid end to end.

    Returns the words' hashes, the number of the text each is in, and where each starts and ends in that text (bytes).
    lower: A-Z hash as a-z. trim: ASCII punctuation around words is left out, and words of nothing else are.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    if not len(buffer):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    solid = ~_SPACE[buffer]
    edge = np.zeros(len(buffer) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buffer), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(buffer), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    if trim:
        rank = np.concatenate([[0], np.cumsum(_PLAIN[buffer])])
        where = np.flatnonzero(_PLAIN[buffer])
        some = rank[ends] > rank[starts]
        starts, ends = where[rank[starts[some]]], where[rank[ends[some]] - 1] + 1
    table = _BYTE_LOWER if lower else _BYTE
    hashes, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):  # some words at a time, so that the sums stay small
        to = int(np.searchsorted(starts, starts[at] + SPAN))
        s, e = starts[at:to] - starts[at], ends[at:to] - starts[at]
        powers, inverses = _power_tables(int(e[-1]) + 1)
        sums = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum(table[buffer[starts[at] : ends[to - 1]]] * powers[:-1], out=sums[1:])
        hashes[at:to] = mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(np.uint64) * _ODD)
        at = to
    owner = np.searchsorted(offsets, starts, side="right") - 1
    base = offsets[owner]
    return hashes, owner, starts - base, ends - base


def windows_of(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every k consecutive words of one text, and the index of each one's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rolled = hashes[:n].copy()
    for j in range(1, k):
        rolled *= _STEP
        rolled += hashes[j : n + j]
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return mix(rolled[at] + np.uint64(k * int(_ODD) & (1 << 64) - 1)), at


def byte_batches(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes together; one longer text stays whole."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield at, i
            at, size = i, 0
        size += len(x)
    if at < len(texts):
        yield at, len(texts)
