"""Token ids in binary files: patched frame-of-reference blocks.

A file holds the ids of a run of documents in ascending id order:

    magic "TKF1", header (counts), streams of document ids, document lengths and token ids.

Each stream is cut into blocks of BLOCK values. A block subtracts its minimum, packs the rest at the width that
a percentile of the values needs, and keeps larger values in an exception list (positions and high parts).
An index of block starts precedes the blocks, so that a reader can take any range of tokens.

Documents are dealt by ranges of id, then a hash of the text, then their place in the input, so that neither null ids nor
repeated rows need to fit in one range. How many ranges follows from the bytes of text. A task writes a file whenever it holds
FILE_IDS ids; one document is never cut.

Documents with null id come first; a null text counts as empty. Repeated ids stay as rows of their own, in a
stable order by id, then the text's hash. Ids must be numbers, or texts of numbers. An empty table gives no files. Any other
columns are not stored, whatever their names.
Writing is idempotent: a task writes beside the final name and renames, so a lost executor's task can run again.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import byte_batches, shared_dir, slices

BLOCK = 16_384
PERCENTILE = 97
END = 1
NULL_ID = -(1 << 63)
MAGIC = b"TKF1"
#: Distinct words whose ids a task remembers (speed only).
CACHE = 500_000
#: Signs at the end of words that are encoded by themselves (speed only).
SIGNS = ".,!?:;#$%&*"
#: Ids that end a file, and text for one range at most on average.
FILE_IDS, RANGE_BYTES = 1 << 23, 128 << 20


# --- blocks ---------------------------------------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> bytes:
    """Values of so many bits each, in 64-value groups of width 64-bit words."""
    groups = -(-len(values) // 64)
    v = np.zeros((groups, 64), np.uint64)
    v.ravel()[: len(values)] = values
    out = np.zeros((groups, width + 1), np.uint64)
    for j in range(64):
        word, off = divmod(j * width, 64)
        out[:, word] |= v[:, j] << np.uint64(off)
        if off + width > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - off)
    return np.ascontiguousarray(out[:, :width]).astype("<u8").tobytes()


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    groups = -(-n // 64)
    words = np.zeros((groups, width + 1), np.uint64)
    words[:, :width] = np.frombuffer(data, "<u8").reshape(groups, width)
    out = np.empty((groups, 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, off = divmod(j * width, 64)
        x = words[:, word] >> np.uint64(off)
        if off + width > 64:
            x |= words[:, word + 1] << np.uint64(64 - off)
        out[:, j] = x & mask
    return out.ravel()[:n]


def encode_block(values: np.ndarray) -> bytes:
    """One block of 64-bit signed values."""
    low = int(values.min())
    rest = values.astype(np.int64).view(np.uint64) - np.array(low, np.int64).view(np.uint64)
    width = min(63, int(np.percentile(rest, PERCENTILE, method="higher")).bit_length())
    high = rest >> np.uint64(width)
    at = np.flatnonzero(high).astype("<u4")
    packed = _pack(rest & np.uint64((1 << width) - 1), width) if width else b""
    return struct.pack("<qIBI", low, len(values), width, len(at)) + packed + at.tobytes() + high[at].astype("<u8").tobytes()


def decode_block(data: memoryview) -> np.ndarray:
    low, n, width, odd = struct.unpack_from("<qIBI", data)
    at = struct.calcsize("<qIBI")
    size = -(-n // 64) * width * 8
    rest = _unpack(data[at : at + size], n, width).copy() if width else np.zeros(n, np.uint64)
    at += size
    where = np.frombuffer(data[at : at + 4 * odd], "<u4")
    rest[where] |= np.frombuffer(data[at + 4 * odd : at + 12 * odd], "<u8") << np.uint64(width)
    return (rest + np.array(low, np.int64).view(np.uint64)).view(np.int64)


def encode_stream(values: np.ndarray) -> bytes:
    """Count, block starts, blocks."""
    blocks = [encode_block(values[i : i + BLOCK]) for i in range(0, len(values), BLOCK)]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.int64)]).astype("<u8")
    return struct.pack("<QI", len(values), len(blocks)) + starts.tobytes() + b"".join(blocks)


class Stream:
    """Reads ranges of an encoded stream, decoding only the blocks they lie in."""

    def __init__(self, data: memoryview):
        self.n, self.blocks = struct.unpack_from("<QI", data)
        self.starts = np.frombuffer(data[12 : 12 + 8 * (self.blocks + 1)], "<u8").astype(np.int64)
        self.data = data[12 + 8 * (self.blocks + 1) :]
        self.size = 12 + 8 * (self.blocks + 1) + int(self.starts[-1])

    def read(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.int64)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        got = np.concatenate([decode_block(self.data[self.starts[b] : self.starts[b + 1]]) for b in range(first, last + 1)])
        return got[start - first * BLOCK : stop - first * BLOCK]


def encode_file(doc_ids: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    streams = [encode_stream(x) for x in (doc_ids, lengths, tokens)]
    return MAGIC + struct.pack("<3Q", *map(len, streams)) + b"".join(streams)


def open_file(data: bytes) -> tuple[Stream, Stream, Stream]:
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    sizes = struct.unpack_from("<3Q", data, 4)
    at, out, view = 28, [], memoryview(data)
    for size in sizes:
        out.append(Stream(view[at : at + size]))
        at += size
    return tuple(out)


# --- tokenizer ------------------------------------------------------------------------------------


#: Fixed value: the pattern of pre-tokens without white space that word-level definitions split by.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _steps(part: dict | None, name: str) -> list[dict]:
    """A normaliser or pre-tokenizer as a list of its steps."""
    return [] if part is None else part[name] if part["type"] == "Sequence" else [part]


def cuts_words(definition: dict) -> tuple[bool, bool]:
    """Whether a definition cuts texts at ASCII white space before any merge, and whether letters are cut from what follows them and lowered."""
    normal = _steps(definition.get("normalizer"), "normalizers")
    cut = _steps(definition.get("pre_tokenizer"), "pretokenizers")
    space = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    plain = all(n["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or n == space for n in normal)
    split = bool(cut) and cut[0]["type"] == "Split" and cut[0]["pattern"] == {"Regex": WORD_PATTERN} and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
    by_word = plain and (split or bool(cut) and cut[0]["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"))
    return by_word, by_word and split and any(n["type"] == "Lowercase" for n in normal)


def _kept(memory: dict, seen: Iterable) -> dict:
    """What is remembered of what comes again: frequent words needn't be learnt anew."""
    return {x: memory[x] for x in seen if x in memory}


def _list(array: pa.Array) -> list:
    """Texts or bytes without line ends as a list; to_pylist makes an object of Arrow's for each."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array), pa.scalar("\n", array.type))[0].as_py()
    return joined.split("\n" if isinstance(joined, str) else b"\n") if len(array) else []


class WordTokenizer:
    """Ids of the tokenizers library, remembered by word.

    Where the definition cuts texts at ASCII white space before any merge, the ids of a text are those of its words one
    after the other. Other definitions get whole texts.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = self.plain = Tokenizer.from_str(definition)
        told = json.loads(definition)
        self.by_word, self.by_stem = cuts_words(told)
        #: signs at a word's end that the library cuts from letters, all together; none that a token of its own may hold
        self.signs = "".join(c for c in SIGNS if not any(c in t["content"] for t in told.get("added_tokens") or []))
        if self.by_stem:  # normalising leaves lower-case ASCII letters as they are, and white space alone cuts them: the same model without both
            rest = _steps(told["pre_tokenizer"], "pretokenizers")[1:]
            self.plain = Tokenizer.from_str(json.dumps(told | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *rest]}}))
        #: by id: whether a token ends a word; then words of letters alone can be encoded many at a time and told apart
        suffix = told["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix and self.by_word:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.cache: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch([x.decode() for x in texts], add_special_tokens=False)]
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))  # words of no bytes at a text's ends have no ids
        coded = lists.flatten().dictionary_encode()
        words = _list(coded.dictionary.cast(pa.binary()))
        if len(self.cache) > CACHE:
            self.cache = _kept(self.cache, words)
        self._learn([x for x in words if x not in self.cache])
        known = list(map(self.cache.__getitem__, words))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        of = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[of])])  # in the ids of all texts, by word
        first = (np.cumsum(sizes) - sizes)[of] - ends[:-1]
        ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(first, sizes[of]) + np.arange(ends[-1])]
        cuts = ends[lists.offsets.to_numpy()]
        return [ids[a:b].tobytes() for a, b in itertools.pairwise(cuts)]

    def _learn(self, words: list[bytes]) -> None:
        """Many new words differ only by case or by signs at their end: those are encoded once.

        Safe where the library cuts letters from what follows them and lowers ASCII letters (checked)."""
        whole = pa.array(words, pa.binary()).cast(pa.string())
        ends: dict[int, str] = {}
        if self.by_stem and words:
            ascii_ = pc.string_is_ascii(whole)
            bare = pc.utf8_rtrim(whole, self.signs) if self.signs else whole
            cut = pc.and_(pc.not_equal(pc.binary_length(bare), pc.binary_length(whole)), pc.match_substring_regex(bare, "[A-Za-z]$"))
            stems = _list(pc.if_else(ascii_, pc.ascii_lower(pc.if_else(cut, bare, whole)), whole))
            for i in pc.indices_nonzero(pc.and_(ascii_, cut)).to_pylist():
                ends[i] = words[i][len(stems[i]) :].decode()
            for i in pc.indices_nonzero(pc.invert(ascii_)).to_pylist():
                stem = stems[i].rstrip(self.signs)
                if stem != stems[i] and stem and unicodedata.normalize("NFC", stem).lower()[-1].isalpha():
                    ends[i] = stems[i][len(stem) :]
                    stems[i] = stem.lower() if stem.isascii() else stem
        else:
            stems = _list(whole)
        seen = set(stems).union(ends.values())
        if len(self.stems) > CACHE:
            self.stems = _kept(self.stems, seen)
        rest = list(seen.difference(self.stems))
        if self.ends.any():
            letters = [y for y in rest if y.isalpha()]
            self._learn_letters([y for y in letters if not y.isascii()], self.tokenizer)
            self._learn_letters([y for y in letters if y.isascii()], self.plain)
            rest = [y for y in rest if y not in self.stems]
        for i in range(0, len(rest), 4096):
            for y, e in zip(rest[i : i + 4096], self.tokenizer.encode_batch_fast(rest[i : i + 4096], add_special_tokens=False), strict=True):
                self.stems[y] = np.asarray(e.ids, "<u4").tobytes()
        self.cache.update(zip(words, map(self.stems.__getitem__, stems), strict=True))
        for i, end in ends.items():
            self.cache[words[i]] += self.stems[end]

    def _learn_letters(self, stems: list[str], tokenizer, together: int = 64) -> None:
        """Words of letters alone, joined by spaces: each has one token that ends a word. Where the count says otherwise, nothing is learnt."""
        groups = [stems[i : i + together] for i in range(0, len(stems), together)]
        for i in range(0, len(groups), 64):
            for group, e in zip(groups[i : i + 64], tokenizer.encode_batch_fast([" ".join(g) for g in groups[i : i + 64]], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
                if len(cuts) == len(group):
                    data = ids.tobytes()
                    for y, a, b in zip(group, [0, *cuts], cuts, strict=False):
                        self.stems[y] = data[a:b]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(definition: str) -> WordTokenizer:
    """One tokenizer for each Python worker, whose memory of words outlives a task."""
    if definition not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[definition] = WordTokenizer(definition)
    return _tokenizers[definition]


# --- files on Spark -------------------------------------------------------------------------------


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_files(df: DataFrame, definition: str, path: str, *, doc_id: str = "doc_id", text: str = "text", end: int = END, ranges: int = 0) -> list[tuple[str, int, int]]:
    """Encode whole texts and write token files under path; returns (file, documents, ids) of each file, in the order of ids.

    One shuffle deals documents by ranges; files of a range hold smaller ids than those of the next.
    ranges: how many, by default one for RANGE_BYTES of text, and as many as Spark's shuffle partitions at least.
    """
    spark = df.sparkSession
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // RANGE_BYTES))
    rows = df.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange(n, "doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        tokenizer, held, ids, lengths, tokens = None, 0, [], [], []
        store, folder = _filesystem(path)

        def file(number: int) -> pa.RecordBatch:
            lengths_ = np.concatenate(lengths)
            data = encode_file(np.concatenate(ids), lengths_, np.concatenate(tokens))
            store.create_dir(folder, recursive=True)
            name = f"tokens-{task.partitionId():06d}-{number:06d}.tkf"
            beside = f"{folder}/{name}.{task.taskAttemptId()}.tmp"
            with store.open_output_stream(beside) as f:
                f.write(data)
            try:
                store.move(beside, f"{folder}/{name}")
            except OSError:  # some stores refuse to replace what an earlier attempt wrote, which is the same
                if not store.get_file_info(f"{folder}/{name}").is_file:
                    raise
                store.delete_file(beside)
            return pa.RecordBatch.from_pydict({"file": [name], "docs": [len(lengths_)], "ids": [int(lengths_.sum())]})

        number = 0
        for batch in batches:
            tokenizer = tokenizer or tokenizer_of(definition)
            kind = np.uint16 if max(end, tokenizer.tokenizer.get_vocab_size()) < 1 << 16 else np.uint32
            for part in slices(batch):
                keys, texts = part.column(0).to_numpy(zero_copy_only=False), [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                for a, b in byte_batches(texts, 4 << 20):
                    coded = tokenizer.encode(texts[a:b])
                    ids.append(keys[a:b])
                    lengths.append(np.array([len(x) // 4 + 1 for x in coded], np.int64))
                    tokens.append(np.frombuffer(b"".join(x + struct.pack("<I", end) for x in coded), "<u4").astype(kind))
                    held += len(tokens[-1])
                    if held >= FILE_IDS:
                        yield file(number)
                        number, held, ids, lengths, tokens = number + 1, 0, [], [], []
        if ids:
            yield file(number)

    return sorted(tuple(r) for r in dealt.mapInArrow(run, "file string, docs long, ids long").collect())  # a row for each file


def read_files(spark, path: str, written: list[tuple[str, int, int]]) -> DataFrame:
    """Rows of doc_id, start, n_tokens, ids_crc32 from token files; start counts all ids of earlier documents.

    written: what write_files returned, a row for each file, from which each file's first position follows."""
    first, total = {}, 0
    for name, _, ids in written:
        first[name] = total
        total += ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not written:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tkf").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, sizes, tokens = open_file(data.as_buffer().to_pybytes())
                ids, lengths = docs.read(0, docs.n), sizes.read(0, sizes.n)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                base = first[name.rsplit("/", 1)[-1]]
                at = 0
                while at < len(ids):  # about a million ids at a time
                    to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 20), side="right")))
                    part = tokens.read(int(starts[at]), int(ends[to - 1])).astype("<u4")
                    crc = [zlib.crc32(part[a:b].tobytes()) for a, b in zip(starts[at:to] - starts[at], ends[at:to] - starts[at], strict=True)]
                    none = ids[at:to] == NULL_ID
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at:to], mask=none), pa.array(starts[at:to] + base), pa.array(lengths[at:to]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    at = to

    return files.mapInArrow(run, schema)


def token_files(df: DataFrame, definition: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write df's ids to files in the shared folder and return what the files hold."""
    path = shared_dir(df.sparkSession, "token-files")
    return read_files(df.sparkSession, path, write_files(df, definition, path, doc_id=doc_id, text=text))
