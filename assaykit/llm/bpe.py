"""Byte-level BPE encoding and decoding with a sentencepiece model that is serialised from a rank file.

The model is not trained: each byte string of the rank file becomes one piece, its bytes mapped to the
characters U+0100 + byte, its score the negative rank; the normaliser is the identity. A pre-token is mapped
in the same way and merged by sentencepiece; ids are ranks. Decoding maps ids back to their byte strings.

Nulls count as empty texts and give no ids. Texts are encoded whole at any length. Rows are independent, so
ties, repeated rows and empty tables need nothing; other columns are kept, except those that a new column replaces.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, types as T

from .common import annotate, utf8

#: Pre-tokens that a task remembers; beyond it the memory starts anew (speed only, never results).
CACHE = 300_000


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank. Ranks must be 0, 1, 2, ... without gaps."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be consecutive from 0")
    return [token for _, token in pairs]


def mapped(data: bytes) -> str:
    """One character for each byte: none is a space or changes under any normaliser in use."""
    return data.decode("latin-1").translate(_UP)


_UP = {b: 0x100 + b for b in range(256)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: field numbers are those of sentencepiece_model.proto."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [(mapped(t), -float(rank), normal) for rank, t in enumerate(tokens)] + [("<unk>", 0.0, unknown)]
    body = b"".join(_field(1, _field(1, piece.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind)) for piece, score, kind in pieces)
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, normaliser)


_SPACED = " ".__add__


class ByteBpe:
    """Encodes and decodes one text at a time; small enough to be sent with each task (about 1 MB)."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        return cls(read_ranks(path), pattern)

    def start(self) -> ByteBpe:
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.tokens))
        self.find = regex.compile(self.pattern).findall
        self.spaces = re.compile(r"\s\s").search
        #: tiktoken takes a pre-token that is itself in the vocabulary as that one id, reachable by merges or not
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(self.tokens)}
        self.cache: dict[str, bytes] = {}
        return self

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern}

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers.

        Where no two white-space characters meet, a pre-token never crosses a single space, so the ids of
        " word" are remembered for each such chunk and the pattern runs over new chunks only.
        """
        if len(self.cache) > CACHE:
            self.cache.clear()
        chunks = []
        for x in texts:
            if self.spaces(x):
                chunks.append(self.find(x))
            else:
                first, *rest = x.split(" ")
                chunks.append([first, *map(_SPACED, rest)] if first else list(map(_SPACED, rest)))
        self._learn(set().union(*chunks).difference(self.cache))
        get = self.cache.__getitem__
        return [b"".join(map(get, x)) for x in chunks]

    def _learn(self, new: set[str]) -> None:
        found = {x: self.find(x) for x in new}
        ids: dict[str, bytes] = {}
        rest = []
        for part in set().union(*found.values()):
            if (data := self.whole.get(part.encode())) is not None:
                ids[part] = data
            else:
                rest.append(part)
        if rest:
            for part, got in zip(rest, self.processor.encode([mapped(p.encode()) for p in rest], out_type=int, num_threads=1), strict=True):
                ids[part] = array("I", got).tobytes()
        for x, parts in found.items():
            self.cache[x] = b"".join(map(ids.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_running: dict[bytes, ByteBpe] = {}


def running(codec: ByteBpe) -> ByteBpe:
    """One codec for each Python worker, whose memory of chunks outlives a task."""
    key = hashlib.sha256(repr((codec.pattern, codec.tokens)).encode()).digest()
    if key not in _running:
        _running.clear()
        _running[key] = codec.start()
    return _running[key]


def encode(df: DataFrame, codec: ByteBpe, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of each whole text as an array column."""

    def make():
        run = running(codec)
        return lambda texts: [[np.frombuffer(ids, "<u4").astype(np.int32) for ids in run.encode_many([x or "" for x in texts.to_pylist()])]]

    return annotate(df, [text], [T.StructField(ids, T.ArrayType(T.IntegerType(), False))], make)


def decode(df: DataFrame, codec: ByteBpe, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with the text of each array of ids; a null array gives an empty text. Bytes that are no UTF-8 become U+FFFD."""

    def make():
        return lambda arrays: [[codec.decode(np.asarray(x or [], "<u4").tobytes()).decode(errors="replace") for x in arrays.to_pylist()]]

    return annotate(df, [ids], [T.StructField(text, T.StringType())], make)


def digests(df: DataFrame, codec: ByteBpe, text: str = "text") -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256 of each whole text, encoded and decoded in one pass."""

    def make():
        run = running(codec)

        def compute(texts):
            n, coded, back = [], [], []
            for ids in run.encode_many([x or "" for x in texts.to_pylist()]):
                n.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(run.decode(ids)).hexdigest())
            return [n, coded, back]

        return compute

    return annotate(df, [text], [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], make)
