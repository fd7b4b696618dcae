"""Media columns: AVI files of motion-JPEG frames, their decoding, and shots.

Frames are grey, WIDTH x HEIGHT, 8 bits a sample, each an intra-coded JPEG of its own. They use JPEG's lossless
process (SOF3, predictor 1), since the DCT process would not return the samples unchanged. The RIFF file has an `idx1` index by
which frames are found. Frames of a batch are coded and decoded together: step t handles sample t of all frames.

Shots are cut where the histogram difference of neighbouring frames exceeds an adaptive threshold: the mean plus
SPREAD standard deviations of the differences in the frames before and after.

`clips` also reads ordinary files: frames of any size in the baseline and extended DCT processes or lossless (see jpeg), offsets that
count from the file's start, files without an index (their movi list is walked), and several streams (the first video stream is
taken). Shots need histograms of luma only, which are taken frame by frame.

A null or empty text becomes one frame of spaces. Texts of any length are stored whole. Equal texts give equal files
and features. Other columns are kept, except those that a new column replaces. A media value gives no clips where its status is not
ok: null, broken (not an AVI, or cut), or unsupported (no motion-JPEG, or a JPEG process that is not decoded).
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import annotate, fresh, utf8
from .jpeg import Unsupported, luma

WIDTH, HEIGHT = 16, 12
SAMPLES = WIDTH * HEIGHT
FPS = 25
BINS, AROUND, SPREAD = 16, 6, 4.0
#: Huffman code lengths of the categories 0 to 8 (bits of a difference): a fixed table written in each frame.
LENGTHS = {5: 2, 6: 2, 4: 3, 7: 3, 3: 4, 0: 5, 2: 6, 8: 7, 1: 7}


def _codes() -> tuple[np.ndarray, np.ndarray, bytes]:
    """Canonical codes by category, their lengths, and the DHT segment's table."""
    code, size = np.zeros(9, np.int64), np.zeros(9, np.int64)
    order = sorted(LENGTHS, key=lambda c: (LENGTHS[c], c))
    at, last = 0, 0
    for c in order:
        at <<= LENGTHS[c] - last
        last = LENGTHS[c]
        code[c], size[c] = at, last
        at += 1
    counts = bytes(sum(n == k for n in LENGTHS.values()) for k in range(1, 17))
    return code, size, b"\x00" + counts + bytes(order)


CODE, SIZE, DHT = _codes()
HEADER = (
    b"\xff\xd8"
    + b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, HEIGHT, WIDTH, 1) + b"\x01\x11\x00"
    + b"\xff\xc4" + struct.pack(">H", len(DHT) + 2) + DHT
    + b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00" + b"\x01\x00\x00"
)


def _differences(frames: np.ndarray) -> np.ndarray:
    """Of n x SAMPLES bytes: left neighbour, above at the start of a line, 128 at the very first."""
    x = frames.astype(np.int16).reshape(-1, HEIGHT, WIDTH)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    return d.reshape(len(x), SAMPLES)


_CATEGORY = np.array([abs(d).bit_length() for d in range(-255, 256)], np.int64)
_BITS = SIZE[_CATEGORY] + _CATEGORY  # by difference + 255: bits in all, and their value
_VALUE = np.array([(int(CODE[c]) << c) | (d if d >= 0 else d + (1 << c) - 1) for d, c in zip(range(-255, 256), _CATEGORY.tolist(), strict=True)], np.uint64)


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """A JPEG for each row of SAMPLES bytes."""
    if not len(frames):
        return []
    d = _differences(frames).astype(np.int64) + 255
    bits = _BITS[d]
    ends = np.cumsum(bits, axis=1)
    sizes = -(-ends[:, -1] // 8)  # bytes; the last is filled with ones
    base = np.concatenate([[0], np.cumsum(sizes)])
    last = ends[:, -1]
    at = (base[:-1, None] * 8 + ends - bits).ravel()
    value, width = _VALUE[d].ravel(), bits.ravel()
    words = np.zeros(int(base[-1]) // 4 + 3, np.uint64)  # 32 bits each
    word, off = at >> 5, at & 31
    shifted = value << (np.uint64(64) - (off + width).astype(np.uint64))
    np.add.at(words, word, shifted >> np.uint64(32))
    np.add.at(words, word + 1, shifted & np.uint64(0xFFFFFFFF))
    stream = np.frombuffer(words.astype(">u4").tobytes(), np.uint8)[: base[-1]].copy()
    stream[base[1:] - 1] |= ((1 << (sizes * 8 - last)) - 1).astype(np.uint8)
    data = stream.tobytes()
    return [HEADER + data[a:b].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: the difference, and the bits it takes (0: no code)."""
    diff, used = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    for d in range(-255, 256):
        n, v = int(_BITS[d + 255]), int(_VALUE[d + 255])
        diff[v << (16 - n) : (v + 1) << (16 - n)] = d
        used[v << (16 - n) : (v + 1) << (16 - n)] = n
    return diff, used


_DIFF, _USED = _lookup()


def decode_frames(images: list[bytes]) -> np.ndarray:
    """The samples of JPEG frames of this size and process, n x SAMPLES bytes."""
    scans = []
    for image in images:
        if not image.startswith(HEADER) or not image.endswith(b"\xff\xd9"):
            raise ValueError("not a frame of this kind")
        scans.append(image[len(HEADER) : -2].replace(b"\xff\x00", b"\xff"))
    sizes = np.fromiter(map(len, scans), np.int64, len(scans))
    stream = np.frombuffer(b"".join(scans) + bytes(4), np.uint8).astype(np.uint32)
    words = (stream[:-3] << 24) | (stream[1:-2] << 16) | (stream[2:-1] << 8) | stream[3:]  # 32 bits from each byte on
    start = (np.cumsum(sizes) - sizes) * 8
    at = start.copy()
    out = np.empty((SAMPLES, len(images)), np.int16)
    top = len(words) - 1
    for t in range(SAMPLES):
        peek = (words[np.minimum(at >> 3, top)] >> (16 - (at & 7)).astype(np.uint32)) & 0xFFFF
        left = out[t - 1] if t % WIDTH else out[t - WIDTH] if t else 128
        np.add(left, _DIFF[peek], out=out[t], casting="unsafe")
        at += _USED[peek]
    if ((at - start) > sizes * 8).any():
        raise ValueError("a frame ends too early")
    return out.T.astype(np.uint8)


# --- RIFF -----------------------------------------------------------------------------------------


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def write_avi(images: list[bytes]) -> bytes:
    """One video stream of motion-JPEG with an idx1 index; offsets count from the movi list's name."""
    n, most = len(images), max(map(len, images), default=0)
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", SAMPLES, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    chunks = [_chunk(b"00dc", x) for x in images]
    index, at = [], 4
    for x, c in zip(images, chunks, strict=True):
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        at += len(c)
    body = header + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


def _chunks(data: bytes, at: int, end: int):
    """(name, where its data starts, size) of the chunks in a range."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, size
        at += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second, and the frames of the first video stream in the order of the index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, stop, index, rate, stream, number, codec = 0, 0, None, float(FPS), -1, None, b""
    for name, at, size in _chunks(data, 12, len(data)):
        kind = data[at : at + 4] if name == b"LIST" else name
        if kind == b"movi" and not movi:
            movi, stop = at, min(at + size, len(data))
        elif kind == b"hdrl":
            for inner, x, n in _chunks(data, at + 4, at + size):
                if inner == b"avih" and (per := struct.unpack_from("<I", data, x)[0]):
                    rate = 1_000_000 / per
                elif inner == b"LIST" and data[x : x + 4] == b"strl":
                    stream += 1
                    for leaf, y, _ in _chunks(data, x + 4, x + n):
                        if leaf == b"strh" and data[y : y + 4] == b"vids" and number is None:
                            number, codec = stream, data[y + 4 : y + 8]
        elif kind == b"idx1":
            index = data[at : at + size]
    if not movi or number is None:
        raise ValueError("no movi list or no video stream")
    if codec.upper() not in (b"MJPG", b"\0\0\0\0", b"JPEG", b"AVRN"):
        raise Unsupported("no motion-JPEG")
    names = (b"%02ddc" % number, b"%02ddb" % number)
    if index is None:  # walk the list, and what records it is cut into
        frames = []
        for name, at, size in _chunks(data, movi + 4, stop):
            for inner, x, n in _chunks(data, at + 4, at + size) if name == b"LIST" else [(name, at, size)]:
                if inner in names:
                    frames.append(data[x : x + n])
        return rate, frames
    entries = [(offset, size) for name, _, offset, size in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if name in names]
    base = movi if not entries or data[movi + entries[0][0] : movi + entries[0][0] + 4] in names else 0  # offsets count from the list or from the file
    if any(data[base + offset : base + offset + 4] not in names or base + offset + 8 + size > len(data) for offset, size in entries):
        raise ValueError("an index that leads to no frames")
    return rate, [data[base + offset + 8 : base + offset + 8 + size] for offset, size in entries]


# --- shots ----------------------------------------------------------------------------------------


def histograms(frames: np.ndarray) -> np.ndarray:
    """Shares of BINS levels in the samples of each frame (a row each)."""
    n = len(frames)
    counts = np.bincount(((frames >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS).ravel(), minlength=n * BINS).reshape(n, BINS)
    return counts / max(1, frames.shape[1])


def file_histograms(images: list[bytes]) -> np.ndarray:
    """Histograms of a file's frames: of own ones together, of others one by one."""
    if all(x.startswith(HEADER) for x in images):
        parts = [histograms(decode_frames(images[i : i + 8192])) for i in range(0, len(images), 8192)]
    else:
        parts = [histograms(luma(x).reshape(1, -1)) for x in images]
    return np.concatenate(parts) if parts else np.zeros((0, BINS))


def shots_of(shares: np.ndarray) -> list[tuple[int, int, float]]:
    """(first frame, frame after the last, difference at its start) of each shot, from the frames' histograms.

    A difference is half the L1 distance of neighbours."""
    n = len(shares)
    if n < 2:
        return [(0, n, 0.0)] if n else []
    d = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (d, d * d))
    i = np.arange(len(d))
    lo, hi = np.maximum(i - AROUND, 0), np.minimum(i + AROUND + 1, len(d))
    others = np.maximum(hi - lo - 1, 1)
    mean = (sums[hi] - sums[lo] - d) / others
    deviation = np.sqrt(np.maximum((squares[hi] - squares[lo] - d * d) / others - mean * mean, 0))
    cuts = [0, *(np.flatnonzero((d > mean + SPREAD * deviation + 0.02) & (d > 0.1)) + 1).tolist(), n]
    return [(a, b, round(float(d[a - 1]), 4) if a else 0.0) for a, b in zip(cuts, cuts[1:], strict=False)]


def shots(frames: np.ndarray) -> list[tuple[int, int, float]]:
    return shots_of(histograms(frames))


def payload(text: bytes) -> bytes:
    """UTF-8 with spaces up to a positive multiple of SAMPLES."""
    return text + b" " * (max(1, -(-len(text) // SAMPLES)) * SAMPLES - len(text))


def store(texts: list[bytes]) -> list[bytes]:
    """An AVI file of each text."""
    loads = [payload(x) for x in texts]
    images = encode_frames(np.frombuffer(b"".join(loads), np.uint8).reshape(-1, SAMPLES))
    out, at = [], 0
    for x in loads:
        n = len(x) // SAMPLES
        out.append(write_avi(images[at : at + n]))
        at += n
    return out


def load(files: list[bytes]) -> list[tuple[float, np.ndarray]]:
    """Rate and frames of each file; all files' frames are decoded together."""
    parsed = [read_avi(x) for x in files]
    frames = decode_frames([f for _, fs in parsed for f in fs]) if any(fs for _, fs in parsed) else np.zeros((0, SAMPLES), np.uint8)
    out, at = [], 0
    for rate, fs in parsed:
        out.append((rate, frames[at : at + len(fs)]))
        at += len(fs)
    return out


#: Payload bytes coded together; bounds a task's memory.
TOGETHER = 2 << 20


def _groups(sizes: list[int]) -> list[tuple[int, int]]:
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > TOGETHER:
            out.append((first, i))
            first, total = i, 0
        total += n
    return [*out, (first, len(sizes))] if sizes else out


def to_media(df: DataFrame, *, text: str = "text", media: str = "media") -> DataFrame:
    """df with each text as an AVI file in a binary column."""

    def make():
        def compute(texts):
            data = utf8(texts)
            return [[y for a, b in _groups(list(map(len, data))) for y in store(data[a:b])]]

        return compute

    return annotate(df, [text], [T.StructField(media, T.BinaryType())], make)


def clips_of(data: bytes | None) -> tuple[str, list[dict]]:
    """Status and clips of a media value."""
    if data is None:
        return "null", []
    try:
        rate, images = read_avi(data)
        found = shots_of(file_histograms(images))
        return "ok", [{"clip": k, "start_ms": a * 1000 / rate, "end_ms": b * 1000 / rate, "frames": b - a, "difference": x} for k, (a, b, x) in enumerate(found)]
    except Unsupported:
        return "unsupported", []
    except (ValueError, IndexError, ArithmeticError, struct.error):
        return "broken", []


def clips(df: DataFrame, *, media: str = "media") -> DataFrame:
    """df with clips_status (ok, null, broken, unsupported) and an array of timed clips (number, start and end in milliseconds, frames, difference at the start) of each AVI file."""
    clip = T.StructType([T.StructField("clip", T.IntegerType()), T.StructField("start_ms", T.DoubleType()), T.StructField("end_ms", T.DoubleType()), T.StructField("frames", T.IntegerType()), T.StructField("difference", T.DoubleType())])

    def make():
        return lambda files: list(zip(*map(clips_of, files.to_pylist()), strict=True)) or [[], []]

    return annotate(df, [media], [T.StructField("clips_status", T.StringType()), T.StructField("clips", T.ArrayType(clip))], make)


def clip_rows(df: DataFrame, *, media: str = "media") -> DataFrame:
    """A row for each clip, with df's other columns; media values without clips give none."""
    found = clips(df, media=media)
    clip = fresh(found.columns, "each")
    keep = [c for c in df.columns if c not in (media, "clip", "start_ms", "end_ms", "frames", "difference", "clips", "clips_status")]
    return found.select(*keep, F.explode("clips").alias(clip)).select(*keep, f"{clip}.*")


def digests(df: DataFrame, *, text: str = "text") -> DataFrame:
    """df with digests of each text's stored form and of what is read back from it."""

    def make():
        def compute(texts):
            data = utf8(texts)
            out = [[] for _ in range(7)]
            for a, b in _groups(list(map(len, data))):
                files = store(data[a:b])
                for raw, file, (rate, frames) in zip(data[a:b], files, load(files), strict=True):
                    back = frames.tobytes()
                    cut = shots(frames)
                    feature = f"frames={len(frames)};shots={len(cut)};longest_ms={max(y - x for x, y, _ in cut) * 1000 / rate:.0f};peak={max(z for _, _, z in cut):.4f};mean={frames.mean():.3f}"
                    for column, value in zip(out, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature), strict=True):
                        column.append(value)
            return out

        return compute

    long, string = T.LongType(), T.StringType()
    names = (("n_bytes", long), ("payload_bytes", long), ("payload_sha256", string), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", string), ("feature", string))
    return annotate(df, [text], [T.StructField(n, t) for n, t in names], make)
