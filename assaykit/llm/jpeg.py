"""Luma of JPEG frames as video files carry them: baseline and extended Huffman DCT, and lossless, 8 bits a sample.

Sizes, sampling, quantisation, Huffman tables and restart intervals come from the frame's own segments; a frame without
Huffman tables (usual in motion-JPEG) gets the standard's. Progressive and arithmetic-coded frames and other sample widths raise
Unsupported, anything that breaks off or contradicts itself ValueError.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np


class Unsupported(ValueError):
    """A JPEG process that is not decoded."""


def _zigzag() -> np.ndarray:
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


_ZIGZAG = _zigzag()
_u, _x = np.arange(8)[:, None], np.arange(8)[None, :]
_COSINES = np.where(_u == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _x + 1) * _u * np.pi / 16))

#: The standard's Huffman tables (annex K), as counts of codes by length and symbols; of AC symbols those with short codes, all others follow in ascending order.
_DC = bytes.fromhex("00010501010101010100000000000000"), bytes.fromhex("00030101010101010101010000000000")
_AC = bytes.fromhex("0002010303020403050504040000017d"), bytes.fromhex("00020102040403040705040400010277")
_AC_FIRST = (
    bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"),
    bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1"),
)
_AC_EVERY = bytes(sorted([0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]))
STANDARD = {(0, k): (_DC[k], bytes(range(12))) for k in (0, 1)} | {(1, k): (_AC[k], _AC_FIRST[k] + bytes(s for s in _AC_EVERY if s not in _AC_FIRST[k])) for k in (0, 1)}


@functools.lru_cache(64)
def _table(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """By the next 16 bits: the symbol, and the length of its code (0: no code)."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = at = 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            lo, hi = code << (16 - n), (code + 1) << (16 - n)
            if hi > 1 << 16 or at >= len(symbols):
                raise ValueError("a Huffman table with too many codes")
            symbol[lo:hi], length[lo:hi] = symbols[at], n
            code, at = code + 1, at + 1
        code <<= 1
    return symbol.tolist(), length.tolist()


class _Bits:
    """The bits of one restart interval."""

    def __init__(self, data: bytes):
        stream = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + b"\xff" * 4, np.uint8).astype(np.uint32)
        self.words = ((stream[:-3] << 24) | (stream[1:-2] << 16) | (stream[2:-1] << 8) | stream[3:]).tolist()
        self.at, self.end = 0, 8 * (len(stream) - 4)

    def peek(self) -> int:
        if self.at > self.end:
            raise ValueError("a frame ends too early")
        return (self.words[self.at >> 3] >> (16 - (self.at & 7))) & 0xFFFF

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        bits = self.peek()
        if not (n := table[1][bits]):
            raise ValueError("no such Huffman code")
        self.at += n
        return table[0][bits]

    def value(self, n: int) -> int:
        """A signed difference of n bits."""
        if not n:
            return 0
        if n > 16:
            raise ValueError("a difference of too many bits")
        v = self.peek() >> (16 - n)
        self.at += n
        return v if v >> (n - 1) else v - (1 << n) + 1


def luma(data: bytes) -> np.ndarray:
    """The samples of a frame's first component, height x width. Whatever is wrong with a frame, it is a ValueError, or Unsupported."""
    try:
        return _luma(data)
    except (IndexError, KeyError, StopIteration, ZeroDivisionError, struct.error) as e:
        raise ValueError("a broken frame") from e


def _luma(data: bytes) -> np.ndarray:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quant, huffman, frame, restart = 2, {}, dict(STANDARD), None, 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        if kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                values = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8)
                if len(values) < 64:
                    raise ValueError("a short quantisation table")
                quant[body[0] & 15] = values.astype(np.float64)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                counts = body[1:17]
                n = sum(counts)
                huffman[body[0] >> 4, body[0] & 15] = counts, body[17 : 17 + n]
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind in (0xC0, 0xC1, 0xC3):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height:
                raise Unsupported("only frames of 8 bits a sample and known height")
            frame = kind, height, width, {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise Unsupported("progressive, differential or arithmetic-coded frame")
        elif kind == 0xDA:
            if not frame:
                raise ValueError("a scan before its frame")
            names = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            if names[0][0] != next(iter(frame[3])):
                raise Unsupported("a scan that does not begin with the first component")
            stop = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]").search(data, at)
            parts = re.split(rb"\xff[\xd0-\xd7]", data[at : stop.start() if stop else len(data)])
            tables = lambda cls, k: _table(*huffman[cls, k])
            if frame[0] == 0xC3:
                return _lossless(frame, [(c, tables(0, t >> 4)) for c, t in names], body[1 + 2 * len(names)], body[3 + 2 * len(names)] & 15, parts, restart)
            return _dct(frame, [(c, tables(0, t >> 4), tables(1, t & 15)) for c, t in names], quant, parts, restart)
    raise ValueError("no scan")


def _dct(frame, scan, quant, parts: list[bytes], restart: int) -> np.ndarray:
    _, height, width, components = frame
    alone = len(scan) == 1
    most_h, most_v = max(h for h, _, _ in components.values()), max(v for _, v, _ in components.values())
    h0, v0, q0 = components[scan[0][0]]
    if alone:
        h_blocks, v_blocks = -(-(-(-width * h0 // most_h)) // 8), -(-(-(-height * v0 // most_v)) // 8)
        across, down, layout = h_blocks, v_blocks, [(0, 1)]
    else:
        across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
        layout = [(i, components[c][0] * components[c][1]) for i, (c, _, _) in enumerate(scan)]
    step = restart or across * down
    of_first, out = layout[0][1], []
    for part, first in zip(parts, range(0, across * down, step), strict=False):
        bits, last = _Bits(part), [0] * len(scan)
        for _ in range(min(step, across * down - first)):
            for i, blocks in layout:
                _, dc, ac = scan[i]
                for _ in range(blocks):
                    block = [0] * 64
                    last[i] += bits.value(bits.symbol(dc))
                    block[0] = last[i]
                    k = 1
                    while k < 64:
                        s = bits.symbol(ac)
                        if s & 15:
                            k += s >> 4
                            block[k] = bits.value(s & 15)
                            k += 1
                        elif s == 0xF0:
                            k += 16
                        else:
                            break
                    if not i:
                        out.append(block)
    if len(out) < across * down * of_first:
        raise ValueError("a frame ends too early")
    coefficients = np.zeros((len(out), 64))
    coefficients[:, _ZIGZAG] = np.array(out, np.float64) * quant[q0]
    x = np.clip(np.rint(_COSINES.T @ coefficients.reshape(-1, 8, 8) @ _COSINES + 128), 0, 255).astype(np.uint8)
    h, v = (1, 1) if alone else (h0, v0)
    plane = x.reshape(down, across, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * h * 8)
    return plane[: -(-height * v0 // most_v), : -(-width * h0 // most_h)]


def _lossless(frame, scan, predictor: int, shift: int, parts: list[bytes], restart: int) -> np.ndarray:
    _, height, width, components = frame
    if len(components) != 1 or restart or not 1 <= predictor <= 7:
        raise Unsupported("lossless frames of several components, with restarts or without a predictor")
    bits, table = _Bits(parts[0]), scan[0][1]
    rows: list[list[int]] = []
    for y in range(height):
        above, row = rows[-1] if y else None, []
        for x in range(width):
            if not y:
                guess = row[-1] if x else 1 << (7 - shift)
            elif not x:
                guess = above[0]
            else:
                a, b, c = row[-1], above[x], above[x - 1]
                guess = (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[predictor - 1]
            row.append((guess + bits.value(bits.symbol(table))) & 0xFFFF)
        rows.append(row)
    return (np.array(rows, np.int64) << shift).astype(np.uint8)
