"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds further spans.

Tokens are words [^\\x20\\x09-\\x0D]+. Each is tagged O (outside), B (begin of a secret) or I (inside) by a CRF whose
scores come from the token's shape, its neighbours and features of its file; Viterbi decoding is exact. The model is
trained on the driver, from seeded generated lines, by gradient ascent on the conditional log-likelihood.

A run of B and I is on the best path only if its scores can beat those of O; words that are in no such run are O, and
only the others are decoded, which gives the same path as decoding whole texts.

Null and empty texts have no spans. Texts are scanned whole. Repeated rows get equal results. Other columns are kept,
except those that a new column replaces.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame, types as T

from .common import annotate, words_of

KINDS = ("assign", "access", "hex", "crf")
#: The base patterns, letters ASCII only; a match with too short a part fails.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones need not be matched to be dropped
ASSIGN_LEAST, ACCESS_LEAST = 6, 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, leftmost and non-overlapping for each kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


# --- features -------------------------------------------------------------------------------------

_WORDS = frozenset({"password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "key", "credential", "credentials", "bearer", "authorization", "auth", "access_key", "private_key", "client_secret", "access_token", "passphrase"})
_QUOTES = "\"'`,;()[]{}<>"
OWN, NEAR, FILE = 20, 6, 3


def shape(token: str) -> tuple[int, ...]:
    """The features of a token that hold, by number: below OWN for itself, the rest for what its neighbours see."""
    core = token.strip(_QUOTES)
    bare = core.rstrip(":=").lower()
    out = []
    if bare in _WORDS:
        out += [0, OWN]
    if core.endswith((":", "=")) or token in (":", "=", ":=", "=>"):
        out += [1, OWN + 1]
    if token in ("=", ":", ":=", "=>"):
        out += [2, OWN + 2]
    tail = core.rsplit("=", 1)[-1].rsplit(":", 1)[-1] if "=" in core.rstrip("=") or ":" in core else core
    if tail is not core and core[: len(core) - len(tail) - 1].strip(_QUOTES).lower().rsplit("_", 1)[-1] in _WORDS:
        out.append(3)
    n = len(tail)
    if tail.isalpha():
        out.append(4)
        if n >= 24:
            out.append(5)
        return tuple(out)
    digits = sum(c.isdigit() for c in tail)
    letters = sum(c.isalpha() for c in tail)
    if n and digits == n:
        out += [6, OWN + 3]
    if digits and letters:
        out.append(7)
        switches = sum(a.isdigit() != b.isdigit() for a, b in zip(tail, tail[1:], strict=False) if a.isalnum() and b.isalnum())
        if switches >= 5:
            out.append(8)
        if any(c.isupper() for c in tail) and any(c.islower() for c in tail):
            out.append(9)
        if all(c in "0123456789abcdef" for c in tail):
            out.append(10)
        counts = [tail.count(c) / n for c in set(tail)]
        if -sum(p * math.log2(p) for p in counts) >= 3.4:
            out.append(11)
    for bound, number in ((8, 12), (16, 13), (24, 14), (36, 15)):
        if n >= bound:
            out.append(number)
    if n and all(c.isascii() and (c.isalnum() or c in "+/_=-.") for c in tail):
        out.append(16)
    if "://" in token or "@" in token or core.count(".") >= 3:
        out += [17, OWN + 4]
    if token.startswith("-----") or token.endswith("-----"):
        out += [18, OWN + 5]
    if not letters and not digits:
        out.append(19)
    return tuple(out)


def file_features(words: int, coded: int, keys: int) -> tuple[bool, bool, bool]:
    """Of a text: few words, many coded-looking words, any key word."""
    return words < 40, coded * 20 > words, keys > 0


# --- the model ------------------------------------------------------------------------------------

DIM = OWN + 2 * NEAR + FILE + 1


def _generated(seed: int, lines: int) -> list[list[tuple[str, int]]]:
    """Lines of (token, label): prose, numbers, addresses, links and planted secrets."""
    r = random.Random(seed)
    low, alnum = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    mixed = lambda a, b: f"{some(alnum, a, b)}{r.randint(0, 9)}{some(alnum, 3, 6)}"

    def plain() -> str:
        kind = r.random()
        w = some(low, 1, 12)
        if kind < 0.78:
            return w.capitalize() if r.random() < 0.1 else w + r.choice(["", "", "", ",", "."])
        if kind < 0.84:
            return str(r.randint(0, 10 ** r.randint(1, 16)))
        if kind < 0.87:
            return f"{some(low, 3, 8)}.{r.randint(0, 99)}@{some(low, 3, 8)}.example.com"
        if kind < 0.90:
            return f"https://{some(low, 3, 8)}.example.com/{some(low, 2, 8)}/{r.randint(0, 9999)}?id={r.randint(0, 999)}"
        if kind < 0.93:
            return ".".join(str(r.randint(0, 255)) for _ in range(4))
        if kind < 0.95:
            return some(low, 20, 45)
        if kind < 0.97:
            return some(low, 3, 9) + str(r.randint(0, 99)) + r.choice(["", "%%%", "###"])
        return r.choice(["=", ":", "-", "|", "***", "###", f"{some(low, 3, 8)}:", f"{some(low, 3, 8)}=", *_WORDS])

    def secret() -> list[tuple[str, int]]:
        value = r.choice([lambda: some("0123456789abcdef", 24, 64), lambda: mixed(16, 40), lambda: "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16), lambda: f"sk_live_{mixed(16, 24)}", lambda: f"{mixed(8, 12)}-{mixed(4, 8)}"])()
        key = r.choice(sorted(_WORDS))
        key = r.choice([key, key.upper(), key.capitalize()])
        quote = r.choice(["", '"', "'"])
        form = r.random()
        if form < 0.35:
            return [(key, 0), (r.choice(["=", ":", ":="]), 0), (f"{quote}{value}{quote}", 1)]
        if form < 0.55:
            return [(key + r.choice("=:"), 0), (f"{quote}{value}{quote}", 1)]
        if form < 0.7:
            return [(f"{key}{r.choice('=:')}{quote}{value}{quote}", 1)]
        if form < 0.8:
            return [("Authorization:", 0), ("Bearer", 0), (value, 1)]
        if form < 0.9:
            return [(key, 0), ("=", 0), (f"{quote}{value}", 1), (mixed(8, 30), 2), (f"{mixed(8, 30)}{quote}", 2)]
        return [(value, 1)]

    out = []
    for _ in range(lines):
        line = [(plain(), 0) for _ in range(r.randint(4, 26))]
        if r.random() < 0.5:
            at = r.randint(0, len(line))
            line[at:at] = secret()
        out.append(line)
    return out


def _features(tokens: list[str]) -> np.ndarray:
    shapes = [shape(t) for t in tokens]
    x = np.zeros((len(tokens), DIM))
    for i, s in enumerate(shapes):
        for f in s:
            if f < OWN:
                x[i, f] = 1
            else:
                if i + 1 < len(tokens):
                    x[i + 1, f] = 1
                if i:
                    x[i - 1, f + NEAR] = 1
    coded, keys = sum(7 in s for s in shapes), sum(0 in s for s in shapes)
    x[:, OWN + 2 * NEAR : DIM - 1] = file_features(len(tokens), coded, keys)
    x[:, -1] = 1
    return x


@functools.lru_cache(4)
def train(seed: int = 11, lines: int = 800, rounds: int = 150, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (DIM x 3) and transitions (3 x 3); labels O, B, I; a text is led and followed by O. Trained once in a process."""
    data = _generated(seed, lines)
    longest = max(map(len, data))
    x, y, real = np.zeros((lines, longest, DIM)), np.zeros((lines, longest), int), np.zeros((lines, longest), bool)
    for i, line in enumerate(data):
        x[i, : len(line)], y[i, : len(line)], real[i, : len(line)] = _features([t for t, _ in line]), [v for _, v in line], True
    gold = np.eye(3)[y] * real[..., None]
    flat = x.reshape(-1, DIM)
    w, trans = np.zeros((DIM, 3)), np.zeros((3, 3))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    empirical = np.zeros((3, 3))
    for line in data:
        labels = [0, *(v for _, v in line), 0]
        np.add.at(empirical, (labels[:-1], labels[1:]), 1)
    logsum = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
    for step in range(1, rounds + 1):
        em = (flat @ w).reshape(lines, longest, 3)
        forward = np.zeros((lines, longest, 3))
        forward[:, 0] = trans[0] + em[:, 0]
        for t in range(1, longest):
            forward[:, t] = np.where(real[:, t, None], logsum(forward[:, t - 1, :, None] + trans, 1) + em[:, t], forward[:, t - 1])
        total = logsum(forward[:, -1] + trans[:, 0], 1)
        backward = np.zeros((lines, longest, 3))
        backward[:, -1] = trans[:, 0]
        expected = np.zeros((3, 3))
        for t in range(longest - 2, -1, -1):
            ahead = trans + (em[:, t + 1] + backward[:, t + 1])[:, None, :]
            backward[:, t] = np.where(real[:, t + 1, None], logsum(ahead, 2), trans[:, 0])
            expected += (np.exp(forward[:, t, :, None] + ahead - total[:, None, None]) * real[:, t + 1, None, None]).sum(axis=0)
        posterior = np.exp(forward + backward - total[:, None, None]) * real[..., None]
        expected[0] += posterior[:, 0].sum(axis=0)
        ends = real.sum(axis=1) - 1
        expected[:, 0] += posterior[np.arange(lines), ends].sum(axis=0)
        grads = [flat.T @ (gold - posterior).reshape(-1, 3) / lines - decay * w, (empirical - expected) / lines - decay * trans]
        for k, (p, g) in enumerate(zip((w, trans), grads, strict=True)):  # Adam
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, trans


class Tagger:
    """Decodes texts; remembers the shapes of tokens (speed only)."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray]):
        self.w, self.trans = model
        t = self.trans
        #: the most that a run of B and I can gain over O by each transition within it, and by its two ends beside that
        self.inner = t[1:, 1:].max() - t[0, 0]
        self.ends = t[0, 1:].max() + t[1:, 0].max() - 2 * t[0, 0] - self.inner
        self.number: dict[str, int] = {}
        self.shapes: dict[tuple[int, ...], int] = {}
        self.rows: list[np.ndarray] = []

    def _number(self, token: str) -> int:
        s = shape(token)
        if s not in self.shapes:
            self.shapes[s] = len(self.rows)
            own = self.w[[f for f in s if f < OWN]].sum(axis=0)
            near = [f for f in s if f >= OWN]
            self.rows.append(np.concatenate([own, self.w[near].sum(axis=0), self.w[[f + NEAR for f in near]].sum(axis=0), [7 in s, 0 in s]]))
        return self.shapes[s]

    def tag(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that are not O, and their labels."""
        if len(self.number) > 200_000:
            self.number.clear()
        for token in set(words).difference(self.number):
            self.number[token] = self._number(token)
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        table = np.array(self.rows) if len(self.rows) else np.zeros((0, 11))
        file = np.array(file_features(len(words), int(table[ids, 9].sum()), int(table[ids, 10].sum())))
        em = table[ids, :3] + (self.w[OWN + 2 * NEAR : DIM - 1][file].sum(axis=0) + self.w[-1])
        em[1:] += table[ids[:-1], 3:6]
        em[:-1] += table[ids[1:], 6:9]
        open_ = self._open(em[:, 1:].max(axis=1) - em[:, 0] + self.inner)
        if not len(open_):
            return open_, open_
        labels = np.zeros(len(words), np.int64)
        cuts = np.flatnonzero(np.diff(open_) > 1) + 1
        for run in np.split(open_, cuts):
            labels[run] = self.viterbi(em[run])
        at = np.flatnonzero(labels)
        return at, labels[at]

    def _open(self, gain: np.ndarray) -> np.ndarray:
        """Words that can be in a run that beats O throughout: its gains sum to more than 0, so from one of its ends up to the word they do."""
        if self.ends > 0:
            return np.arange(len(gain))
        near = np.zeros(len(gain), bool)
        for side in (slice(None), slice(None, None, -1)):  # the best sum that ends here: a total less the least total before it
            total = np.cumsum(gain[side])
            near[side] |= total - np.minimum.accumulate(np.concatenate([[0.0], total[:-1]])) > -1e-6
        return np.flatnonzero(near)

    def viterbi(self, em: np.ndarray) -> list[int]:
        """The best labels of a run between O and O."""
        t = self.trans.tolist()
        score, back = [t[0][y] + e for y, e in enumerate(em[0].tolist())], []
        for row in em[1:].tolist():
            best = [max(range(3), key=lambda a: score[a] + t[a][y]) for y in range(3)]  # noqa: B023
            score = [score[best[y]] + t[best[y]][y] + row[y] for y in range(3)]
            back.append(best)
        y = max(range(3), key=lambda a: score[a] + t[a][0])
        path = [y]
        for best in reversed(back):
            y = best[y]
            path.append(y)
        return path[::-1]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) in code points of each tagged secret, without quotes and brackets around it."""
        words = text.split() if text.isascii() and not _SEPARATORS.search(text) else [w.decode() for w in text.encode().split()]
        if not words:
            return []
        at, labels = self.tag(words)
        if not len(at):
            return []
        data = text.encode()
        _, _, starts, ends = words_of([data])
        points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # code points up to each byte
        out: list[list[int]] = []
        for k, (i, y) in enumerate(zip(at.tolist(), labels.tolist(), strict=True)):
            if y == 2 and k and at[k - 1] == i - 1:
                out[-1][1] = i
            else:
                out.append([i, i])
        spans = []
        for first, last in out:
            piece = data[starts[first] : ends[last]].decode()
            start = int(points[starts[first]]) - 1 + len(piece) - len(piece.lstrip(_QUOTES))
            if core := piece.strip(_QUOTES):
                spans.append((start, 3, start + len(core)))
        return spans


_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space for str.split, but not here


def all_spans(tagger: Tagger, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    return base, sorted({*base, *tagger.spans(text)})


def digest_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, *, text: str = "text") -> DataFrame:
    """df with secrets: an array of (kind, start, end, value) of each whole text, base spans and the CRF's."""
    model = model or train()
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())])

    def make():
        tagger = Tagger(model)
        find = lambda x: [{"kind": KINDS[k], "start": a, "end": b, "value": x[a:b]} for a, k, b in all_spans(tagger, x)[1]]
        return lambda texts: [[find(x or "") for x in texts.to_pylist()]]

    return annotate(df, [text], [T.StructField("secrets", T.ArrayType(span))], make)


def redact(df: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with each secret of the text column replaced by the mark; overlapping spans are replaced together. Null texts stay null."""
    model = model or train()

    def make():
        tagger = Tagger(model)

        def clean(x: str | None) -> str | None:
            if not x:
                return x
            out, done, shown = [], 0, False
            for a, _, b in all_spans(tagger, x)[1]:
                if a >= done or not shown:
                    out += [x[done:a], mark]
                    shown = True
                done = max(done, b)
            return "".join([*out, x[done:]])

        return lambda texts: [[clean(x) for x in texts.to_pylist()]]

    order = df.columns
    return annotate(df, [text], [T.StructField(text, T.StringType())], make).select(*order)


def digests(df: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, *, text: str = "text") -> DataFrame:
    """df with n_assign, n_access, n_hex, base_sha256, spans and n_crf of each whole text."""
    model = model or train()

    def make():
        tagger = Tagger(model)

        def compute(texts):
            out = [[] for _ in range(6)]
            for x in texts.to_pylist():
                base, every = all_spans(tagger, x or "")
                kinds = [k for _, k, _ in base]
                for column, value in zip(out, [*(kinds.count(k) for k in range(3)), hashlib.sha256(digest_text(base).encode()).hexdigest(), digest_text(every), len(every) - len(base)], strict=True):
                    column.append(value)
            return out

        return compute

    long, string = T.LongType(), T.StringType()
    return annotate(df, [text], [T.StructField(n, t) for n, t in (("n_assign", long), ("n_access", long), ("n_hex", long), ("base_sha256", string), ("spans", string), ("n_crf", long))], make)
