"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled sample text is built. A document is cut by greedy longest
matches against each automaton: the fewer phrases, the better the language explains it. The phrase count is
normalised by the letters parsed; the language with the smallest rate wins, ties going to the name that sorts first.

Texts are parsed whole. Segments of SEGMENT symbols are parsed at the same time, each as if a phrase began with it, so that thousands
take each step together in numpy. The parse of the segment before then runs on into each until both are in the same state, which
takes some twenty symbols, and the phrases up to there are counted by it: the result is that of one parse from end to end. The sample is bounded by `docs_per_lang` documents and `chars_per_lang` characters
in each language (documented parameters); which documents are in it depends on hashes of their ids and on their lengths.
Texts beyond a third of `chars_per_lang` are taken where a language's hash bucket has no other, and then only the third in their
middle: an excerpt to learn from; texts to be identified are never cut.

Nulls and texts without letters give `und` and score 0. A table without labelled rows gives `und` everywhere.
Repeated rows get equal results; other columns are kept, except those that a new column replaces.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import annotate, byte_batches

UNKNOWN = "und"
SEGMENT = 256
#: Characters parsed together; bounds a task's memory.
TOGETHER = 1 << 19
#: Times that all segments are parsed again side by side before the rest is followed one by one.
ROUNDS = 3
#: Characters with numbers of their own in the automata; others share numbers by remainder.
ALPHABET = 96
_SPACE, _DIGIT, _OTHER, _FIRST = 0, 1, 2, 3
_NEW = np.int32(1 << 30)


def crc_remainder(doc_id: str, parts: int = 4) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def labelled_sample(df: DataFrame, where: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = 48, chars_per_lang: int = 24_000) -> dict[str, str]:
    """At most docs_per_lang texts of each language, joined until chars_per_lang is reached; of longer texts than a third of it, the third in the middle.

    Rows are chosen by the smallest hash of their id in each of docs_per_lang hash buckets, texts of 200 characters or more
    before shorter ones, and longer ones than a third last: two passes, the first over ids and lengths only.
    """
    key = F.xxhash64(F.col(doc_id).cast("string"))
    most, length = chars_per_lang // 3, F.length(text)
    excerpt = F.when(length > most, F.col(text).substr(F.floor((length - most) / 2).cast("int") + 1, F.lit(most))).otherwise(F.col(text))
    rows = df.where(where & F.col(lang).isNotNull() & F.col(text).isNotNull() & (length > 0)).select(F.col(lang).alias("_lang"), F.pmod(key, F.lit(docs_per_lang)).alias("_bucket"), key.alias("_hash"), (length > most).alias("_long"), excerpt.alias("_text"))
    least = rows.groupBy("_lang", "_bucket").agg(F.min(F.struct("_long", F.length("_text") < 200, "_hash"))["_hash"].alias("_hash"))
    chosen = [(r["_lang"], r["_hash"]) for r in least.orderBy("_lang", "_bucket").collect()]  # docs_per_lang rows a language
    if not chosen:
        return {}
    wanted = F.col("_hash").isin([h for _, h in chosen])
    texts: dict[tuple[str, int], str] = {}
    for r in rows.where(wanted).groupBy("_lang", "_hash").agg(F.min(F.struct("_long", "_text"))["_text"].alias("_text")).collect():
        texts[r["_lang"], r["_hash"]] = r["_text"]
    sample: dict[str, str] = {}
    for name, h in sorted(chosen):
        if (name, h) in texts and len(sample.get(name, "")) < chars_per_lang:
            sample[name] = sample.get(name, "") + texts[name, h] + "\n"
    return sample


def alphabet(sample: dict[str, str]) -> np.ndarray:
    """The number of each character up to U+FFFF: the most frequent letters of the sample get their own."""
    codes = np.zeros(1 << 16, np.uint8)
    points = np.arange(1 << 16)
    codes[:] = _OTHER
    letters: dict[str, int] = {}
    for x in sample.values():
        for c in x.lower():
            if c.isalpha():
                letters[c] = letters.get(c, 0) + 1
    top = sorted(letters, key=lambda c: (-letters[c], c))[: ALPHABET - _FIRST - 16]
    own = {c: _FIRST + i for i, c in enumerate(top)}
    for p in points:
        c = chr(p)
        if c.isalpha():
            low = c.lower()
            codes[p] = own.get(low) or ALPHABET - 16 + p % 16
        elif c.isspace():
            codes[p] = _SPACE
        elif c.isdigit():
            codes[p] = _DIGIT
    return codes


def suffix_automaton(symbols: list[int]) -> np.ndarray:
    """Transitions of the suffix automaton, one row of ALPHABET a state, -1 where there is none. The root is 0."""
    link, length, nexts, last = [-1], [0], [{}], 0
    for c in symbols:
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        nexts.append({})
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                nexts.append(dict(nexts[q]))
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out = np.full((len(nexts), ALPHABET), -1, np.int32)
    for state, arcs in enumerate(nexts):
        for c, to in arcs.items():
            out[state, c] = to
    return out


class CrossParser:
    """Automata of all languages in one transition table; where a phrase starts, the entry holds its first state and a flag.

    A symbol that the sample lacks is a phrase of its own."""

    def __init__(self, sample: dict[str, str]):
        self.langs = sorted(sample)
        self.codes = alphabet(sample)
        tables, roots, base = [], [], 0
        for name in self.langs:
            if base * ALPHABET >= _NEW - 2 * ALPHABET * len(sample[name]):
                raise ValueError("too many languages for the transition table: lower chars_per_lang")
            arcs = suffix_automaton(self.encode(sample[name])[0].tolist())
            restart = np.where(arcs[0] >= 0, arcs[0], 0)
            dead = arcs < 0
            arcs = np.where(dead, restart[None, :], arcs) + base
            arcs *= ALPHABET
            dead[0] = True  # at the root each symbol starts a phrase
            tables.append(np.where(dead, arcs | _NEW, arcs).astype(np.int32))
            roots.append(base * ALPHABET)
            base += len(arcs)
        self.arcs = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int32)

    def __getstate__(self) -> dict:
        """Without the entries that only start a phrase: those are the same in all states of a language."""
        if self.arcs is None:
            return self.__dict__
        table = self.arcs.reshape(-1, ALPHABET)
        starts = (self.roots // ALPHABET).astype(np.int64)
        sizes = np.diff(np.append(starts, len(table)))
        live = np.flatnonzero(table.ravel() != np.repeat(table[starts], sizes, axis=0).ravel()) if len(starts) else np.zeros(0, np.int64)
        return self.__dict__ | {"arcs": None, "folded": (table[starts], sizes, live.astype(np.uint32), self.arcs[live])}

    def unfolded(self) -> CrossParser:
        """The parser with its whole table, which lives as long as this copy."""
        if self.arcs is not None:
            return self
        out = CrossParser.__new__(CrossParser)
        roots, sizes, live, values = self.folded
        out.__dict__ = {"langs": self.langs, "codes": self.codes, "roots": self.roots, "arcs": np.repeat(roots, sizes, axis=0).ravel()}
        out.arcs[live] = values
        return out

    def together(self) -> int:
        """Symbols that are parsed together: fewer where there are many languages, so that their states take the same memory."""
        return max(1, TOGETHER * 8 // max(8, len(self.langs)))

    def encode(self, text: str) -> tuple[np.ndarray, int]:
        """Symbols with runs of characters that are no letters squeezed to one, and the number of letters."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        symbols = self.codes[np.where(points < 1 << 16, points, 0xFFFF)]
        far = points >= 1 << 16
        if far.any():
            symbols = symbols.copy()
            symbols[far] = [ALPHABET - 16 + p % 16 if chr(p).isalpha() else _OTHER for p in points[far]]
        plain = symbols < _FIRST
        symbols = np.where(plain, _SPACE, symbols)
        keep = ~plain
        keep[1:] |= ~plain[:-1]
        return symbols[keep], int(len(plain) - plain.sum())

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language (a row for each text), and the letters of each text."""
        coded = [self.encode(x) for x in texts]
        letters = np.array([n for _, n in coded], np.int64)
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        if not self.langs:
            return counts, letters
        roots = lambda k: np.repeat(self.roots[None, :], k, axis=0)
        together = self.together()
        some = [i for i, (x, n) in enumerate(coded) if n and len(x) <= together]
        if some:
            counts[some] = self._parse([coded[i][0] for i in some], roots(len(some)))[0]
        for i, (x, n) in enumerate(coded):
            if n and len(x) > together:
                state = roots(1)
                for at in range(0, len(x), together):
                    more, state = self._parse([x[at : at + together]], state)
                    counts[i] += more[0]
        return counts, letters

    def _parse(self, texts: list[np.ndarray], given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that start in each text's symbols, from the states given, and the states at the ends."""
        n, sizes = len(self.langs), np.array(list(map(len, texts)), np.int64)
        flat = np.concatenate(texts)
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(np.cumsum(sizes) - sizes, pieces) + place * SEGMENT
        size = np.minimum(SEGMENT, np.repeat(np.cumsum(sizes), pieces) - first)
        order = np.argsort(-size, kind="stable")  # long segments first, so that each step takes the first ones
        back = np.argsort(order)
        before = np.where(place > 0, back[np.arange(len(owner)) - 1], -1)[order]
        last = back[np.cumsum(pieces) - 1]
        owner, first, size = owner[order], first[order], size[order]
        grid = np.zeros((SEGMENT, len(owner)), np.uint8)
        steps = np.arange(SEGMENT)[:, None]
        live = steps < size[None, :]
        grid[live] = flat[(first[None, :] + steps)[live]]
        width = live.sum(axis=1)
        #: by step, segment and language: the state after it; phrases so far
        states = np.zeros((SEGMENT, len(owner), n), np.int32)
        counted = np.zeros((SEGMENT, len(owner), n), np.uint16)
        state = np.repeat(self.roots[None, :], len(owner), axis=0)
        found = np.zeros((len(owner), n), np.uint16)
        for t in range(int(size[0])):
            w = width[t]
            to = self.arcs[state[:w] + grid[t, :w, None]]
            found[:w] += (to >> 30).astype(np.uint16)
            state[:w] = to & (_NEW - 1)
            states[t, :w], counted[t, :w] = state[:w], found[:w]
        total, end, entry = found.astype(np.int64), state.copy(), np.repeat(self.roots[None, :], len(owner), axis=0)
        for _ in range(ROUNDS):
            wanted = np.where(before[:, None] >= 0, end[before], given[owner])
            seg = np.flatnonzero((wanted != entry).any(axis=1))
            if not len(seg):
                break
            entry[seg] = wanted[seg]
            # pairs of a segment and a language, until they meet the parse that began with the segment
            at, lang = (x.ravel() for x in np.broadcast_arrays(seg[:, None], np.arange(n)[None, :]))
            now, phrases = wanted[seg].ravel(), np.zeros(len(at), np.int64)
            for t in range(SEGMENT):
                ended = size[at] <= t
                if ended.any():  # never met: all of the segment is the parse that came in
                    total[at[ended], lang[ended]], end[at[ended], lang[ended]] = phrases[ended], now[ended]
                    at, lang, now, phrases = at[~ended], lang[~ended], now[~ended], phrases[~ended]
                if not len(at):
                    break
                to = self.arcs[now + grid[t, at]]
                phrases += to >> 30
                now = to & (_NEW - 1)
                met = now == states[t, at, lang]
                if met.any():  # the rest of the segment is as it was parsed
                    i, j = at[met], lang[met]
                    total[i, j] = phrases[met] + found[i, j] - counted[t, i, j].astype(np.int64)
                    end[i, j] = state[i, j]
                    at, lang, now, phrases = at[~met], lang[~met], now[~met], phrases[~met]
            total[at, lang], end[at, lang] = phrases, now
        else:
            self._follow(back, before, owner, given, grid, size, entry, total, end)
        counts = np.zeros((len(texts), n), np.int64)
        np.add.at(counts, owner, total)
        return counts, end[last]

    def _follow(self, back, before, owner, given, grid, size, entry, total, end) -> None:
        """Segments that still began with another state than the one before them left, one after the other: where parses never meet, as in repetitive texts, each is walked once more at most."""
        wanted = np.where(before[:, None] >= 0, end[before], given[owner])
        apart = (wanted != entry).any(axis=1)
        if not apart.any():
            return
        arcs, mask = memoryview(self.arcs), int(_NEW) - 1
        for s in back[int(np.argmax(apart[back])) :].tolist():
            want = end[before[s]] if before[s] >= 0 else given[owner[s]]
            for j in np.flatnonzero(want != entry[s]).tolist():
                state, phrases = int(want[j]), 0
                for c in grid[: size[s], s].tobytes():
                    to = arcs[state + c]
                    phrases += to >> 30
                    state = to & mask
                total[s, j], end[s, j] = phrases, state
            entry[s] = want

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, score from 0 to 1 and phrases a letter of each text.

        The score is the share of the winner when each language weighs 2 ** (-20 * its phrases / the winner's - 1)."""
        langs, scores, rates = [], [], []
        for row, n in zip(*self.phrases(texts), strict=True):
            if not n or not self.langs:
                langs.append(UNKNOWN), scores.append(0.0), rates.append(None)
                continue
            best = int(row.argmin())
            langs.append(self.langs[best])
            scores.append(round(float(1 / np.exp2(-20 * (row / row[best] - 1)).sum()), 6))
            rates.append(round(float(row[best]) / int(n), 6))
        return langs, scores, rates


def identify(df: DataFrame, sample: dict[str, str], *, text: str = "text") -> DataFrame:
    """df with lang_pred, score and phrase_rate of each whole text. The sample's bound makes it fit for sending to tasks."""

    built = CrossParser(sample)  # on the driver; its few arcs travel, and each task unfolds the table

    def make():
        parser = built.unfolded()

        def compute(texts):
            langs, scores, rates = [], [], []
            rows = [x or "" for x in texts.to_pylist()]
            for a, b in byte_batches(rows, parser.together()):
                for column, part in zip((langs, scores, rates), parser.predict(rows[a:b]), strict=True):
                    column += part
            return langs, scores, rates

        return compute

    return annotate(df, [text], [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("phrase_rate", T.DoubleType())], make)
