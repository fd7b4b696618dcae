"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return [w.decode() for w in SPACE.findall((text or "").encode())]


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None) -> set[tuple[str, ...]]:
    w = words(lowered(text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def groups(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id), for distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        shared = Counter()
        for g in s:
            shared.update(holders[g])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for g in s:
            holders[g].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def removed(rows: list[tuple[int, str | None]], window: int = 13) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple[str, ...], int] = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


EDGE = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def bare(text: str | None) -> list[str]:
    return [x for w in words(lowered(text or "")) if (x := w.strip(EDGE))]


def contained(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> dict[tuple[int, int], float]:
    """(doc, item) -> the best weighted similarity of a window, where that is 0.75 or more."""
    known = [(i, w, min(5, len(w))) for i, t in items if (w := bare(t))]
    sets = {i: {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} for i, w, k in known}
    counts = Counter(g for s in sets.values() for g in s)
    weight = lambda g: 1 + math.log((len(known) + 1) / (counts[g] + 1)) if g in counts else 1 + math.log(len(known) + 1)
    out = {}
    for d, t in docs:
        w = bare(t)
        grams = {k: {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} for k in range(1, 6)}
        for i, iw, k in known:
            n, best = len(iw), 0.0
            if not sets[i] & grams[k]:
                continue
            for s in range(k - n, len(w) - k + 1):
                part = w[max(0, s) : s + n]
                own = {tuple(part[a : a + k]) for a in range(len(part) - k + 1)}
                shared = sum(weight(g) for g in own & sets[i])
                best = max(best, shared / sum(weight(g) for g in own | sets[i]))
            if best >= 0.75:
                out[d, i] = best
    return out


def base_secrets(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)
