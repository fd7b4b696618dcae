"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are lower-cased (A-Z) and freed of ASCII punctuation around them; shingles are five words. Each template is looked for
by windows of its own number of shingles at every position; where they reach over the document's ends they are cut there.
BANDS bands of one MinHash each are compared: a window that holds at least 0.75 of a template's shingles in place has a Jaccard
similarity of 0.6 or more with it, so the chance that no band agrees is at most 0.4 ** BANDS (4e-7 with 16). Documents with
fewer than 0.75 of a template's shingles can't match it and are not hashed for it. A retrieved template matches when the window
holds 0.75 or more of its distinct shingles; overlapping windows of one template give one match, the best and then the first.

Templates are notices (TEMPLATES) and whole texts (license_texts), a small driver-side list (bounded by `check_templates`). Names are
SPDX ids; names of notices can have an ending. A text that holds enough of a relative's template matches both. Null and empty texts
have no matches; repeated rows match alike; other columns are kept, except those that a new column replaces. Templates need five words.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import annotate, byte_batches, mix, utf8, windows_of, words_of

K, LEAST, BANDS = 5, 0.75, 16
#: Bytes of templates that may be sent to every task.
MOST_BYTES = 4 << 20

#: Notices of common licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0-licensed": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "LGPL-notice": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "LGPL-2.0-notice": "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "ISC-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-1.0": "made available under the terms of the Eclipse Public License v1.0",
    "EPL-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "EPL-2.0-v": "made available under the terms of the Eclipse Public License v2.0",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "CC0-1.0-dedication": "This work is dedicated to the public domain under CC0 1.0 Universal",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
}


def whole_texts() -> dict[str, str]:
    """The license texts beside this file, read on the driver."""
    return {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def check_templates(templates: dict[str, str]) -> None:
    if sum(len(t.encode()) for t in templates.values()) > MOST_BYTES:
        raise ValueError(f"templates beyond {MOST_BYTES} bytes: scan in several calls")
    for name, text in templates.items():
        if len(shingles(text)) == 0:
            raise ValueError(f"template {name} has fewer than {K} words")


def shingles(text: str) -> np.ndarray:
    hashes, owner, _, _ = words_of([text.encode()], lower=True, trim=True)
    return windows_of(hashes, owner, K)[0]


_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def minhashes(sets: np.ndarray) -> np.ndarray:
    """Of each row of shingle hashes one minimum a band."""
    return np.stack([mix(sets ^ seed).min(axis=1) for seed in _SEEDS], axis=1)


_NONE = np.uint64((1 << 64) - 1)
#: Window starts whose MinHashes are computed together.
SPAN = 1 << 16


def sliding_minhashes(grams: np.ndarray, solid: np.ndarray, size: int) -> np.ndarray:
    """A row for each band: its minimum over each window of so many shingles; those that are not solid are none."""
    low = np.where(solid, mix(grams[None, :] ^ _SEEDS[:, None]), _NONE)
    width = 1
    while width < size:
        step = min(width, size - width)
        low = np.minimum(low[:, :-step], low[:, step:])
        width += step
    return low


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        grams = [shingles(templates[n]) for n in self.names]
        self.sizes = [len(g) for g in grams]
        self.sets = [np.unique(g) for g in grams]
        self.lengths = np.array([len(s) for s in self.sets])
        self.any = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.member = np.array([np.isin(self.any, s) for s in self.sets])
        self.bands = [minhashes(s[None, :])[0] for s in self.sets]

    def scan(self, texts: list[bytes]) -> list[list[tuple[str, int, int, float]]]:
        """Of each text its matches (template, first word, word after the last, containment) by first word, then template."""
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        hashes, owner, _, _ = words_of(texts, lower=True, trim=True)
        grams, at = windows_of(hashes, owner, K)
        if not len(grams) or not len(self.any):
            return out
        spot = np.minimum(np.searchsorted(self.any, grams), len(self.any) - 1)
        hit = np.flatnonzero(self.any[spot] == grams)
        edges = np.searchsorted(owner[at], np.arange(len(texts) + 1))
        bounds = np.searchsorted(hit, edges)
        for d in np.unique(owner[at[hit]]).tolist():
            places = hit[bounds[d] : bounds[d + 1]]
            own = spot[places]
            held = self.member[:, np.unique(own)].sum(axis=1)
            for i in np.flatnonzero(held >= LEAST * self.lengths).tolist():
                mine = self.member[i, own]
                found = self._windows(i, grams[edges[d] : edges[d + 1]], places[mine] - edges[d], own[mine])
                out[d] += [(self.names[i], a, b, score) for a, b, score in found]
        return [self._best(x) for x in out]

    def _windows(self, i: int, grams: np.ndarray, places: np.ndarray, kinds: np.ndarray):
        """Windows (first word, word after the last, containment) of a text that hold enough of template i, whose shingles are at these places."""
        size, n = self.sizes[i], len(grams)
        # a shingle counts in windows that start after the one before of its kind: at its place or up to size - 1 earlier
        order = np.lexsort((places, kinds))
        places, kinds = places[order], kinds[order]
        since = places - size + 1
        again = np.flatnonzero(kinds[1:] == kinds[:-1]) + 1
        since[again] = np.maximum(since[again], places[again - 1] + 1)
        change = np.zeros(n + size, np.int64)
        np.add.at(change, since + size - 1, 1)
        np.add.at(change, places + size, -1)
        counts = np.cumsum(change)[:-1]
        starts = np.flatnonzero(counts >= LEAST * self.lengths[i])
        done = 0
        while done < len(starts):
            base = int(starts[done])
            to = int(np.searchsorted(starts, base + SPAN))
            some = starts[done:to]
            spread = np.arange(base - size + 1, int(some[-1]) + 1)  # places of all shingles of these windows
            solid = (spread >= 0) & (spread < n)
            low = sliding_minhashes(grams[np.clip(spread, 0, n - 1)], solid, size)
            for s in some[(low[:, some - base] == self.bands[i][:, None]).any(axis=0)].tolist():
                first = s - size + 1
                yield max(0, first), min(n, first + size) + K - 1, float(counts[s] / self.lengths[i])
            done = to

    @staticmethod
    def _best(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
        best: list[tuple[str, int, int, float]] = []
        runs: dict[str, int] = {}
        for m in sorted(found, key=lambda m: (m[0], m[1], m[2])):
            k = runs.get(m[0])
            if k is not None and m[1] < best[k][2]:
                if m[3] > best[k][3]:
                    best[k] = m
            else:
                runs[m[0]] = len(best)
                best.append(m)
        return sorted(best, key=lambda m: (m[1], m[0]))


def scan(df: DataFrame, templates: dict[str, str] | None = None, *, text: str = "text") -> DataFrame:
    """df with licenses: an array of (license, first_word, end_word, containment) of each whole text."""
    templates = templates or TEMPLATES | whole_texts()
    check_templates(templates)
    match = T.StructType([T.StructField("license", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("containment", T.DoubleType())])

    def make():
        scanner = Scanner(templates)

        def compute(texts):
            data, out = utf8(texts), []
            for a, b in byte_batches(data):
                out += [[dict(zip(match.names, m, strict=True)) for m in x] for x in scanner.scan(data[a:b])]
            return [out]

        return compute

    return annotate(df, [text], [T.StructField("licenses", T.ArrayType(match))], make)


def matches(df: DataFrame, templates: dict[str, str] | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each match: the document's id, license, first_word, end_word, containment."""
    found = scan(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), templates)
    return found.select("doc_id", F.explode("licenses").alias("m")).select("doc_id", "m.license", "m.first_word", "m.end_word", F.round("m.containment", 4).alias("containment"))
