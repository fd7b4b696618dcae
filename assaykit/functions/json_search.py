"""Searches of JSON texts whose shape is not known: by key at any depth, whatever its case.

Spark's paths need a known depth, so a small parser walks each text in Arrow batches. Broken JSON has no values.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F


def _load(text: str | None):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def _entries(node, parent: str = "") -> Iterator[tuple[str, str, object, dict]]:
    """(parent key, key, value, mapping) of all mappings, depth first, in order."""
    if isinstance(node, dict):
        for key, value in node.items():
            yield parent, str(key).lower(), value, node
            yield from _entries(value, str(key).lower())
    elif isinstance(node, list):
        for value in node:
            yield from _entries(value, parent)


def _text(value) -> str | None:
    if value is None or isinstance(value, (dict, list)):
        return None
    return str(value).strip() or None


def values_of(c: Column, *keys: str) -> Column:
    """All non-empty scalars under the keys, in the order of a depth-first walk; lists give their elements."""
    wanted = {k.lower() for k in keys}

    @F.pandas_udf("array<string>")
    def find(rows: pd.Series) -> pd.Series:
        def one(text):
            hits = (v for _, k, v, _ in _entries(_load(text)) if k in wanted)
            return [t for v in hits for t in map(_text, v if isinstance(v, list) else [v]) if t]

        return rows.map(one)

    return find(c)


def first_value(c: Column, *keys: str) -> Column:
    return F.get(values_of(c, *keys), F.lit(0))


def first_mapping(c: Column, *keys: str) -> Column:
    """The first mapping that has one of the keys with something in it, as JSON."""
    wanted = {k.lower() for k in keys}

    @F.pandas_udf("string")
    def find(rows: pd.Series) -> pd.Series:
        return rows.map(lambda text: next((json.dumps(m, ensure_ascii=False) for _, k, v, m in _entries(_load(text)) if k in wanted and v not in (None, "", [], {})), None))

    return find(c)


def people(c: Column, names: tuple[str, ...], english: tuple[str, ...], within: tuple[str, ...]) -> Column:
    """Distinct names and English names under their keys, where the key or the one around it has one of the hints."""
    kinds, hints = ({k.lower() for k in names}, {k.lower() for k in english}), tuple(h.lower() for h in within)

    @F.pandas_udf("struct<names:array<string>,english:array<string>>")
    def find(rows: pd.Series) -> pd.DataFrame:
        out = []
        for text in rows:
            found: tuple[list[str], list[str]] = ([], [])
            for parent, key, value, _ in _entries(_load(text)):
                if any(h in parent or h in key for h in hints) and (t := _text(value)):
                    for k, lst in zip(kinds, found, strict=True):
                        if key in k and t not in lst:
                            lst.append(t)
            out.append(found)
        return pd.DataFrame(out, columns=["names", "english"])

    return find(c)
