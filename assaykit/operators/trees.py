"""Nested documents of any depth as rows: JSON and XML walked without a schema.

`walk` gives a row for each node, so searches in unknown shapes are filters and joins on rows. Spark's paths and variants reach known
depths; the walk itself is a small helper over a stack in Arrow batches, one text at a time, linear in its length.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

_NODE = "position long, parent long, depth int, path string, key string, idx long, kind string, parent_kind string, parent_key string, value string"
#: Rows that are handed on together.
HELD = 10_000


def _nodes(text: str | None) -> Iterator[tuple]:
    try:
        root = json.loads(text) if text else None
    except (ValueError, RecursionError):  # no JSON, or nested beyond what the parser takes
        return
    if root is None:
        return
    stack: list[tuple] = [(root, -1, 0, "$", None, None, None, None)]
    position = 0
    while stack:
        node, parent, depth, path, key, idx, parent_kind, parent_key = stack.pop()
        kind = "object" if isinstance(node, dict) else "array" if isinstance(node, list) else "null" if node is None else "boolean" if isinstance(node, bool) else "string" if isinstance(node, str) else "number"
        value = node if kind == "string" else json.dumps(node) if kind in ("number", "boolean") else None
        yield position, parent, depth, path, key, idx, kind, parent_kind, parent_key, value
        children = []
        if kind == "object":
            children = [(v, position, depth + 1, f"{path}.{k}", k, i, kind, key) for i, (k, v) in enumerate(node.items())]
        elif kind == "array":
            children = [(v, position, depth + 1, f"{path}[{i}]", None, i, kind, key) for i, v in enumerate(node)]
        stack.extend(reversed(children))
        position += 1


def walk(df: DataFrame, key: str, column: str) -> DataFrame:
    """A row for each node of the JSON in `column`, by key: position (depth first, the root is 0), the parent's position, depth, path, the key under which it is,
    its index among its siblings, kind (object, array, string, number, boolean, null), the parent's kind and key, and the value of scalars as text.

    Null, empty and broken texts have no nodes. A key that comes twice in an object has its last value, in its first place."""
    schema = df.select(F.col(key).alias("doc")).schema.simpleString().removeprefix("struct<").removesuffix(">").replace("doc:", "doc ") + ", " + _NODE
    names = ["doc", *(x.strip().split(" ")[0] for x in _NODE.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, held = [], []

            def out() -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)]  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), *columns], names=names)  # noqa: B023

            types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            for i, text in enumerate(batch.column(1)):
                for node in _nodes(text.as_py()):
                    owners.append(i)
                    held.append(node)
                    if len(held) >= HELD:
                        yield out()
                        owners, held = [], []
            if held:
                yield out()

    return df.select(F.col(key).alias("doc"), F.col(column).cast("string").alias("json")).mapInArrow(run, schema)


def _listed(tokens: tuple[str, ...]) -> tuple[Column, Column]:
    """Whether a node is an element of a list under a key with one of the tokens, and whether it is an object under one."""
    has = lambda c: F.coalesce(F.lower(c).rlike("|".join(tokens)), F.lit(False))
    return (F.col("parent_kind") == "array") & has(F.col("parent_key")), (F.col("kind") == "object") & (F.col("parent_kind") == "object") & has(F.col("key"))


def _order(element: Column) -> Column:
    met = F.when(element, F.col("parent")).otherwise(F.col("position"))
    return F.struct(met.alias("met"), F.when(element, F.col("idx")).otherwise(-1).alias("idx"))


def listed_under(nodes: DataFrame, tokens: tuple[str, ...]) -> DataFrame:
    """Items under keys whose name has one of the tokens, whatever the case: elements of lists and objects, at any depth.

    Items come when the walk meets the list or object that holds them, so a list's elements come before what is nested in them.
    Returns doc, item (from 1), position and path of the item's node; its own values are the nodes with that parent."""
    element, own = _listed(tokens)
    found = nodes.where(element | own).select("doc", "position", "path", _order(element).alias("_order"))
    items = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("_order", "position", "path"))).alias("_items"))
    return items.select("doc", F.posexplode("_items").alias("_i", "_item")).select("doc", (F.col("_i") + 1).alias("item"), "_item.position", "_item.path")


def fields(nodes: DataFrame, items: DataFrame, names: list[str]) -> DataFrame:
    """doc, item and the named scalars of each item, whatever the keys' case; null where an item has none."""
    wanted = [n.lower() for n in names]
    own = nodes.where(F.lower("key").isin(wanted) & F.col("value").isNotNull()).select("doc", F.col("parent").alias("position"), F.lower("key").alias("_k"), "value", F.col("position").alias("_at"))
    rows = items.select("doc", "item", "position").join(own, ["doc", "position"], "left")
    return rows.groupBy("doc", "item").agg(*(F.min_by(F.when(F.col("_k") == n.lower(), F.col("value")), F.when(F.col("_k") == n.lower(), F.col("_at"))).alias(n) for n in names))


def listed_fields(nodes: DataFrame, tokens: tuple[str, ...], names: list[str]) -> DataFrame:
    """doc, item, position and depth of the items of `listed_under` with their named scalars as in `fields`.

    Nodes are walked once; an item and its scalars meet by grouping, so nothing is joined or broadcast, however many nodes a small text makes."""
    wanted = [n.lower() for n in names]
    element, own = _listed(tokens)
    scalar = F.coalesce(F.lower("key").isin(wanted), F.lit(False)) & F.col("value").isNotNull()
    none = lambda kind: F.lit(None).cast(kind)
    as_item = F.struct(F.col("position").alias("node"), F.struct(_order(element).alias("order"), "depth").alias("i"), none("string").alias("k"), none("string").alias("v"), none("long").alias("at"))
    as_scalar = F.struct(F.col("parent").alias("node"), none("struct<order:struct<met:bigint,idx:bigint>,depth:int>").alias("i"), F.lower("key").alias("k"), F.col("value").alias("v"), F.col("position").alias("at"))
    # a scalar may itself be an element of a list, and then is both
    both = F.array_compact(F.array(F.when(element | own, as_item), F.when(scalar, as_scalar)))
    rows = nodes.where(element | own | scalar).select("doc", F.inline(both))
    met = rows.groupBy("doc", "node").agg(F.max("i").alias("i"), *(F.min_by(F.when(F.col("k") == n, F.col("v")), F.when(F.col("k") == n, F.col("at"))).alias(f"_f{j}") for j, n in enumerate(wanted)))
    held = met.where("i IS NOT NULL").withColumn("item", F.row_number().over(Window.partitionBy("doc").orderBy("i.order", "node")))
    return held.select("doc", "item", F.col("node").alias("position"), F.col("i.depth").alias("depth"), *(F.col(f"_f{j}").alias(n) for j, n in enumerate(names)))


def _object(root: ET.Element):
    """An element as strings, mappings and lists; a tag that comes again makes a list. Namespaces are left out."""
    made: dict[int, object] = {}
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        children = list(node)
        if not children:
            made[id(node)] = (node.text or "").strip()
        elif not done:
            stack.append((node, True))
            stack.extend((c, False) for c in children)
        else:
            many: dict[str, list] = {}
            for c in children:
                many.setdefault(c.tag.rpartition("}")[2], []).append(made.pop(id(c)))
            made[id(node)] = {k: v if len(v) > 1 else v[0] for k, v in many.items()}
    return made[id(root)]


def xml_to_json(c: Column) -> Column:
    """XML as JSON text: what stands in the root element. Null where it is no XML, or where it declares a document type (entities could grow without bound)."""

    @F.pandas_udf("string")
    def convert(rows: pd.Series) -> pd.Series:
        def one(text):
            if not text or "<!DOCTYPE" in text[:2_000].upper() or "<!ENTITY" in text.upper():
                return None
            try:
                root = ET.fromstring(text.strip())
            except (ET.ParseError, ValueError):
                return None
            return json.dumps(_object(root), ensure_ascii=False)

        return rows.map(one)

    return convert(c)


def as_list(nodes: DataFrame, path: str) -> DataFrame:
    """doc, idx, position of what is at a path as a list: elements of an array, or the one value that stands there; an empty text or null is none."""
    under = nodes.where(F.col("path") == path)
    elements = under.where("kind = 'array'").select("doc", F.col("position").alias("_p")).join(nodes.select("doc", F.col("parent").alias("_p"), "idx", "position"), ["doc", "_p"]).drop("_p")
    single = under.where("kind NOT IN ('array', 'null') AND (value IS NULL OR value <> '')").select("doc", F.lit(0).cast("long").alias("idx"), "position")
    return elements.unionByName(single)
