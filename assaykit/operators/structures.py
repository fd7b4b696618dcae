"""Structured documents made in two passes: merged by normal ids, checked by rules that name where they fail.

Elements come as rows of arrays; they are exploded, joined on document and id, and gathered again in their order, so one document's
size doesn't matter to another's. Every rule gives rows of (document, path, rule, value), never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CLAIM_CLARITIES, COUPLINGS, ELEMENT_ROLES, NULLISH, OBSERVABILITIES, ROLES_OF_PARTS
from .linkage import element_key


def none_if_nullish(c: Column) -> Column:
    """Null for texts that only say null."""
    return F.when(~F.lower(F.trim(c)).isin(*NULLISH), c)


def merge_passes(first: DataFrame, second: DataFrame, key: str, elements: str = "key_elements", clarity: str = "key_element_clarity", name: str = "key_element_id") -> DataFrame:
    """key, position and element of the first pass with what the second says of it.

    Ids are compared by `linkage.element_key`; of several rows of an id the last counts, rows without an id don't. An element of which the second
    pass says nothing is `unresolved`, not in an independent claim, with an empty issue; elements keep their order, null ones go."""
    rows = first.select(key, F.posexplode(elements).alias("position", "element")).where("element IS NOT NULL").withColumn("_id", element_key(F.col(f"element.{name}")))
    told = second.select(key, F.posexplode(clarity).alias("_at", "_c")).where(f"_c IS NOT NULL AND _c.{name} <> ''")
    told = told.groupBy(key, element_key(F.col(f"_c.{name}")).alias("_id")).agg(F.max_by("_c", "_at").alias("_c"))
    clear = F.coalesce(F.nullif(F.col("_c.claim_clarity"), F.lit("")), F.lit("unresolved"))
    return rows.join(told, [key, "_id"], "left").select(
        key, "position", "element", F.coalesce("_c.in_independent_claim", F.lit(False)).alias("in_independent_claim"), clear.alias("claim_clarity"), F.coalesce("_c.clarity_issue", F.lit("")).alias("clarity_issue")
    )


def gathered(rows: DataFrame, key: str, position: str = "position") -> DataFrame:
    """One row a document: all rows' columns as structs, in order."""
    rest = [c for c in rows.columns if c not in (key, position)]
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(position, F.struct(*rest).alias("_row")))).alias("_rows"))
    return held.select(key, F.transform("_rows", lambda x: x["_row"]).alias("elements"))


def violations(elements: DataFrame, flow: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Rows of document, path, rule and value for all that is wrong.

    elements: key, position, key_element_id, core_role, claim_clarity, observability. flow: key, position, key_element_id,
    next_key_element_id, coupling_strength. parts of claims: key, claim, position, claim_element_id, maps_to_key_element_id, role.
    References must be ids of elements as they are written; a part may map to nothing."""
    at = lambda head, field, c="position": F.concat(F.lit(f"{head}["), F.col(c).cast("string"), F.lit(f"].{field}"))

    def wrong(rows: DataFrame, path: Column, rule: str, value: Column, holds: Column) -> DataFrame:
        return rows.where(~F.coalesce(holds, F.lit(False))).select(key, path.alias("path"), F.lit(rule).alias("rule"), value.cast("string").alias("value"))

    out = []
    for rows, head, field, allowed in (
        (elements, "key_elements", "core_role", ELEMENT_ROLES), (elements, "key_elements", "claim_clarity", CLAIM_CLARITIES), (elements, "key_elements", "observability", OBSERVABILITIES), (flow, "key_flow", "coupling_strength", COUPLINGS),
    ):
        out.append(wrong(rows, at(head, field), "not_allowed", F.col(field), F.col(field).isin(*allowed)))
    of_part = lambda field: F.concat(F.lit("claims["), F.col("claim").cast("string"), F.lit("]."), at("claim_elements", field))
    out.append(wrong(parts, of_part("role"), "not_allowed", F.col("role"), F.col("role").isin(*ROLES_OF_PARTS)))
    out.append(wrong(elements, at("key_elements", "key_element_id"), "missing", F.col("key_element_id"), F.col("key_element_id").isNotNull()))
    known = elements.where("key_element_id IS NOT NULL").select(key, F.col("key_element_id").alias("_to")).distinct()
    dangling = [
        *(flow.select(key, at("key_flow", f).alias("path"), F.coalesce(f, F.lit("")).alias("_to")) for f in ("key_element_id", "next_key_element_id")),
        parts.select(key, of_part("maps_to_key_element_id").alias("path"), none_if_nullish(F.col("maps_to_key_element_id")).alias("_to")).where("_to IS NOT NULL"),
    ]
    for rows in dangling:
        out.append(rows.join(known, [key, "_to"], "left_anti").select(key, "path", F.lit("unknown_element").alias("rule"), F.col("_to").alias("value")))
    every = out[0]
    for rows in out[1:]:
        every = every.unionByName(rows)
    return every
