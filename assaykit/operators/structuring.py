"""Documents to structures by two model passes, kept in a store by content.

The first pass names elements and how they follow each other; the second reads the claims with these elements and says how clear each
is. What both say is merged by element (`structures.merge_passes`). A document whose passes fail has no structure and is asked again
next time; the others are looked up, however often they come and whatever their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.cache import ResultCache, content_key
from ..sources.shared import shared_dir, stored
from .model import Model, complete
from . import structures

FIRST = "struct<key_elements:array<struct<key_element_id:string,key_element_name:string,why_essential:string,core_role:string>>,key_flow:array<struct<key_element_id:string,next_key_element_id:string,coupling_strength:string>>>"
SECOND = "struct<key_element_clarity:array<struct<key_element_id:string,in_independent_claim:boolean,claim_clarity:string,clarity_issue:string>>,claims:array<struct<claim_no:string,type:string,depends_on:string>>>"
ELEMENT = "struct<key_element_id:string,key_element_name:string,why_essential:string,core_role:string,in_independent_claim:boolean,claim_clarity:string,clarity_issue:string>"
STRUCTURE = f"struct<key_elements:array<{ELEMENT}>,key_flow:array<struct<key_element_id:string,next_key_element_id:string,coupling_strength:string>>,claims:array<struct<claim_no:string,type:string,depends_on:string>>>"


def _passes(rows: DataFrame, key: str, specification: str, claims: str, drawings: str, first: Model, second: Model) -> DataFrame:
    """key and _reply: the merged structure as JSON; rows whose passes failed are missing."""
    spark = rows.sparkSession
    kept = lambda df, purpose: stored(df, shared_dir(spark, purpose))  # noqa: E731  each call is made once
    asked = rows.select(key, claims, F.to_json(F.struct(F.col(specification).alias("specification"), F.col(drawings).alias("drawings"))).alias("_prompt"))
    one = kept(complete(asked, "_prompt", first).select(key, claims, F.from_json("reply", FIRST).alias("_one")), "first-pass")
    told = F.transform("_one.key_elements", lambda e: F.struct(e["key_element_id"], e["key_element_name"], e["why_essential"], e["core_role"]))
    both = kept(complete(one.where("_one IS NOT NULL").withColumn("_prompt", F.to_json(F.struct(F.col(claims).alias("claims"), told.alias("key_elements")))), "_prompt", second), "second-pass")
    done = both.select(key, "_one", F.from_json("reply", SECOND).alias("_two")).where("_two IS NOT NULL")
    merged = structures.merge_passes(done.select(key, "_one.key_elements"), done.select(key, "_two.key_element_clarity"), key)
    flat = merged.select(key, "position", "element.*", "in_independent_claim", "claim_clarity", "clarity_issue")
    elements = structures.gathered(flat, key)
    whole = F.struct(F.coalesce("elements", F.array().cast(f"array<{ELEMENT}>")).alias("key_elements"), F.col("_one.key_flow").alias("key_flow"), F.col("_two.claims").alias("claims"))
    return done.join(elements, key, "left").select(key, F.to_json(whole).alias("_reply"))


def structured(docs: DataFrame, cache: ResultCache, *, specification: str, claims: str, drawings: str, first: Model, second: Model, model: str, effort: str = "") -> DataFrame:
    """docs with structure (a STRUCTURE, null where a pass failed). Equal contents are asked for once, and only if the store has no whole entry.

    Both passes run on the misses only; their replies are stored before they are read, so a lost executor asks nothing twice."""
    keyed = docs.withColumn("_key", content_key(*map(F.col, (specification, claims, drawings)), model=model, effort=effort))
    filled = cache.fill(keyed, "_key", lambda rows: _passes(rows, "_key", specification, claims, drawings, first, second), "_reply")
    return filled.withColumn("structure", F.from_json("_reply", STRUCTURE)).drop("_key", "_reply")


def light(structure: Column, elements: int = 12, flow: int = 20) -> Column:
    """Of a structure what an axis is shown: its first elements by name and role, and its flow."""
    part = F.transform(F.slice(structure["key_elements"], 1, elements), lambda e: F.struct(e["key_element_id"], e["key_element_name"], e["core_role"]))
    return F.struct(part.alias("key_elements"), F.slice(structure["key_flow"], 1, flow).alias("key_flow"))
