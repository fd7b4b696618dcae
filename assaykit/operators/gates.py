"""Quality gates as columns: verdicts on axes and artefacts, and where work goes next."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import AXIS_STATES, EXTERNAL_EVIDENCE_AXES


def coerced_state(axis: Column, state: Column) -> Column:
    """Axes that use no outside evidence can't ask for more of it: they are scored again instead."""
    return F.when((state == "query_rewriting") & ~axis.isin(*EXTERNAL_EVIDENCE_AXES), "valuation_retry").otherwise(state)


def boolean(c: Column, fallback: Column) -> Column:
    """true or false in any case, else the fallback."""
    return F.when(F.lower(F.trim(c)) == "true", True).when(F.lower(F.trim(c)) == "false", False).otherwise(fallback)


def axis_state(axis: Column, state: Column, action: Column, passed: Column, fallback: Column) -> Column:
    """A model's verdict on an axis: its state, else the action it asks for, else whether it passed, else the rule's verdict."""
    some = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rule = F.when(some(fallback).isin(*AXIS_STATES), some(fallback)).otherwise("passed")
    out = F.when(some(state).isin(*AXIS_STATES), some(state)).when(some(action).isin("valuation_retry", "query_rewriting"), some(action)).when(boolean(passed, some(fallback) == "passed"), "passed").otherwise(rule)
    return coerced_state(axis, out)


def flags(state: Column) -> Column:
    return F.struct((state == "passed").alias("passed"), (state == "valuation_retry").alias("needs_retry"), (state == "query_rewriting").alias("needs_more_evidence"))


def next_team(states: Column) -> Column:
    """Over all axes' states: research if any lacks evidence, valuation if any is to be scored again, else writing."""
    return F.when(F.array_contains(states, "query_rewriting"), "research").when(F.array_contains(states, "valuation_retry"), "valuation").otherwise("writing")


def retry_axes(axes: Column, states: Column, tried: Column, most: Column) -> Column:
    """Axes to score again: those that asked for it and have tries left. tried: a map of axis to tries."""
    pairs = F.arrays_zip(axes.alias("a"), states.alias("s"))
    return F.transform(F.filter(pairs, lambda x: (x["s"] == "valuation_retry") & (F.coalesce(tried[x["a"]], F.lit(0)) < most)), lambda x: x["a"])


def writing_step(summary_ok: Column, report_ok: Column) -> Column:
    """What is written next: both, one of them, or the merge."""
    return F.when(~summary_ok & ~report_ok, "writing_team").when(~summary_ok, "summary").when(~report_ok, "final_report").otherwise("final_merge")


def degraded(structural: Column, scored_axes: Column, evidence: Column, warnings: Column) -> Column:
    """A result to hold back: structure broken, nothing scored, no evidence, or nothing to compare the technology with."""
    return F.coalesce(structural, F.lit(False)) | (scored_axes == 0) | (evidence == 0) | F.array_contains(warnings, "technology_comparison_empty")


def empty_reason(warnings: Column, unreachable: Column, missing: Column) -> Column:
    """Why there is no outside evidence: missing configuration before failed calls before an empty result."""
    said = F.concat_ws(" ", F.array_join(F.coalesce(warnings, F.array().cast("array<string>")), " "), missing)
    return F.when(said.contains("is not set") | said.contains("미설정"), "missing_config").when(F.coalesce(unreachable, F.lit(False)) | (F.coalesce(missing, F.lit("")) != ""), "calls_failed").otherwise("no_results")


def joined_gaps(missing: Column, states: Column, issues: Column) -> Column:
    """Known gaps and the issues of axes that did not pass, each once, in order. states and issues are arrays over axes."""
    flagged = F.filter(F.arrays_zip(states.alias("s"), issues.alias("i")), lambda x: x["s"] != "passed")
    return F.array_distinct(F.concat(F.coalesce(missing, F.array().cast("array<string>")), F.flatten(F.transform(flagged, lambda x: x["i"]))))
