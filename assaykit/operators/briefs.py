"""Short written summaries: checked, then laid out as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import text
from ..functions.patents import let, once

#: The fields of a brief and the least and most items of its lists, in the order of the text.
SENTENCES = ("one_line_summary", "problem", "core_idea", "expected_effect")
LISTS = {"key_components": (3, 6), "operation_steps": (3, 5)}
BRIEF = "struct<one_line_summary:string,problem:string,core_idea:string,key_components:array<string>,operation_steps:array<string>,expected_effect:string>"


def _sentence(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


@once
def brief(raw: Column) -> Column:
    """A brief with sentences squeezed and lists cut; a list with too few items is empty."""

    def listed(name: str) -> Column:
        least, most = LISTS[name]
        items = F.slice(F.filter(F.transform(F.coalesce(raw[name], F.array().cast("array<string>")), _sentence), lambda x: x != ""), 1, most)
        return let(items, lambda x: F.when(F.size(x) >= least, x).otherwise(F.array().cast("array<string>")))

    names = ("one_line_summary", "problem", "core_idea", "key_components", "operation_steps", "expected_effect")
    return F.struct(*((listed(n) if n in LISTS else _sentence(raw[n])).alias(n) for n in names))


def missing(b: Column) -> Column:
    """The fields that a brief lacks."""
    rules = {n: b[n] == "" for n in SENTENCES} | {n: F.size(b[n]) == 0 for n in LISTS}
    order = ("one_line_summary", "problem", "core_idea", "key_components", "operation_steps", "expected_effect")
    return F.array_compact(F.array(*(F.when(rules[n], F.lit(n)) for n in order)))


def markdown(b: Column) -> Column:
    """A whole brief as Markdown; null where a field is missing. Headings are fixed values."""
    bullets = F.array_join(F.transform(b["key_components"], lambda x: F.concat(F.lit("- "), x)), "\n")
    steps = F.array_join(F.transform(b["operation_steps"], lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    part = lambda head, body: F.concat(F.lit(f"\n\n{head}\n\n"), body)
    whole = F.concat(
        F.lit("# 특허 이해 요약"), part("## 한 줄 요약", b["one_line_summary"]), part("## 해결하려는 문제", b["problem"]), part("## 핵심 아이디어", b["core_idea"]), part("## 주요 기술/구성", bullets),
        F.lit("\n\n## 작동 방식 "), F.size(b["operation_steps"]).cast("string"), F.lit("단계\n\n"), steps, part("## 기대 효과", b["expected_effect"]),
    )
    return F.when(F.size(missing(b)) == 0, whole)


def table(pairs: dict[str, Column], empty: str = "-") -> Column:
    """Names and values as a Markdown table; blank values show a dash, bars are escaped."""
    row = lambda k, v: F.concat(F.lit(f"| {k} | "), F.coalesce(text.present(F.replace(F.regexp_replace(v.cast("string"), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))), F.lit(empty)), F.lit(" |"))
    return F.concat_ws("\n", F.lit("| 항목 | 내용 |"), F.lit("|---|---|"), *(row(k, v) for k, v in pairs.items()))
