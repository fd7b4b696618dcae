"""What links an invention to a market, from its structured elements, and checks of structured records.

Elements are an array of (name, why, supports), supports an array of (section, content)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..config import CONNECTIVES, DEPENDENT_MARKS, GENERIC_ELEMENTS, INDEPENDENT_MARKS, LINKAGE_ACTIONS, LINKAGE_SECTIONS, NULLISH
from ..functions import text
from ..functions.patents import let


def _some(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def support_texts(element: Column, sections: tuple[str, ...] = LINKAGE_SECTIONS) -> Column:
    """Distinct contents of an element's supports in the named sections, whatever their spaces."""
    of = F.filter(F.coalesce(element["supports"], F.array().cast("array<struct<section:string,content:string>>")), lambda s: F.replace(_some(s["section"]), F.lit(" "), F.lit("")).isin(*sections))
    return F.array_distinct(F.filter(F.transform(of, lambda s: _some(s["content"])), lambda x: x != ""))


def has_action(c: Column) -> Column:
    return text.hits(c, LINKAGE_ACTIONS) > 0


def shortened(c: Column, most: int = 140) -> Column:
    """A text within so many characters: up to its first connective, else cut with dots."""

    def cut(x: Column) -> Column:
        head = F.coalesce(*(F.when(F.contains(x, F.lit(s)), F.substring_index(x, s, 1)) for s in CONNECTIVES), x)
        return let(head, lambda h: F.concat(F.regexp_replace(F.substring(h, 1, most), "[ ,.;]+$", ""), F.when(F.length(h) > most, "...").otherwise("")))

    return let(F.regexp_replace(_some(c), r"\s+", " "), lambda x: F.when(F.length(x) <= most, x).otherwise(cut(x)))


def phrase(element: Column) -> Column:
    """The first text of an element that names an action, shortened; empty without one."""
    every = F.concat(F.array(_some(element["why"])), support_texts(element))
    return F.coalesce(shortened(F.get(F.filter(every, has_action), F.lit(0))), F.lit(""))


def prioritised(elements: Column) -> Column:
    """Elements by how many actions they name, generic ones after others, then as they come."""

    def key(e: Column, i: Column) -> Column:
        words = F.concat_ws(" ", _some(e["name"]), _some(e["why"]), F.array_join(support_texts(e), " "))
        return F.struct((-text.hits(words, LINKAGE_ACTIONS)).alias("a"), _some(e["name"]).isin(*GENERIC_ELEMENTS).alias("g"), i.alias("i"), e.alias("e"))

    return F.transform(F.array_sort(F.transform(elements, key)), lambda x: x["e"])


def core_functions(elements: Column, most: int = 6) -> Column:
    """Phrases and solution texts of the first five elements."""
    first = F.slice(prioritised(elements), 1, 5)
    own = lambda e: F.array_distinct(F.filter(F.concat(F.array(phrase(e)), support_texts(e, ("과제해결수단",))), lambda x: x != ""))
    return F.slice(F.flatten(F.transform(first, own)), 1, most)


def problem(elements: Column) -> Column:
    """The first element's phrase or reason that says anything."""
    told = F.transform(prioritised(elements), lambda e: let(phrase(e), lambda p: F.when(p != "", p).otherwise(_some(e["why"]))))
    return F.coalesce(F.get(F.filter(told, lambda x: x != ""), F.lit(0)), F.lit(""))


def effects(elements: Column, most: int = 6) -> Column:
    return F.slice(F.array_distinct(F.flatten(F.transform(elements, lambda e: support_texts(e, ("효과", "발명의효과"))))), 1, most)


def hints(elements: Column, functions: Column, expected: Column, most: int = 8) -> Column:
    """Short lines that link elements, functions and effects to a market."""
    why = lambda e: let(phrase(e), lambda p: F.when(p != "", p).otherwise(_some(e["why"])))
    named = F.transform(F.slice(prioritised(elements), 1, 4), lambda e: let(why(e), lambda w: F.when((_some(e["name"]) != "") & (w != ""), F.concat(_some(e["name"]), F.lit(": "), w)).otherwise("")))
    led = lambda values, head: F.transform(F.slice(values, 1, 3), lambda x: F.when(_some(x) != "", F.concat(F.lit(head), x)).otherwise(""))
    return F.slice(F.array_distinct(F.filter(F.concat(named, led(functions, "핵심 기능: "), led(expected, "기대 효과: ")), lambda x: x != "")), 1, most)


# --- records --------------------------------------------------------------------------------------


def claim_type(kind: Column, depends_on: Column) -> Column:
    """independent or dependent from a label in several languages (independent is tried first), else by whether the claim depends on one."""
    marked = lambda words: reduce(lambda a, b: a | b, [F.contains(_some(kind), F.lit(w)) for w in words])
    low = F.lower(_some(kind))
    rest = F.when(F.lower(_some(depends_on)).isin(*NULLISH), "independent").otherwise("dependent")
    return F.when(marked(INDEPENDENT_MARKS) | low.contains("independent"), "independent").when(marked(DEPENDENT_MARKS) | low.contains("dependent"), "dependent").otherwise(rest)


def element_key(c: Column) -> Column:
    """A join key of an element's id: no spaces, upper case, numbers without leading zeros."""
    return F.regexp_replace(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")), "(?<![0-9])0+(?=[0-9])", "")


def axis_issues(label: Column, score: Column, grade: Column, rationale: Column, confidence: Column) -> Column:
    """What an axis' result breaks: texts that are empty, bounds, grades that do not exist. Nulls break what they stand in."""
    broken = lambda ok: ~F.coalesce(ok, F.lit(False))
    rules = {"label": _some(label) != "", "score": score.between(0, 100), "grade": grade.isin("A", "B", "C"), "rationale": _some(rationale) != "", "confidence": confidence.between(0, 1)}
    return F.filter(F.array(*(F.when(broken(ok), name) for name, ok in rules.items())), lambda x: x.isNotNull())


def result_issues(scores: Column, total: Column, average: Column, weights: dict[str, float], axes: tuple[str, ...] = ("legal", "technology", "market", "business_fit")) -> Column:
    """What a whole result breaks: axes that lack or are unknown, a total that is no sum of the core ones, an average that is not their weighted mean."""
    names, core = F.map_keys(scores), list(weights)
    summed = reduce(lambda a, b: a + b, [F.coalesce(scores[k], F.lit(0)) for k in core])
    mean = F.round(reduce(lambda a, b: a + b, [F.coalesce(scores[k], F.lit(0)) * F.lit(weights[k]) for k in core]) / F.lit(sum(weights.values())), 1)
    out = [*(F.when(~F.array_contains(names, a), f"missing_axis:{a}") for a in axes), F.when(F.size(F.array_except(names, F.array(*map(F.lit, axes)))) > 0, "unknown_axis"), F.when(~total.eqNullSafe(summed), "total"), F.when(~F.round(average, 1).eqNullSafe(mean), "average")]
    return F.filter(F.array(*out), lambda x: x.isNotNull())
