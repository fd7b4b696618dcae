"""Walks along arrays that carry something from item to item, in rows and without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .patents import let

#: Items of a block: arrays of states grow by copies, so blocks keep the copies short.
BLOCK = 256


def scan(items: Column, zero: Column, kind: str, step: Callable[[Column, Column], Column], block: int = BLOCK) -> Column:
    """The state after each item: step(state, item), beginning with zero; kind is the states' type.

    Blocks of items are walked one after the other and their states joined at the end, so time grows little faster than the array."""

    def walk(state: Column, part: Column) -> Column:
        empty = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        one = lambda acc, x: let(step(acc["state"], x), lambda new: F.struct(new.alias("state"), F.array_append(acc["out"], new).alias("out")))
        return F.aggregate(part, empty, one)

    def over(xs: Column) -> Column:
        blocks = F.transform(F.filter(F.sequence(F.lit(0), F.size(xs), F.lit(block)), lambda a: a < F.size(xs)), lambda a: F.slice(xs, a + 1, F.lit(block)))
        empty = F.struct(zero.cast(kind).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("outs"))
        one = lambda acc, part: let(walk(acc["state"], part), lambda got: F.struct(got["state"].alias("state"), F.array_append(acc["outs"], got["out"]).alias("outs")))
        return F.aggregate(blocks, empty, one, lambda acc: F.flatten(acc["outs"]))

    return let(items, over)


def runs(items: Column, begins: Callable[[Column, Column], Column]) -> Column:
    """The array cut into arrays; begins(items, i) tells whether item i starts one. The first always does."""

    def cut(xs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(xs)), lambda i: (i < F.size(xs)) & ((i == 0) | begins(xs, i)))
        return let(starts, lambda s: F.transform(s, lambda at, k: F.slice(xs, at + 1, F.coalesce(F.get(s, k + 1), F.size(xs)) - at)))

    return let(items, cut)
