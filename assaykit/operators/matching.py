"""Joins: siblings, cascades, intervals, containment and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import patents, text


_KINDS = ("same_product", "same_family", "same_management")


def sibling_groups(df: DataFrame, *, key: str, product: str, family: str, management: str) -> DataFrame:
    """kind, value, n, first: each product, product family and management family with two rows or more. What all pairs would say, without them."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), text.present(F.col(c)).alias("value")) for k, c in zip(_KINDS, (product, family, management), strict=True)))
    rows = df.select(F.col(key).alias("_id"), F.inline(kinds)).where("value IS NOT NULL")
    return rows.groupBy("kind", "value").agg(F.count("*").alias("n"), F.min("_id").alias("first")).where("n > 1")


def siblings(df: DataFrame, targets: DataFrame, *, key: str, product: str, family: str, management: str, most: int = 10) -> DataFrame:
    """id, sibling, priority, reasons: each target's nearest relatives among df, `most` of them, those of its product first, then of its product family, then of its management.

    Targets are a stated set. Three equi-joins on non-blank keys, of which each target keeps its first `most` in each, so a key that most rows have doesn't multiply what is kept."""
    parts = []
    for rank, (reason, column) in enumerate(zip(_KINDS, (product, family, management), strict=True)):
        a = targets.select(F.col(key).alias("id"), F.col(column).alias("_k")).where(text.present(F.col("_k")).isNotNull())
        b = df.select(F.col(key).alias("sibling"), F.col(column).alias("_k"))
        met = a.join(b, "_k").where("id != sibling").select("id", "sibling", F.lit(rank).alias("r"), F.lit(reason).alias("reason"))
        n = F.row_number().over(Window.partitionBy("id").orderBy("sibling"))
        parts.append(met.withColumn("_n", n).where(F.col("_n") <= most).drop("_n"))
    first = reduce(DataFrame.unionByName, parts).groupBy("id", "sibling").agg(F.min("r").alias("priority"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("priority", "sibling"))
    kept = first.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")
    own, other = (df_.select(F.col(key).alias(name), F.struct(product, family, management).alias(f"_{name}")) for df_, name in ((targets, "id"), (df, "sibling")))
    both = kept.join(own, "id").join(other, "sibling")
    why = F.array_compact(F.array(*(F.when((F.col(f"_id.{c}") == F.col(f"_sibling.{c}")) & text.present(F.col(f"_id.{c}")).isNotNull(), F.lit(k)) for k, c in zip(_KINDS, (product, family, management), strict=True))))
    return both.select("id", "sibling", "priority", why.alias("reasons"))


def siblings_of(df: DataFrame, target: dict[str, object], *, key: str, product: str, family: str, management: str, limit: int = 10, order: tuple[str, ...] = ()) -> DataFrame:
    """The same for one target given by its values: a filter with a limited sort."""
    is_ = lambda c: (F.col(c) == F.lit(target.get(c))) if target.get(c) not in (None, "") else F.lit(False)
    rules = [("same_product", is_(product)), ("same_family", is_(family)), ("same_management", is_(management))]
    why = F.filter(F.array(*(F.when(F.coalesce(r, F.lit(False)), n) for n, r in rules)), lambda x: x.isNotNull())
    rank = F.coalesce(*(F.when(F.coalesce(r, F.lit(False)), i) for i, (_, r) in enumerate(rules)))
    found = df.where(F.col(key) != F.lit(target[key])).withColumn("reasons", why).withColumn("priority", rank).where(F.size("reasons") > 0)
    return found.orderBy("priority", *(order or (key,))).limit(max(1, limit))


def cascade(rows: DataFrame, key: str, sources: list[tuple[str, DataFrame]], value: str) -> DataFrame:
    """Each row's value from the first source that has its key, and which that was; one value a key in each source is taken.

    One left join for each source, all on the same key, so rows are dealt once."""
    out = rows
    for i, (_, source) in enumerate(sources):
        out = out.join(source.groupBy(key).agg(F.min(value).alias(f"_v{i}"), F.lit(True).alias(f"_in{i}")), key, "left")
    where = F.coalesce(*(F.when(F.col(f"_in{i}"), i) for i in range(len(sources))))
    value_ = F.coalesce(*(F.when(where == i, F.col(f"_v{i}")) for i in range(len(sources))))
    name = F.coalesce(*(F.when(where == i, n) for i, (n, _) in enumerate(sources)), F.lit("unresolved"))
    return out.select(*rows.columns, value_.alias("value"), name.alias("found_in"))


def intervals(df: DataFrame, point: str, table: list[tuple[float, float | None, str]], name: str) -> DataFrame:
    """df with the label of the first interval [start, end] that holds the point; an open end is None. The table is fixed and small, so it becomes a CASE."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(table):
        inside = (F.col(point) >= low) & (F.lit(True) if high is None else F.col(point) <= high)
        out = F.when(inside, label).otherwise(out)
    return df.withColumn(name, out)


def interval_join(points: DataFrame, spans: DataFrame, *, point: str, start: str, end: str, width: float, how: str = "left") -> DataFrame:
    """Points with the spans [start, end] that hold them. Both are dealt to bins of the given width, so it is an equi-join; spans are copied to each bin they touch."""
    p = points.withColumn("_bin", F.floor(F.col(point) / width))
    s = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(s, (p["_bin"] == s["_bin"]) & (F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end)), how).drop("_bin")


def missing_references(child: DataFrame, column: str, parent: DataFrame, key: str, label: str) -> DataFrame:
    """Distinct values of the child's column that the parent lacks."""
    return child.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").join(parent.select(F.col(key).cast("string").alias("value")), "value", "left_anti").distinct().select(F.lit(label).alias("reference"), "value")


def used_by(df: DataFrame, item: str, user: str, order: str) -> DataFrame:
    """Inverted index: each item's distinct users in the order of their first use."""
    firsts = df.groupBy(item, user).agg(F.min(order).alias("_o"))
    return firsts.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", user))), lambda x: x[user]).alias("users"))


def label_of(scores: dict[str, Column]) -> Column:
    """The name of the highest score, ties to the one named first, null where all are 0."""
    names = F.array(*map(F.lit, scores))
    return patents.let(F.array(*scores.values()), lambda s: F.when(F.array_max(s) > 0, F.get(names, (F.array_position(s, F.array_max(s)) - 1).cast("int"))))


def best_label(df: DataFrame, scores: dict[str, Column], name: str = "label") -> DataFrame:
    """df with the label of the highest score, ties to the one named first, null where all are 0."""
    names = F.array(*map(F.lit, scores))
    top = F.array_max("_scores")
    label = F.when(top > 0, F.get(names, (F.array_position("_scores", top) - 1).cast("int")))
    return df.withColumn("_scores", F.array(*scores.values())).withColumn(name, label).withColumn(f"{name}_hits", top).drop("_scores")


def claims_for(candidates: DataFrame, claims: DataFrame, languages: tuple[str, ...], most: int = 3) -> DataFrame:
    """Claim rows (publication, language, text) of candidate publications, the preferred languages first, at most so many each; null languages stay."""
    wanted = claims.where(F.col("language").isin(*languages) | F.col("language").isNull()).join(candidates.select("publication").distinct(), "publication", "left_semi")
    n = F.row_number().over(Window.partitionBy("publication").orderBy(F.when(F.col("language").isin(*languages), 0).otherwise(1), "language", "text"))
    return wanted.withColumn("rank", n).where(F.col("rank") <= most)
