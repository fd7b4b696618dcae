"""Walking ranked candidates until enough of them succeed, with further sources for the failures.

A lookup is a join with a landed table. Which candidates a walk would have tried follows from counts of successes before each row, so
rounds are windows within groups, one for each source, and nothing is tried row by row. Sources meet by key first, so candidates are
dealt by key once for all of them and by group once for all rounds; what a round doesn't try, it doesn't see.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text


def ranked_candidates(citations: DataFrame, mentioned: DataFrame, group: str, home: Column | str = "KR") -> DataFrame:
    """Candidates of each group in order, each display number once.

    citations: group, display_number, country_code, kind_code, is_standardized; standardised ones first, then kinds in B, then those of
    the home country, then by number. mentioned: group, position, display_number from running text; they come after all citations, in
    their order. Blank numbers are left out; spaces at the ends don't count. Returns group, display_number, origin, country_code,
    kind_code, place (from 1)."""
    home = F.lit(home) if isinstance(home, str) else home
    flag = lambda c: F.coalesce(c, F.lit(False))
    kind, country = F.upper(F.coalesce("kind_code", F.lit(""))), F.upper(F.coalesce("country_code", F.lit("")))
    # one number for the class: mentioned ones from 8 on
    worse = lambda c, n: F.when(c, 0).otherwise(n)
    rank = worse(flag(F.col("is_standardized")), 4) + worse(kind.startswith("B"), 2) + worse(flag(country == F.upper(home)), 1)
    cited = citations.select(group, text.present(F.trim("display_number")).alias("display_number"), "country_code", "kind_code", rank.alias("_class"), F.lit(0).cast("long").alias("_position"))
    number = text.present(F.trim("display_number"))
    said = mentioned.select(group, number.alias("display_number"), F.upper(F.substring(number, 1, 2)).alias("country_code"), F.lit(None).cast("string").alias("kind_code"), F.lit(8).alias("_class"), F.col("position").cast("long").alias("_position"))
    # dealt by group once: that is enough for the distinct numbers, their places and a walk's first window
    every = cited.unionByName(said).where("display_number IS NOT NULL").repartition(group)
    first = every.groupBy(group, "display_number").agg(F.min(F.struct("_class", "_position", "country_code", "kind_code")).alias("_first"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("_first._class", "_first._position", "display_number"))
    origin = F.when(F.col("_first._class") < 8, "citation").otherwise("mentioned")
    return first.select(group, "display_number", origin.alias("origin"), "_first.country_code", "_first.kind_code", place.alias("place"))


def until_enough(candidates: DataFrame, group: str, key: str, sources: list[tuple[str, DataFrame]], *, place: str = "place", value: str = "text", goal: int = 3, most: int = 15) -> DataFrame:
    """The candidates that a walk by place tries, until `goal` of a group have a value; at most max(most, goal) of a group are tried at all.

    The first source is walked until the goal is met. If it isn't, the failures among the tried are walked in the next source, and so
    on; the goal counts over all sources. Each source has `key` and `value`; blank values are none, of several the smallest is taken.
    Returns the tried candidates with value, found_in (null: failed) and tried (names of sources in order)."""
    own = Window.partitionBy(group).orderBy(place)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    cap = max(most, goal)
    out = candidates.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= cap).drop("_n")
    said = [source.select(F.col(key).cast("string").alias("_key"), F.lit(i).alias("_i"), text.present(F.col(value)).alias("_new")).where("_key IS NOT NULL AND _new IS NOT NULL") for i, (_, source) in enumerate(sources)]
    if said:
        known = reduce(DataFrame.unionByName, said).groupBy("_key").agg(*(F.min(F.when(F.col("_i") == i, F.col("_new"))).alias(f"_new{i}") for i in range(len(said))))
        # rows without a key meet nothing; each has one of its own, since nulls would all be dealt to one task
        spread = F.concat(F.lit("\x00"), F.xxhash64(group, place).cast("string"))
        out = out.withColumn("_ask", F.coalesce(F.col(key).cast("string"), spread)).join(known, F.col("_ask") == F.col("_key"), "left").drop("_key", "_ask")
    out = out.withColumns({"_value": F.lit(None).cast("string"), "found_in": F.lit(None).cast("string"), "tried": F.array().cast("array<string>")})
    for i, (name, _) in enumerate(sources):
        out = out.withColumnRenamed(f"_new{i}", "_new")
        wanted = F.col("_value").isNull()
        had = F.sum(F.when(F.col("_value").isNotNull(), 1).otherwise(0)).over(whole)
        now = F.sum(F.when(wanted & F.col("_new").isNotNull(), 1).otherwise(0)).over(before)
        out = out.withColumn("_tries", wanted & (had + F.coalesce(now, F.lit(0)) < goal))
        found = F.col("_tries") & F.col("_new").isNotNull()
        out = out.withColumns({"_value": F.when(found, F.col("_new")).otherwise(F.col("_value")), "found_in": F.when(found, F.lit(name)).otherwise(F.col("found_in")), "tried": F.when(F.col("_tries"), F.array_append("tried", F.lit(name))).otherwise(F.col("tried"))})
        # what the first source doesn't reach is never tried; of later ones, all that failed stay open
        out = (out.where("_tries") if i == 0 else out).drop("_new", "_tries")
    return out.withColumnRenamed("_value", value)


def summary(walked: DataFrame, candidates: DataFrame, group: str, goal: int = 3) -> DataFrame:
    """By group: how many candidates there were, were tried and succeeded, and what to say of it."""
    all_ = candidates.groupBy(group).agg(F.count("*").alias("candidate_count"))
    done = walked.groupBy(group).agg(F.count("*").alias("tried_count"), F.count("found_in").alias("fulltext_count"))
    warning = F.when(F.col("fulltext_count") == 0, "no_fulltext").when(F.col("fulltext_count") < goal, "fewer_than_wanted")
    return all_.join(done, group, "left").na.fill(0, ["tried_count", "fulltext_count"]).withColumn("warning", warning)


def enriched(candidates: DataFrame, matches: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Candidates with what is known of them; the unresolved stay.

    matches: key, rank, application_number, title, status, publication_date, abstract from searches, the best first. records: by
    application_number the title, registration_number, publication_date and abstract of the register, which win over the search's.
    Adds application_number, resolved_numbers (all distinct ones, in order), title, status, publication_date, abstract, warning."""
    fields = ("title", "status", "publication_date", "abstract")
    ordered = matches.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "application_number", *fields))).alias("_m"))
    numbers = F.array_distinct(F.filter(F.transform("_m", lambda m: text.present(m["application_number"])), lambda n: n.isNotNull()))
    out = candidates.join(ordered, key, "left").withColumn("resolved_numbers", F.coalesce(numbers, F.array().cast("array<string>"))).withColumn("application_number", F.get("resolved_numbers", F.lit(0)))
    known = records.groupBy("application_number").agg(F.min(F.struct("title", "registration_number", "publication_date", "abstract")).alias("_r")).withColumnRenamed("application_number", "_key")
    out = out.join(known, F.col("application_number") == F.col("_key"), "left")
    of = lambda f: F.coalesce(text.present(F.col("_r")[f]), text.present(F.get("_m", F.lit(0))[f])).alias(f)
    status = F.when(F.col("_r").isNotNull(), F.when(text.present(F.col("_r.registration_number")).isNotNull(), "registered").otherwise("published")).otherwise(text.present(F.get("_m", F.lit(0))["status"]))
    warning = F.when(F.col("application_number").isNull(), F.concat(F.lit("application_number_unresolved:"), F.col(key).cast("string"))).when(F.col("_r").isNull(), F.concat(F.lit("record_missing:"), F.col("application_number")))
    return out.select(*candidates.columns, "application_number", "resolved_numbers", F.coalesce(of("title"), F.col(key).cast("string")).alias("title"), status.alias("status"), of("publication_date"), of("abstract"), warning.alias("warning"))


def evidence_status(candidates: DataFrame, found: DataFrame, group: str, key: str, place: str = "place", most: int = 5) -> DataFrame:
    """The first `most` candidates of each group with resolved or unresolved, and counts of both by group: a left join on the number as displayed."""
    first = candidates.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(place))).where(F.col("_n") <= most).drop("_n")
    known = found.select(F.col(key).alias("_key")).distinct()
    rows = first.join(known, F.col(key) == F.col("_key"), "left").withColumn("lookup_status", F.when(F.col("_key").isNull(), "unresolved").otherwise("resolved")).drop("_key")
    own = Window.partitionBy(group)
    return rows.withColumns({"n_resolved": F.count_if(F.col("lookup_status") == "resolved").over(own), "n_unresolved": F.count_if(F.col("lookup_status") == "unresolved").over(own)})
