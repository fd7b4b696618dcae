"""Target-distribution importance resampling with built-in Spark functions only.

Hashed n-gram counts of a corpus and of a target give each bucket a gain, the logarithm of how much likelier the target is to fill it.
A document's weight is the mean gain of its n-grams; with Gumbel noise from a hash of its id added, the highest scores are a draw
without replacement in proportion to the weights.

1. N-gram arrays are exploded, hashed to buckets and counted; tasks count first, so a bucket's rows are as many as tasks.
2. The gain table has a row for each bucket (10,000 by default, whatever the input) and is broadcast; n-grams are exploded again, since
   hashing them twice is cheaper than storing every one. Sums of a document are partial sums of one task.
3. Ranks: rows are sorted over all partitions and stored; a row's rank is its place in its partition plus the rows of the partitions
   before. Only ids and numbers are sorted.

Defined for odd rows: a null text has no words and weight 0; a null id is the empty string in the hash and comes after others in ties;
repeated rows are documents of their own; equal rows get ranks in any order; other columns don't matter; an empty table gives none.
An empty target counts nothing: all gains then follow the corpus alone. One text's words are an array in memory, some 150 bytes each.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: All that is no word: ASCII other than digits and small letters, once capitals are lowered.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLACE = (1 << 33) - 1


def words(text: Column) -> Column:
    """Words of lower-cased text (A-Z only)."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, _BETWEEN, -1), "")


def ngrams(words: Column, longest: int) -> Column:
    """All runs of 1 to `longest` consecutive words, joined by one space."""
    runs = [words]
    for k in range(1, longest):
        n = F.greatest(F.size(words) - k, F.lit(0))
        runs.append(F.zip_with(F.slice(runs[-1], F.lit(1), n), F.slice(words, F.lit(k + 1), n), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(*runs)


def bucketed(docs: DataFrame, text: str, longest: int, buckets: int) -> DataFrame:
    """docs without the text, a row for each n-gram with its bucket; a row with a null bucket where there is none."""
    rest = [c for c in docs.columns if c != text]
    split = docs.select(*rest, words(F.col(text)).alias("ngram_words"))
    exploded = split.select(*rest, F.explode_outer(ngrams(F.col("ngram_words"), longest)).alias("ngram"))
    return exploded.select(*rest, (F.crc32("ngram") % buckets).alias("bucket"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """bucket, gain of every bucket: floor of 1000 times the logarithm of the smoothed ratio of its shares."""
    count = lambda df, column: bucketed(df.select(F.col(column).cast("string").alias("text")), "text", longest, buckets).where("bucket IS NOT NULL")
    both = count(docs, text).withColumn("hit", F.lit(0)).unionByName(count(target, target_text).withColumn("hit", F.lit(1)))
    sides = stored(both.groupBy("bucket").agg(F.sum(1 - F.col("hit")).alias("s"), F.sum("hit").alias("t")), "buckets")
    s_all, t_all = sides.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = (t + 1) * F.lit(float(s_all + buckets)) / ((s + 1) * F.lit(float(t_all + buckets)))
    return docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(sides, "bucket", "left").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighted(docs: DataFrame, gain: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_features, weight: a row for each row of docs. gain has a row for each bucket at most, so it is broadcast."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    hits = bucketed(rows, "text", longest, buckets).join(F.broadcast(gain), "bucket", "left")
    sums = hits.groupBy("row", "doc_id").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"))
    mean = F.expr("(sum - pmod(sum, n_features)) div n_features")
    return sums.select("doc_id", "n_features", F.when(F.col("n_features") > 0, mean).otherwise(0).alias("weight"))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank 1, 2, 3... in a global order, without a task that sees all of them."""
    held = stored(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_place", 33).alias("_part")
    sizes = {r["_part"]: r["n"] for r in held.groupBy(part).agg(F.count("*").alias("n")).collect()}  # a number for each partition
    offsets, before = [], 0
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    table = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return held.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn("rank", F.col("_before") + F.col("_place").bitwiseAND(F.lit(_PLACE)) + 1).drop("_part", "_before", "_place")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", seed: int = 7, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it is not drawn."""
    scored = weighted(docs, gains(docs, target, text, target_text, longest, buckets), doc_id, text, longest, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    # n words have as many n-grams as these runs' lengths leave room for
    room = sum(max(least_words - k, 0) for k in range(longest))
    scored = scored.withColumn("score", F.col("weight") + noise).withColumn("long_enough", F.col("n_features") >= room)
    all_ranked = ranked(scored, [F.desc("long_enough"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")])
    n = all_ranked.where("long_enough").count()
    rank = F.when(F.col("long_enough") & (F.col("rank") <= percent * n // 100), F.col("rank"))
    return all_ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
