"""The operators' queries with production parameters, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, decontaminate, jaccard, langid, licenses, media, resample, secrets, sharding, spelling, substrings, tokenfiles
from .common import table


#: Arrivals that op1_sharding deals documents to, by a hash: each of them is appended whole.
ARRIVALS = 5


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents appended in several arrivals of small shards, compacted after each; every row read back through the last manifest."""
    store = sharding.ShardStore(spark)
    docs = table(spark, sf_dir, "documents")
    arrival, version = F.pmod(F.xxhash64("doc_id", "source"), F.lit(ARRIVALS)), 0
    for k in range(ARRIVALS):
        store.append(docs.where(arrival == k))
        version = store.compact()
    return store.read(version).select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"))


OP1_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents"


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in the texts of documents, one row for each."""
    return licenses.matches(table(spark, sf_dir, "documents"))


def byte_codec() -> bpe.ByteBpe:
    import public_tokenizers

    return bpe.ByteBpe.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_codec()).drop("text")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    sample = langid.labelled_sample(docs, langid.crc_remainder("doc_id") != 2)
    held_out = F.coalesce(langid.crc_remainder("doc_id") == 2, F.lit(False))
    return langid.identify(docs.select("doc_id", "text"), sample).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathlib import Path

    import public_tokenizers

    definition = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
    return tokenfiles.token_files(table(spark, sf_dir, "documents"), definition)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each pair of a document and a benchmark item that it contains."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


#: What both turns of conversation -1 say.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted with a loss mask and read back."""
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.chats(rows))


OP11_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), opened AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS opens FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + CASE WHEN opens THEN length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1 ELSE length('<|im_sep|>') END) AS BIGINT) AS formatted_chars
FROM opened GROUP BY conv_id
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents with the frequent words that they are variants of."""
    return spelling.variants(table(spark, sf_dir, "documents"))


#: crc32 in SQL: a table from its polynomial, and a text's bytes folded through it. Made once for each distinct {name} of {of}.
_CRC_SQL = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce([CAST(i AS BIGINT)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), crcs AS (
  SELECT f, xor(list_reduce([4294967295::BIGINT] || list_transform(range(strlen(f)), lambda k: CAST('0x' || substr(hex(f), 2 * k + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT DISTINCT {name} AS f FROM {of}), crc_table
)"""

#: near words share one of: the word, or the word less one code point. {distance} of the two must be 1.
OP12_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), keyed AS (
  SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), {_CRC_SQL.format(name="named", of="keyed").strip()}, words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM keyed JOIN crcs ON f = named GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
), pieces AS (
  SELECT DISTINCT word, n, unnest([word] || list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))) AS piece FROM words
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM pieces a JOIN pieces b USING (piece)
  WHERE a.word <> b.word AND abs(length(a.word) - length(b.word)) <= 1
    AND (length(a.word) <> length(b.word) OR len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1)
    AND (length(a.word) = length(b.word) OR piece IN (a.word, b.word))
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n, max(near_n) >= 10 * any_value(n) AS holds FROM near GROUP BY word
), told AS (
  SELECT word, CASE WHEN holds THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN holds THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)
), steps AS (
  SELECT word, word AS root FROM told
  UNION ALL SELECT steps.word, told.form FROM steps JOIN told ON told.word = steps.root WHERE told.form IS NOT NULL
), ends AS (
  SELECT steps.word, root FROM steps JOIN told ON told.word = root WHERE told.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM told JOIN ends USING (word)
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn in proportion to how much likelier benchmark's n-grams make them."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH texts AS (
  SELECT doc_id, FALSE AS target, text FROM documents UNION ALL SELECT NULL, TRUE, text FROM benchmark
), worded AS (
  SELECT doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
  SELECT doc_id, target, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM worded
), counted AS (
  SELECT doc_id, target, feature, count(*) AS n FROM features GROUP BY ALL
), {_CRC_SQL.format(name="feature", of="counted").strip()}, hashed AS (
  SELECT doc_id, target, h % 10000 AS bucket, n FROM counted JOIN crcs ON f = feature
), sides AS (
  SELECT bucket, CAST(coalesce(sum(n) FILTER (NOT target), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (target), 0) AS DOUBLE) AS t FROM hashed GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM sides
), sums AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM hashed JOIN gains USING (bucket) WHERE NOT target GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, len(w) >= 20 AS long_enough, CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM worded LEFT JOIN sums USING (doc_id) WHERE NOT target
), ranks AS (
  SELECT *, row_number() OVER (PARTITION BY long_enough ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER (PARTITION BY long_enough) AS rows_in FROM scored
)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN long_enough AND place <= 25 * rows_in // 100 THEN place END AS rank FROM ranks
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_license_scans, op3_byte_bpe, op4_language_id, op5_token_files, op6_ngram_jaccard_join, op7_substring_dedup, op8_decontamination, op9_media_columns, op10_secret_scans, op11_chat_formatting, op12_spelling_variants, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1_SQL, "op11_chat_formatting": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_importance_resampling": OP13_SQL}
