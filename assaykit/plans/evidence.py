"""Finding, filtering, merging and ranking evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import DOCUMENT_INDICATORS, INDICATOR_STARTS, INDUSTRY_KEYWORDS
from ..functions import text
from ..operators import aggregates, dedupe, documents, filters, matching, model, neighbours, ranking
from ..sources.tables import table
from .registry import query

#: The benchmark item whose words stand for the target's.
TARGET_ITEM = 0
TOP = 20

_KEYWORDS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[0-9a-zA-Z가-힣]{{2,}}'), lambda t: NOT regexp_full_match(t, '[0-9]+')))"
_KW = _KEYWORDS.format
_TARGET = f"(SELECT {_KW('text')} FROM benchmark WHERE item_id = {TARGET_ITEM})"


def target(spark: SparkSession, sf_dir: str) -> Column:
    """The target's keywords as a literal: one row is looked up."""
    row = table(spark, sf_dir, "benchmark").where(F.col("item_id") == TARGET_ITEM).select(text.keywords(F.col("text"))).first()
    return F.array(*map(F.lit, row[0])) if row and row[0] else F.array().cast("array<string>")


def first_texts(df: DataFrame, key: str) -> DataFrame:
    """The smallest key of each text, whatever the case: grouped by a digest, so texts are not shuffled and a text that most rows have is counted before the shuffle."""
    return df.groupBy(F.md5(F.lower("text")).alias("_digest")).agg(F.min(key).alias(key)).select(key)


def judged(df: DataFrame, words: Column) -> DataFrame:
    """documents with match_count, similarity, quality and the reason for keeping or rejecting each; texts stay where they are read."""
    rows = filters.quality(df.withColumn("words", text.keywords(F.col("text"))), F.col("words"), words)
    digest = F.coalesce(F.md5(F.lower("text")), F.lit(""))
    narrow = rows.select("doc_id", "source", "match_count", "quality", text.jaccard(F.col("words"), words).alias("similarity"), digest.alias("_digest"))
    first = df.groupBy(digest.alias("_digest")).agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    return filters.reasons(narrow.join(first, ["doc_id", "_digest"], "left").drop("_digest"), [("duplicate", F.col("_first").isNull()), ("no_keyword_match", F.col("match_count") == 0)]).drop("_first")


_JUDGED = f"""
judged AS (
  SELECT d.*, len(list_intersect(words, {_TARGET})) AS match_count,
    CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY lower(text)) THEN 'duplicate'
      WHEN len(list_intersect(words, {_TARGET})) = 0 THEN 'no_keyword_match' ELSE 'passed' END AS reason
  FROM (SELECT *, {_KW('text')} AS words FROM documents) d)
"""


@query(f"""WITH {_JUDGED}, scored AS (
  SELECT doc_id, source, match_count, round(match_count * 1.0 / (len(words) + len({_TARGET}) - match_count), 4) AS similarity FROM judged WHERE reason = 'passed')
SELECT doc_id, source, CAST(match_count AS INTEGER) AS match_count, CAST(similarity AS DOUBLE) AS similarity FROM scored ORDER BY similarity DESC, doc_id LIMIT {TOP}""")
def evidence_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant, unique evidence for a target, the most similar first: a top-k report."""
    words = target(spark, sf_dir)
    kept = judged(table(spark, sf_dir, "documents"), words).where("reason = 'passed'")
    return kept.select("doc_id", "source", "match_count", "similarity").orderBy(F.desc("similarity"), "doc_id").limit(TOP)


@query(f"WITH {_JUDGED} SELECT doc_id, CAST(match_count AS INTEGER) AS match_count, reason FROM judged")
def evidence_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), target(spark, sf_dir)).select("doc_id", "match_count", "reason")


@query(f"""SELECT conv_id, turn, CAST(n AS INTEGER) AS match_count, CASE WHEN n = 0 THEN 'no_match' WHEN n = 1 THEN 'weak_match' ELSE 'match' END AS quality
FROM (SELECT conv_id, turn, len(list_intersect({_KW('text')}, {_TARGET})) AS n FROM conversations)""")
def evidence_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("words", text.keywords(F.col("text")))
    return filters.quality(rows, F.col("words"), target(spark, sf_dir)).select("conv_id", "turn", "match_count", "quality")


@query("SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) = 1")
def evidence_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "n_chars").join(first_texts(docs, "doc_id"), "doc_id", "left_semi")


@query("""WITH every AS (
  SELECT 0 AS origin_rank, 'documents' AS origin, doc_id AS seq, text FROM documents UNION ALL
  SELECT 1, 'benchmark', item_id, text FROM benchmark UNION ALL SELECT 2, 'conversations', conv_id * 1000 + turn, text FROM conversations),
kept AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY origin_rank, seq) = 1)
SELECT e.origin, count(*) AS rows_in, count(k.seq) AS rows_kept, CAST(sum(length(k.text)) AS BIGINT) AS chars_kept
FROM every e LEFT JOIN kept k ON e.origin = k.origin AND e.seq = k.seq GROUP BY e.origin""")
def evidence_merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in their order of preference as one table, each text once, counted by origin."""
    seq = {"documents": F.col("doc_id"), "benchmark": F.col("item_id"), "conversations": F.col("conv_id") * 1000 + F.col("turn")}
    every = dedupe.union_sources({n: table(spark, sf_dir, n).select(c.alias("seq"), "text") for n, c in seq.items()}, ["seq", "text"])
    heads = every.groupBy(F.md5(F.lower("text")).alias("_digest")).agg(F.min(F.struct("origin_rank", "seq", "origin", F.length("text").alias("chars"))).alias("h"))
    kept = heads.groupBy("h.origin").agg(F.count("*").alias("rows_kept"), F.sum("h.chars").cast("long").alias("chars_kept"))
    return every.groupBy("origin").agg(F.count("*").alias("rows_in")).join(kept, "origin", "left").select("origin", "rows_in", F.coalesce("rows_kept", F.lit(0)).alias("rows_kept"), "chars_kept")


_KIND = "CASE WHEN toxic = 1 THEN 'competitor_patent' WHEN quality = 1 THEN 'news' WHEN quality = 0 THEN 'industry_report' END"


@query(f"""SELECT doc_id, CASE WHEN kind = 'news' THEN 'candidate' WHEN kind = 'industry_report' AND (score IS NULL OR score >= 0.5) THEN 'candidate'
  WHEN kind = 'competitor_patent' THEN 'passthrough' ELSE 'non_target' END AS route
FROM (SELECT d.doc_id, {_KIND} AS kind, n_chars / 4000.0 AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def evidence_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows a model is to compress; labels stand for the sources' types."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return filters.route(rows.select("doc_id", F.expr(_KIND).alias("source_type"), (F.col("n_chars") / 4000.0).alias("score"))).select("doc_id", "route")


@query("""SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS n_news, count(*) FILTER (n_chars >= 1000) AS n_relevant,
  count(*) FILTER (text IS NULL OR lang IS NULL) AS n_incomplete,
  concat_ws(',', CASE WHEN count(*) < 3 THEN 'too_few_items' END, CASE WHEN count(*) FILTER (lang = 'en') < 3 THEN 'too_few_news' END,
    CASE WHEN count(*) FILTER (n_chars >= 1000) < 2 THEN 'too_few_relevant' END, CASE WHEN count(*) FILTER (text IS NULL OR lang IS NULL) > 0 THEN 'incomplete_items' END) AS issues
FROM documents GROUP BY source""")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aggregates.evidence_gate(table(spark, sf_dir, "documents"), "source", news=F.col("lang") == "en", relevant=F.col("n_chars") >= 1000, complete=F.col("text").isNotNull() & F.col("lang").isNotNull())
    return rows.select("source", "n", "n_news", "n_relevant", "n_incomplete", F.concat_ws(",", "issues").alias("issues"))


@query(f"""WITH items AS (SELECT item_id, unnest(w) AS word, len(w) AS size FROM (SELECT item_id, {_KW('text')} AS w FROM benchmark) WHERE item_id % 20 = 0),
docs AS (SELECT doc_id, unnest(w) AS word, len(w) AS size FROM (SELECT doc_id, {_KW('text')} AS w FROM documents)),
pairs AS (SELECT item_id, doc_id, round(count(*) * 1.0 / (any_value(i.size) + any_value(d.size) - count(*)), 4) AS similarity FROM items i JOIN docs d ON i.word = d.word GROUP BY ALL)
SELECT item_id, doc_id, CAST(similarity AS DOUBLE) AS similarity, CAST(row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS INTEGER) AS rank FROM pairs QUALIFY rank <= 3""".replace("GROUP BY ALL", "GROUP BY item_id, doc_id"))
def text_jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents most similar to each query item; queries are the items with ids divisible by 20. Their word sets meet the documents where those are read."""
    words = text.keywords(F.col("text"))
    return neighbours.most_alike(table(spark, sf_dir, "documents"), "doc_id", words, table(spark, sf_dir, "benchmark").where("item_id % 20 = 0"), "item_id", words, k=3)


_LINES = "SELECT DISTINCT {0}, lower(trim(unnest(string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n')))) AS line FROM {1}"


@query(f"""WITH d AS ({_LINES.format('doc_id', 'documents')}), b AS ({_LINES.format('item_id', 'benchmark')})
SELECT doc_id, count(DISTINCT d.line) AS shared_lines FROM d JOIN b ON d.line = b.line WHERE length(d.line) >= 20 GROUP BY doc_id""")
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with lines of benchmark items: a semi join on lines."""
    of = lambda name, key: documents.lines(table(spark, sf_dir, name), key, "text").select(key, F.lower(F.trim("line")).alias("line")).where(F.length("line") >= 20)
    known = of("benchmark", "item_id").select("line").distinct()
    return of("documents", "doc_id").join(known, "line", "left_semi").groupBy("doc_id").agg(F.count_distinct("line").alias("shared_lines"))


_TOKENS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r\\x{A0}\\x{3000}]+'), lambda t: t <> '')"


@query(f"""WITH d AS (SELECT doc_id, text, {_TOKENS} AS t FROM documents),
n AS (SELECT *, CASE WHEN len(t) <= 100 THEN 1 ELSE CAST(ceil((len(t) - 100) / 85.0) AS INTEGER) + 1 END AS k FROM d),
c AS (SELECT *, unnest(range(1, k + 1)) AS chunk_no FROM n)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, sha256(CASE WHEN len(t) <= 100 THEN text ELSE array_to_string(t[(chunk_no - 1) * 85 + 1 : (chunk_no - 1) * 85 + 100], ' ') END) AS chunk_sha256 FROM c""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of 100 tokens."""
    rows = documents.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 100, 15)
    return rows.select("doc_id", "chunk_no", F.sha2("chunk", 256).alias("chunk_sha256"))


@query("""WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS no FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS lines FROM documents)),
i AS (SELECT doc_id, no, line, sum(CASE WHEN length(line) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS island FROM l)
SELECT doc_id, CAST(island AS BIGINT) AS island, CAST(min(no) AS INTEGER) AS first_line, CAST(max(no) AS INTEGER) AS last_line, CAST(sum(length(line)) AS BIGINT) AS chars FROM i GROUP BY doc_id, island""".replace("\r\n|\r|\n", "\\r\\n|\\r|\\n"))
def line_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document gathered into islands; a short line starts one, as a heading would."""
    parts = documents.marked_parts(F.col("text"), lambda line: F.when(F.length(line) < 60, line))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(parts).alias("p"))
    chars = F.aggregate("p.lines", F.lit(0).cast("long"), lambda n, line: n + F.length(line))
    return rows.select("doc_id", F.col("p.section_no").alias("island"), "p.first_line", "p.last_line", chars.alias("chars"))


@query("""SELECT page_id, host, CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN scheme || '://' || authority || CASE WHEN path = '' THEN '/' ELSE path END || query END AS url,
  (host = 'example.com' OR host LIKE '%.example.com') AS owned
FROM (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS authority,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS query FROM pages)""")
def url_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = text.url_host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), text.url_normal(F.col("url")).alias("url"), text.in_domain(host, ["example.com"]).alias("owned"))


@query()
def html_title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and the number of paragraphs; an HTML parser has no SQL twin."""
    return documents.read_html(table(spark, sf_dir, "pages"), "html").select("page_id", "title", F.size("paragraphs").alias("paragraphs"), F.sha2(F.concat_ws("\n", "paragraphs"), 256).alias("text_sha256"))


_COUNTED = {"embodiment_mentions": "example|embodiment", "parameter_mentions": "parameter|threshold|weight", "data_structure_mentions": "data\\s*structure|table|list|array|matrix|vector|graph", "input_output_mentions": "input|output"}


@query("SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(coalesce(text, ''), '(?i){p}')) AS INTEGER) AS {n}" for n, p in _COUNTED.items()) + " FROM documents")
def indicator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often technical indicators occur; the patterns are the Latin ones, on which all engines agree."""
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in text.indicators(F.col("text"), _COUNTED).items()))


@query()
def document_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine indicators with their whole patterns; word edges, digits and spaces are Unicode's, as in the reference, so there is no SQL twin."""
    patterns = {n: f"(?U){p}" for n, p in DOCUMENT_INDICATORS.items()}
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in text.indicators(F.col("text"), patterns, INDICATOR_STARTS).items()))


def _hits_sql(words: tuple[str, ...]) -> str:
    low = "lower(coalesce(text, ''))"
    one = lambda w: f"contains({low}, '{w}')" if any("가" <= c <= "힣" for c in w) else f"regexp_matches({low}, '(^|[^0-9a-z]){w}($|[^0-9a-z])')"
    return " + ".join(f"CAST({one(w)} AS INTEGER)" for w in words)


_LABELS = {f"l{i}": label for i, label in enumerate(INDUSTRY_KEYWORDS)}


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {k} = top AND {k} > 0 THEN '{label}'" for k, label in _LABELS.items()) + " END AS label, CAST(top AS INTEGER) AS label_hits FROM (SELECT *, greatest("
       + ", ".join(_LABELS) + ") AS top FROM (SELECT doc_id, " + ", ".join(f"{_hits_sql(INDUSTRY_KEYWORDS[label])} AS {k}" for k, label in _LABELS.items()) + " FROM documents))")
def industry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The industry with the most keyword hits among fifteen; ties go to the more special one."""
    low = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("_low"))
    rows = matching.best_label(low, {k: text.word_hits_in(F.col("_low"), ws) for k, ws in INDUSTRY_KEYWORDS.items()})
    return rows.select("doc_id", "label", "label_hits")


@query("""SELECT doc_id, source, CAST(tier AS INTEGER) AS tier, n_chars FROM (SELECT *, CASE WHEN lang = 'en' THEN 0 WHEN lang = 'de' THEN 1 ELSE 2 END AS tier FROM documents)
ORDER BY tier, CASE WHEN tier < 2 THEN -n_chars END, doc_id""")
def nearest_tier_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence by tier of nearness, then score."""
    tier = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)
    return ranking.tiers(table(spark, sf_dir, "documents"), tier, "n_chars", "doc_id", 2).select("doc_id", "source", "tier", "n_chars")


@query("""WITH one AS (SELECT source, lang, doc_id FROM documents WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) = 1)
SELECT source, lang, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS INTEGER) AS place FROM (SELECT o.*, d.n_chars FROM one o JOIN documents d USING (doc_id)) QUALIFY place <= 2""")
def first_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source the first two languages, the shortest documents first."""
    return ranking.first_sources(table(spark, sf_dir, "documents").where("lang IS NOT NULL"), "source", "lang", "n_chars", "doc_id", 2).select("source", "lang", "doc_id", "place")


@query()
def evidence_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed evidence summarised by a model; here the deterministic stub, whose digests have no SQL twin."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("source_type", F.expr(_KIND)).withColumn("score", F.col("n_chars") / 4000.0)
    done = model.compressed(filters.route(rows), content="text")
    return done.select("doc_id", "route", "status", "summary")


@query()
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text under each heading; a short line in capitals or a Markdown heading starts a section. Tests hold it against fixtures."""
    head = lambda line: F.when(line.rlike("^#{1,6}[ \t]+") | (F.length(line).between(3, 60) & (F.upper(line) == line)), line)
    rows = documents.sections(table(spark, sf_dir, "documents"), "doc_id", "text", head)
    return rows.select("doc_id", "section_no", "heading", F.length("text").alias("chars"))
