"""Pages of words and boxes, walks of candidates, nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.foreign_claims import foreign_claims
from ..operators import archive_pages, boxes, hybrid, identity, neighbours, rework, structures, trees, walks
from ..sources.tables import table
from .registry import query

_BOXES = ("doc_id * 37 % 300 AS x0, doc_id * 53 % 200 AS top, doc_id * 37 % 300 + 150 AS x1, doc_id * 53 % 200 + 120 AS bottom", "0 AS x0, 300 AS top, 2000 AS x1, 300 + doc_id % 500 AS bottom")


@query(f"""WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS no FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS lines FROM documents WHERE doc_id IS NOT NULL)),
w AS (SELECT doc_id, no, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT doc_id, no, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM l)),
c AS (SELECT *, 40 * i + 2.5 * length(word) AS x, 12 * no + 5 AS y FROM w),
b AS (SELECT doc_id, {_BOXES[0]} FROM documents UNION ALL SELECT doc_id, {_BOXES[1]} FROM documents WHERE doc_id % 3 = 0),
k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = c.doc_id AND x BETWEEN x0 AND x1 AND y BETWEEN top AND bottom)),
t AS (SELECT doc_id, no, string_agg(word, ' ' ORDER BY i) AS line, count(*) AS n FROM k GROUP BY doc_id, no)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_words, sha256(string_agg(line, chr(10) ORDER BY no)) AS text_sha256 FROM t GROUP BY doc_id""")
def words_outside_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document set as a page of words: what lies in none of its boxes, as lines of text again."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    lines = docs.select("doc_id", F.posexplode_outer(F.split("text", r"\r\n|\r|\n", -1)).alias("no", "line"))
    words = lines.select("doc_id", "no", F.posexplode_outer(F.filter(F.split("line", " ", -1), lambda x: x != "")).alias("i", "text")).where("text IS NOT NULL")
    placed = words.selectExpr("doc_id", "text", "40 * i AS x0", "40 * i + 5 * length(text) AS x1", "12 * no AS top", "12 * no + 10 AS bottom")
    frames = docs.selectExpr("doc_id", *_BOXES[0].split(", ")).unionByName(docs.where("doc_id % 3 = 0").selectExpr("doc_id", *_BOXES[1].split(", ")))
    kept = boxes.outside(placed, frames, ["doc_id"])
    held = kept.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.collect_list(F.struct("x0", "top", "text")).alias("words"))
    return held.select("doc_id", "n_words", F.sha2(boxes.page_lines(F.col("words")), 256).alias("text_sha256"))


_SOURCES = {"home_archive": "o_orderstatus = 'F' AND o_orderkey % 3 = 0", "second_archive": "o_orderstatus = 'O' AND o_orderkey % 2 = 0", "third_archive": "o_orderstatus = 'P'"}
_GOAL, _MOST = 3, 15
_BEFORE = "OVER (PARTITION BY part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _rounds_sql() -> str:
    parts, last = [], "c0"
    for i, (name, where) in enumerate(_SOURCES.items()):
        parts.append(f"""s{i} AS (SELECT r.*, r.v IS NULL AND o.o_orderkey IS NOT NULL AS has, o.o_orderpriority AS new FROM {last} r LEFT JOIN orders o ON r.number = CAST(o.o_orderkey AS VARCHAR) AND {where}),
m{i} AS (SELECT *, v IS NULL AND count(v) OVER (PARTITION BY part) + coalesce(sum(CAST(has AS INTEGER)) {_BEFORE}, 0) < {_GOAL} AS tries FROM s{i}),
c{i + 1} AS (SELECT part, place, number, origin, CASE WHEN tries AND has THEN new ELSE v END AS v, CASE WHEN tries AND has THEN '{name}' ELSE found_in END AS found_in, CASE WHEN tries THEN list_append(tried, '{name}') ELSE tried END AS tried FROM m{i} {'WHERE tries' if not i else ''})""")
        last = f"c{i + 1}"
    return ",\n".join(parts)


@query(f"""WITH every AS (
  SELECT l_partkey AS part, CAST(l_orderkey AS VARCHAR) AS number, 'citation' AS origin, ROW(0, NOT l_linenumber % 2 = 0, l_linestatus <> 'F', l_returnflag <> 'R', 0) AS r FROM lineitem
  UNION ALL SELECT o_custkey, CAST(o_orderkey AS VARCHAR), 'mentioned', ROW(1, FALSE, FALSE, FALSE, o_orderkey) FROM orders),
firsts AS (SELECT part, number, min(r) AS r, arg_min(origin, r) AS origin FROM every GROUP BY part, number),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY r, number) AS place, number, origin, CAST(NULL AS VARCHAR) AS v, CAST(NULL AS VARCHAR) AS found_in, CAST([] AS VARCHAR[]) AS tried FROM firsts QUALIFY place <= {_MOST}),
{_rounds_sql()}
SELECT part, CAST(place AS INTEGER) AS place, number AS display_number, origin, v AS text, found_in, array_to_string(tried, ',') AS tried FROM c{len(_SOURCES)}""")
def prior_art_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each part as citations: the ranked ones are looked up until three have a text, failures in further archives."""
    orders = table(spark, sf_dir, "orders")
    cited = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS part", "CAST(l_orderkey AS STRING) AS display_number", "l_returnflag AS country_code", "CASE WHEN l_linestatus = 'F' THEN 'B1' ELSE 'A' END AS kind_code", "l_linenumber % 2 = 0 AS is_standardized")
    said = orders.selectExpr("o_custkey AS part", "o_orderkey AS position", "CAST(o_orderkey AS STRING) AS display_number")
    ranked = walks.ranked_candidates(cited, said, "part", home="R")
    archives = [(name, orders.where(where).selectExpr("CAST(o_orderkey AS STRING) AS display_number", "o_orderpriority AS text")) for name, where in _SOURCES.items()]
    done = walks.until_enough(ranked, "part", "display_number", archives, goal=_GOAL, most=_MOST)
    return done.select("part", "place", "display_number", "origin", "text", "found_in", F.concat_ws(",", "tried").alias("tried"))


@query("""WITH n AS (SELECT l_orderkey AS doc, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey AS doc, CAST(l_linenumber_rank AS INTEGER) AS item, CAST(l_linenumber AS VARCHAR) AS line, CAST(l_partkey AS VARCHAR) AS part, CAST(NULL AS VARCHAR) AS supplier, CAST(3 AS INTEGER) AS depth
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS l_linenumber_rank FROM lineitem)
UNION ALL SELECT l_orderkey, CAST(n + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER), NULL, NULL, CAST(l_suppkey AS VARCHAR), 5 FROM lineitem JOIN n ON l_orderkey = doc""")
def nested_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References found under telling keys at any depth of JSON documents: here each order with its lines, five levels deep."""
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    cited = F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["part"].alias("part"), F.struct(F.struct(x["supp"].alias("supplier")).alias("citation")).alias("more")))
    docs = held.select("l_orderkey", F.to_json(F.struct(F.lit("x").alias("status"), F.struct(cited.alias("patentDocuments")).alias("body"))).alias("json"))
    nodes = trees.walk(docs, "l_orderkey", "json")
    return trees.listed_fields(nodes, ("documentsinfo", "patentdocuments", "citation"), ["line", "part", "supplier"]).select("doc", "item", "line", "part", "supplier", "depth")


@query("""SELECT event_id, count(*) AS nodes, count(*) FILTER (type IN ('OBJECT', 'ARRAY')) AS inner_nodes, string_agg(fullkey, '|' ORDER BY id) AS paths FROM events, json_tree(props) GROUP BY event_id""")
def event_property_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the events' properties, whose shape isn't known, by path."""
    nodes = trees.walk(table(spark, sf_dir, "events"), "event_id", "props")
    paths = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "path"))), lambda x: x["path"]), "|")
    return nodes.groupBy(F.col("doc").alias("event_id")).agg(F.count("*").alias("nodes"), F.count_if(F.col("kind").isin("object", "array")).alias("inner_nodes"), paths.alias("paths"))


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<h[1-6][ >]')) AS INTEGER) AS n_headings, CAST(len(regexp_extract_all(html, '<a href="[^"]')) AS INTEGER) AS n_links, CAST(len(regexp_extract_all(html, '<tr[ >]')) AS INTEGER) AS n_rows FROM pages""")
def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, links and table rows of pages, read as trees."""
    rows = archive_pages.read(table(spark, sf_dir, "pages"), "html")
    return rows.select("page_id", F.size("page.headings").alias("n_headings"), F.col("page.n_links"), F.col("page.n_rows"))


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a landed page: lines are claims (nested, some unclosed) and table rows of references, cells left open."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    claim = lambda x: F.concat(F.lit('<div class="claim" num="'), x["l_linenumber"].cast("string"), F.lit('"><div class="claim-text style">A part '), x["l_partkey"].cast("string"), F.lit(' <b>made<div class="claim-text">of '), x["l_suppkey"].cast("string"), F.lit("</div></div></div>"))
    kind = lambda x: F.when(x["l_returnflag"] == "R", "forwardReferences").otherwise("backwardReferencesOrig")
    row = lambda x: F.concat(F.lit("<tr itemprop='"), kind(x), F.lit("'><td><span itemprop=publicationNumber>us-"), x["l_partkey"].cast("string"), F.lit(" b2</span><td><span itemprop='title'>Part &amp; "), x["l_suppkey"].cast("string"), F.when(x["l_linenumber"] == 1, '<td itemprop="examinerCited">*').otherwise(""))
    join = lambda f: F.array_join(F.transform("lines", f), "\n")
    page = F.concat(F.lit('<html><head><meta name="DC.title" content="Order '), F.col("l_orderkey").cast("string"), F.lit('"></head><body><section class="claims">'), join(claim), F.lit("</section><table><tbody>"), join(row), F.lit("</table></body>"))
    return held.select("l_orderkey", page.alias("html"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS n, CASE WHEN l_returnflag = 'R' THEN 'forward' ELSE 'backward' END AS kind FROM lineitem)
SELECT l_orderkey, kind, 'US' || l_partkey || 'B2' AS publication_number, CAST(min(n) - 1 AS INTEGER) AS position, arg_min('Part & ' || l_suppkey, n) AS title, arg_min(l_linenumber = 1, n) AS examiner_cited FROM l GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY l_orderkey, kind, l_partkey"))
def archive_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References out of the tables of landed pages, each number once in its direction."""
    pages = archive_pages.read(_archive(spark, sf_dir), "html")
    return archive_pages.references(pages, "l_orderkey").select("l_orderkey", "kind", "publication_number", "position", "title", "examiner_cited")


@query(r"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS n, 'US ' || l_partkey || ' B2' AS number FROM lineitem),
r AS (SELECT l_orderkey, number, min(n) AS n FROM l WHERE l_returnflag <> 'R' GROUP BY l_orderkey, number),
c AS (SELECT l_orderkey, string_agg(l_linenumber || '. A part ' || l_partkey || ' made of ' || l_suppkey, chr(10) || chr(10) ORDER BY n) AS claims FROM l GROUP BY l_orderkey),
t AS (SELECT l_orderkey, string_agg('- ' || number, chr(10) ORDER BY n) AS cited FROM r GROUP BY l_orderkey)
SELECT l_orderkey, sha256('# Order ' || l_orderkey || chr(10) || chr(10) || '## CLAIMS' || chr(10) || chr(10) || claims || coalesce(chr(10) || chr(10) || '## REFERENCES CITED' || chr(10) || chr(10) || cited, '')) AS markdown_sha256 FROM c LEFT JOIN t USING (l_orderkey)""")
def archive_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages as Markdown: title, claims and references cited."""
    pages = archive_pages.read(_archive(spark, sf_dir), "html")
    return pages.select("l_orderkey", F.sha2(archive_pages.markdown(F.col("page")), 256).alias("markdown_sha256"))


_PASSES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS position FROM lineitem"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))


@query(f"""WITH p AS ({_PASSES}), c AS (SELECT l_orderkey, l_linenumber, arg_max(l_returnflag, position) AS flag FROM p WHERE l_linestatus = 'F' GROUP BY 1, 2)
SELECT p.l_orderkey, CAST(position AS INTEGER) AS position, 'k 0' || p.l_linenumber AS key_element_id, coalesce(flag = 'A', FALSE) AS in_independent_claim, CASE WHEN flag IS NULL THEN 'unresolved' WHEN flag = 'R' THEN 'spec_resolved' ELSE 'self_clear' END AS claim_clarity,
  CASE WHEN flag IS NULL THEN '' ELSE 'issue ' || flag END AS clarity_issue FROM p LEFT JOIN c ON p.l_orderkey = c.l_orderkey AND p.l_linenumber = c.l_linenumber""")
def merged_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over each order's lines merged by ids that are written differently."""
    rows = _lines(spark, sf_dir)
    n = lambda x: x["l_linenumber"].cast("string")
    first = rows.select("l_orderkey", F.transform("lines", lambda x: F.struct(F.concat(F.lit("k 0"), n(x)).alias("key_element_id"))).alias("key_elements"))
    told = lambda x: F.struct(F.concat(F.lit("K"), n(x)).alias("key_element_id"), (x["l_returnflag"] == "A").alias("in_independent_claim"), F.when(x["l_returnflag"] == "R", "spec_resolved").otherwise("self_clear").alias("claim_clarity"), F.concat(F.lit("issue "), x["l_returnflag"]).alias("clarity_issue"))
    second = rows.select("l_orderkey", F.transform(F.filter("lines", lambda x: x["l_linestatus"] == "F"), told).alias("key_element_clarity"))
    merged = structures.merge_passes(first, second, "l_orderkey")
    return merged.select("l_orderkey", "position", "element.key_element_id", "in_independent_claim", "claim_clarity", "clarity_issue")


_ROLE = "CASE l_returnflag WHEN 'R' THEN 'essential' WHEN 'A' THEN 'supporting' ELSE 'core' END"


@query(f"""WITH p AS ({_PASSES}), k AS (SELECT DISTINCT l_orderkey, 'K' || l_linenumber AS id FROM p)
SELECT l_orderkey, 'key_elements[' || position || '].core_role' AS path, 'not_allowed' AS rule, 'core' AS value FROM p WHERE l_returnflag = 'N'
UNION ALL SELECT l_orderkey, 'key_flow[' || position || '].next_key_element_id', 'unknown_element', aim FROM (SELECT *, 'K' || (l_linenumber + 1) AS aim FROM p) x WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.l_orderkey = x.l_orderkey AND id = aim)
UNION ALL SELECT l_orderkey, 'claims[0].claim_elements[' || position || '].maps_to_key_element_id', 'unknown_element', aim FROM (SELECT *, 'K' || (l_suppkey % 9) AS aim FROM p WHERE l_suppkey % 9 <> 0) x WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.l_orderkey = x.l_orderkey AND id = aim)
UNION ALL SELECT l_orderkey, 'claims[0].claim_elements[' || position || '].role', 'not_allowed', 'core' FROM p WHERE l_returnflag = 'N'""")
def structure_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with structures, by path: values that aren't allowed and references to elements that aren't there."""
    rows = _lines(spark, sf_dir).select("l_orderkey", F.posexplode("lines").alias("position", "x")).select("l_orderkey", "position", "x.*")
    elements = rows.selectExpr("l_orderkey", "position", "concat('K', l_linenumber) AS key_element_id", f"{_ROLE} AS core_role", "'unresolved' AS claim_clarity", "'internal' AS observability")
    flow = rows.selectExpr("l_orderkey", "position", "concat('K', l_linenumber) AS key_element_id", "concat('K', l_linenumber + 1) AS next_key_element_id", "'weak' AS coupling_strength")
    parts = rows.selectExpr("l_orderkey", "0 AS claim", "position", "'e' AS claim_element_id", "CASE WHEN l_suppkey % 9 = 0 THEN ' NULL' ELSE concat('K', l_suppkey % 9) END AS maps_to_key_element_id", f"{_ROLE} AS role")
    return structures.violations(elements, flow, parts, "l_orderkey")


_COS = "round(coalesce(list_dot_product(e.v, q.v) / nullif(sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v)), 0), 0), 4)"
_VECTORS = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(f"""WITH {_VECTORS}, q AS (SELECT *, CASE WHEN vec_id % 7 = 0 THEN 'foreign_target_unsupported' WHEN vec_id % 11 = 0 THEN 'filing_date_not_found' END AS skip FROM e WHERE vec_id % 20 = 0),
f AS (SELECT l_orderkey AS target, CAST(l_suppkey AS VARCHAR) AS identity, min(l_linenumber) AS place FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY place, identity) AS n FROM f QUALIFY n <= 3),
s AS (SELECT q.vec_id AS target, CAST(e.vec_id AS VARCHAR) AS identity, {_COS} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS n FROM e JOIN q ON e.label = q.label WHERE e.vec_id <> q.vec_id AND q.skip IS NULL AND q.vec_id NOT IN (SELECT target FROM p WHERE n = 3) QUALIFY n <= 3),
b AS (SELECT target, identity, min(ROW(list, n, origin, similarity)) AS r FROM (SELECT target, identity, 0 AS list, n, 'prior_art' AS origin, NULL::DOUBLE AS similarity FROM p UNION ALL SELECT target, identity, 1, n, 'similar', similarity FROM s) GROUP BY 1, 2)
SELECT target, CAST(row_number() OVER (PARTITION BY target ORDER BY r[1], r[2], identity) AS INTEGER) AS place, identity, r[3] AS origin, r[4] AS similarity,
  CASE WHEN target IN (SELECT target FROM p WHERE n = 3) THEN 'prior_art_only' WHEN skip IS NOT NULL THEN 'similar_skipped:' || skip ELSE 'prior_art_first_then_similar' END AS policy FROM b JOIN q ON target = q.vec_id QUALIFY place <= 3""")
def hybrid_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three documents of each target: cited ones with a text, then similar ones where those are too few."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0")
    targets = hybrid.guarded(asked, abroad=F.col("vec_id") % 7 == 0, code=F.col("label"), filed=F.when(F.col("vec_id") % 11 != 0, F.lit("2001-07-31")), claims=F.lit("claims"))
    cited = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS target", "l_linenumber AS place", "CAST(l_suppkey AS STRING) AS identity", "l_linestatus = 'F' AS has_text")
    return hybrid.context(targets, cited, rows, key="vec_id", vector="embedding", by="label")


_K = 7


@query(f"""WITH {_VECTORS}, n AS (SELECT q.vec_id AS query, q.label AS own, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS n FROM (SELECT * FROM e WHERE vec_id % 20 <> 0) e, (SELECT * FROM e WHERE vec_id % 20 = 0) q QUALIFY n <= {_K}),
c AS (SELECT query, own, label, count(*) AS votes FROM n GROUP BY 1, 2, 3), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY votes DESC, label) = 1),
s AS (SELECT query, own, label, votes, label % 4 <> 3 AS known, CASE WHEN label % 4 <> 3 THEN votes / {_K} ELSE least(votes / {_K}, 0.3) END AS confidence FROM t)
SELECT query, CASE WHEN known THEN CAST(label AS VARCHAR) ELSE 'group ' || (label // 4) END AS label, votes, round(CAST(confidence AS DOUBLE), 4) AS confidence, CASE WHEN round(confidence, 4) >= 0.7 THEN '높음' WHEN round(confidence, 4) >= 0.4 THEN '보통' ELSE '낮음' END AS confidence_text, known AS accepted, label = own AS agrees FROM s""")
def label_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels voted by the seven nearest labelled vectors, within a taxonomy; what it doesn't know falls back to the parent."""
    rows = table(spark, sf_dir, "embeddings")
    asked, known = rows.where("vec_id % 20 = 0"), rows.where("vec_id % 20 <> 0")
    near = neighbours.nearest(known, asked, vector="embedding", key="vec_id", k=_K)
    taxonomy = rows.select("label").distinct().select("label", (F.col("label") % 4 != 3).alias("known"), F.concat(F.lit("group "), F.expr("label div 4").cast("string")).alias("parent"))
    labels = known.select(F.col("vec_id").alias("match"), "label")
    out = hybrid.voted(near, labels, taxonomy, k=_K)
    own = asked.select(F.col("vec_id").alias("query"), F.col("label").alias("own"))
    voted = hybrid.voted(near, labels, taxonomy.withColumn("known", F.lit(True)), k=_K).select("query", F.col("label").alias("_voted"))
    return out.join(own, "query").join(voted, "query").select("query", "label", "votes", "confidence", "confidence_text", "accepted", (F.col("_voted") == F.col("own").cast("string")).alias("agrees"))


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query(rf"""WITH RECURSIVE k AS (SELECT page_id, unnest([CASE WHEN page_id % 3 <> 0 THEN 'host:' || {_HOST} END, CASE WHEN page_id % 2 = 0 THEN 'number:' || regexp_extract(url, '/([0-9]+)', 1) END]) AS i FROM pages),
links AS (SELECT DISTINCT a.page_id AS a, b.page_id AS b FROM k a JOIN k b USING (i) WHERE i NOT IN ('host:', 'number:')),
reach AS (SELECT page_id AS a, page_id AS b FROM pages UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT a AS page_id, min(b) AS entity FROM reach GROUP BY a""")
def page_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are one by host or by number, or by chains of these."""
    host, number = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.regexp_extract("url", "/([0-9]+)", 1)
    names = identity.identity_values(host=F.when(F.col("page_id") % 3 != 0, host), number=F.when(F.col("page_id") % 2 == 0, number))
    return identity.entities(table(spark, sf_dir, "pages").select("page_id", names.alias("names")), "page_id", "names")


_MOST_ROUNDS = 3


@query(f"""WITH RECURSIVE r AS (SELECT conv_id, turn, CAST(length(text) % 100 AS BIGINT) AS score, 0 AS retries FROM conversations
UNION ALL SELECT conv_id, turn, score + 25, retries + 1 FROM r WHERE score < 60 AND retries < {_MOST_ROUNDS})
SELECT conv_id, turn, score, retries, retries + 1 AS checked, CASE WHEN score < 60 THEN 'exhausted' ELSE 'passed' END AS status FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY retries DESC) = 1""")
def rework_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose score is too low are made anew and checked again, three times at most; the others keep their check."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 100).cast("long").alias("score"))
    return rework.rework(rows, F.col("score") < 60, lambda left: left.withColumn("score", F.col("score") + 25), most=_MOST_ROUNDS)


@query("""WITH e AS (SELECT l_orderkey, l_suppkey AS id, bool_or(l_returnflag = 'R') AS official, bool_or(l_returnflag = 'A') AS context FROM lineitem GROUP BY 1, 2),
c AS (SELECT DISTINCT l_orderkey, l_suppkey AS id FROM lineitem WHERE l_linenumber <= 3),
u AS (SELECT l_orderkey, bool_or(official) AS used, string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) FILTER (NOT official AND NOT context) AS improper FROM c JOIN e USING (l_orderkey, id) GROUP BY 1),
s AS (SELECT o_orderkey AS l_orderkey, o_orderkey % 4 * 10 AS a, o_orderkey % 5 * 5 AS b, o_orderkey % 3 * 10 + 10 AS score FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
t AS (SELECT l_orderkey, bool_or(official) AS any_official FROM e GROUP BY 1)
SELECT l_orderkey, CASE WHEN NOT any_official THEN 'query_rewriting' WHEN issues <> '' THEN 'valuation_retry' ELSE 'passed' END AS status, CASE WHEN NOT any_official THEN 'no_official_evidence' ELSE issues END AS issues FROM (
  SELECT l_orderkey, any_official, concat_ws('|', CASE WHEN NOT coalesce(used, FALSE) THEN 'official_evidence_unused' END, 'improper_citations:' || improper, CASE WHEN a NOT IN (0, 10, 30) THEN 'subscore_not_allowed:use' END, CASE WHEN b NOT IN (0, 5, 15, 20) THEN 'subscore_not_allowed:fit' END,
    CASE WHEN (CASE WHEN a IN (0, 10, 30) THEN a ELSE 0 END) + (CASE WHEN b IN (0, 5, 15, 20) THEN b ELSE 0 END) <> score THEN 'score_is_not_the_sum' END) AS issues FROM s JOIN t USING (l_orderkey) LEFT JOIN u USING (l_orderkey))""")
def citation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of an axis against the evidence that they cite: orders cite suppliers of their first lines."""
    lines = table(spark, sf_dir, "lineitem")
    evidence = lines.groupBy("l_orderkey", F.col("l_suppkey").alias("evidence_id")).agg(F.max(F.col("l_returnflag") == "R").alias("official"), F.max(F.col("l_returnflag") == "A").alias("context"))
    cited = lines.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_suppkey"))).alias("cited"))
    k = F.col("o_orderkey")
    scores = table(spark, sf_dir, "orders").select(k.alias("l_orderkey"), F.create_map(F.lit("use"), k % 4 * 10, F.lit("fit"), k % 5 * 5).alias("subscores"), (k % 3 * 10 + 10).alias("score"))
    found = rework.citation_rules(scores.join(cited, "l_orderkey"), evidence, "l_orderkey", {"use": (0, 10, 30), "fit": (0, 5, 15, 20)})
    return found.select("l_orderkey", "status", F.concat_ws("|", "issues").alias("issues"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber AS n, CASE WHEN l_linenumber > 1 AND l_returnflag <> 'R' THEN 'The device of claim ' || (l_linenumber - 1) || ', with part ' || l_partkey || ' on it' ELSE 'A device for part ' || l_partkey || ' and supplier ' || l_suppkey END AS text,
  CASE WHEN l_linenumber > 1 AND l_returnflag <> 'R' THEN l_linenumber - 1 END AS dependency, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag) AS k FROM lineitem)
SELECT l_orderkey, n AS claim_no, text, dependency IS NULL AS is_independent, CAST(dependency AS INTEGER) AS dependency FROM l WHERE k = 1 AND length(text) >= 20""")
def foreign_claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims out of running texts with page marks, images and numbers of pages between them; each order is such a text."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    said = lambda x: F.when((x["l_linenumber"] > 1) & (x["l_returnflag"] != "R"), F.concat(F.lit("The device of claim\n"), (x["l_linenumber"] - 1).cast("string"), F.lit(", with part "), x["l_partkey"].cast("string"), F.lit("  on it"))).otherwise(F.concat(F.lit("A device for part\n\n17\n![image 1](<x>)\n"), x["l_partkey"].cast("string"), F.lit(" and supplier "), x["l_suppkey"].cast("string")))
    lines = F.array_join(F.transform("lines", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(". "), said(x))), "\n## 페이지 2\n")
    body = F.concat(F.lit("1. no claim but a list of what is known here\nCLAIMS\n"), lines, F.lit("\n## 페이지 9\nwhat follows is no claim"))
    # outer: of an inner one Spark would ask the size first, and read each text twice
    rows = held.select("l_orderkey", F.explode_outer(foreign_claims(body)).alias("c")).where("c IS NOT NULL")
    return rows.select("l_orderkey", "c.claim_no", "c.text", "c.is_independent", "c.dependency")
