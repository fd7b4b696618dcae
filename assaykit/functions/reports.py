"""Texts of industry reports and of written evaluations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..config import BODY_STARTS, FOOTNOTE_START, IMPRINT_MARKS, NUMBERED_HEADING, PAGE_FOOTERS, REPORT_INDUSTRIES, ROUNDING_NOTES, SECTION_LEAST_CHARS, SENTENCE_STARTS, SOURCE_NOTE_START
from .arrays import runs, scan
from .patents import let, lines_of, once, remove_images

_TABLE = r"<\s*표\s*[0-9]+[-–][0-9]+\s*>"
_WEATHER = "[☂☼☁]"


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\x00"), F.lit("")), r"(?U)\s+", " "))


def _kept(c: Column, keep) -> Column:
    return F.array_join(F.filter(lines_of(c), keep), "\n")


def without_footers(c: Column, patterns: tuple[str, ...] = PAGE_FOOTERS) -> Column:
    return _kept(c, lambda x: ~reduce(lambda a, b: a | b, [F.trim(x).rlike(p) for p in patterns]))


def clean_report(c: Column) -> Column:
    """Images and footers away, at most one blank line, no spaces at line ends."""
    out = F.regexp_replace(without_footers(remove_images(c)), "\n{3,}", "\n\n")
    return F.trim(F.array_join(F.transform(lines_of(out), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n"))


def is_table_heading(c: Column) -> Column:
    return c.rlike(_TABLE)


def table_references(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(_TABLE))


@once
def is_note(c: Column) -> Column:
    """Nothing, a short note to a table, or symbols of an outlook table only."""
    rest = lambda s: F.regexp_replace(s, r"[☂☼ㆍ·\s,.:;()（）전년대비영향정도큰폭감소다소증가]", "")
    return let(_squeezed(c), lambda s: (s == "") | ((F.length(s) <= 160) & (s.rlike(r"^(주|자료|단위)\s*:") | (rest(s) == ""))))


def is_symbol_line(c: Column) -> Column:
    return c.rlike(_WEATHER) & ((F.length(c) <= 240) | (F.regexp_count(c, F.lit(_WEATHER)) >= 2))


def is_imprint(c: Column) -> Column:
    squeezed = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")
    return let(squeezed, lambda s: reduce(lambda a, b: a + b, [F.contains(s, F.lit(m)).cast("int") for m in IMPRINT_MARKS]) >= 2)


def without_table_lines(c: Column) -> Column:
    """Lines without table headings, notes, symbols and marks of removed tables; blank lines stay."""
    bare = F.array_join(F.transform(lines_of(c), lambda x: F.replace(F.trim(x), F.lit("\x00"), F.lit(""))), "\n")
    return _kept(bare, lambda x: (x == "") | ~(is_table_heading(x) | is_note(x) | is_symbol_line(x) | x.rlike(r"^((주|자료|단위)\s*:|<!--\s*removed_tables:)")))


@once
def keeps(c: Column, least: int = SECTION_LEAST_CHARS) -> Column:
    """A section worth keeping: long enough, no list of tables, note or imprint."""
    return ~is_note(c) & (table_references(c) < 3) & ~is_imprint(c) & (F.length(F.trim(c)) >= least)


def from_body_start(c: Column) -> Column:
    """The text from the first line that starts a body; empty without one."""
    lines = lines_of(c)
    at = F.array_position(F.transform(lines, lambda x: F.trim(x).rlike("|".join(BODY_STARTS))), True)
    return F.when(at > 0, F.trim(F.array_join(F.slice(lines, at.cast("int"), F.greatest(F.size(lines), F.lit(1))), "\n"))).otherwise("")


def body_heading(c: Column, most: int = 80) -> Column:
    """The first line with a box or a number in brackets, else the first line; null for nothing."""
    lines = F.filter(F.transform(lines_of(c), lambda x: F.trim(x)), lambda x: x != "")
    marked = F.get(F.filter(lines, lambda x: x.rlike(r"^(\([0-9]+\)|□)")), F.lit(0))
    return F.substring(F.coalesce(marked, F.get(lines, F.lit(0))), 1, most)


def industry_of(c: Column, names: tuple[str, ...] = REPORT_INDUSTRIES) -> Column:
    """The first of the names that a text contains, whatever its spaces."""
    tight = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    return let(tight, lambda x: F.coalesce(*(F.when(F.contains(x, F.lit(n)), n) for n in names)))


def page_mark(line: Column) -> Column:
    """The number of a page mark (`- 5 -`, `page 5`, `페이지 5`, also as a heading), or null."""
    bare = F.trim(F.regexp_replace(F.trim(line), "^#+", ""))
    return F.nullif(F.regexp_extract(bare, r"(?i)^(?:-\s*|page\s*|페이지\s*)([0-9]+)(?:\s*-)?$", 1), F.lit("")).cast("int")


@once
def report_heading(line: Column) -> Column:
    """A line's heading: Markdown, table, short industry line, or outline number; notes and symbols have none."""
    markdown = F.regexp_extract(line, r"^#{1,6}\s+(.+)$", 1)
    outline = F.regexp_extract(line, r"^(?:[0-9]{1,2}[.)]|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+[.)]?|[가-힣][.)])\s+(.{2,80})$", 1)
    short = (F.length(line) <= 40) & industry_of(line).isNotNull()
    made = F.when(markdown != "", F.trim(markdown)).when(is_table_heading(line) | short, line).when(outline != "", F.trim(outline))
    # most lines are none, and are asked no more
    return let(made, lambda x: F.when(x.isNotNull() & ~(line.startswith("⋅") | is_note(line) | is_symbol_line(line)), x))


def report_kind(name: Column) -> Column:
    """The family of a report by its file's name, which decides how it is cut."""
    low = F.lower(F.coalesce(name, F.lit("")))
    has = lambda *w: reduce(lambda a, b: a & b, [F.contains(low, F.lit(x)) for x in w])
    return (
        F.when(has("kiet") | has("경제ㆍ산업_전망") | has("경제산업_전망"), "kiet").when(has("ai_index") | has("ai index"), "ai_index").when(has("mckinsey", "technology", "trends"), "technology_trends")
        .when(has("wef", "top", "emerging", "technologies") | has("world economic forum", "emerging technologies"), "emerging_technologies").when(has("kpmg") & (has("ai") | has("수익")), "consulting_ai")
        .when(has("kpmg") | has("핀테크"), "consulting_fintech").when(has("기계산업"), "machine_whitepaper").otherwise("generic")
    )


def published_year(name: Column) -> Column:
    """The latest year from 2000 on in a name, or null."""
    return F.array_max(F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit("(20[0-9]{2})"), 1), lambda y: y.cast("int")))


def chunk_id(source: Column, year: Column, industry: Column, page: Column, number: Column) -> Column:
    """source_year_industry_page_number; the number has three places."""
    key = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Za-z가-힣ㄱ-ㅎㅏ-ㅣᄀ-ᇿ]+", "_"), "^_+|_+$", "")
    stem = F.coalesce(F.nullif(key(F.regexp_replace(source, r"\.[^.]*$", "")), F.lit("")), F.lit("industry_report"))
    return F.concat_ws("_", stem, F.coalesce(year.cast("string"), F.lit("unknown")), key(industry), F.concat(F.lit("p"), F.coalesce(F.nullif(page, F.lit(0)).cast("string"), F.lit("000"))), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))


# --- written evaluations --------------------------------------------------------------------------


def numbered_sections(c: Column) -> Column:
    """A map of a report's `## n.` sections to their bodies; of repeats the last."""
    mark = r"(?m)^##[ \t]+([0-9]+)[.)][^\n]*$\n?"
    numbers, parts = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(mark), 1), F.split(F.coalesce(c, F.lit("")), mark)
    pairs = F.transform(numbers, lambda n, i: F.struct(n.alias("n"), F.trim(F.regexp_replace(F.get(parts, i + 1), r"^\s+|\s+$", "")).alias("body")))
    last = lambda every: F.filter(every, lambda x, i: ~F.exists(F.slice(every, i + 2, F.greatest(F.size(every), F.lit(1))), lambda y: y["n"] == x["n"]))
    return F.map_from_entries(last(pairs))


def sanitized_report(c: Column) -> Column:
    """Without lines on how details were scored and lists of references."""
    return F.trim(_kept(c, lambda x: ~(F.trim(x).rlike(r"^\(?세부\s*점수\s*반영\s*:.*\)?$") | F.trim(x).startswith("[참고 근거]") | F.trim(x).startswith("참고 근거"))))


def report_issues(markdown: Column, axes: Column, recommendation: Column, country: Column, required: tuple[str, ...] = ("1", "2", "3", "4", "5", "6"), needed: tuple[str, ...] = ("legal", "technology", "market", "business_fit")) -> Column:
    """What a written report lacks: the text, axes, sections, the recommendation, and wording that fits a foreign patent."""
    some = F.coalesce(markdown, F.lit("")) != ""
    sections = F.map_keys(numbered_sections(markdown))
    missing = F.array_except(F.array(*map(F.lit, required)), sections)
    told = F.trim(F.regexp_extract(F.coalesce(markdown, F.lit("")), r"(?m)^\|\s*종합 검토 의견\s*\|\s*([^|]+?)\s*\|$", 1))
    wanted, abroad = F.trim(F.coalesce(recommendation, F.lit(""))), ~F.upper(F.trim(F.coalesce(country, F.lit("")))).isin("", "KR")
    out = [
        F.when(~some, "missing_report"), *(F.when(~F.array_contains(axes, a), f"missing_axis:{a}") for a in needed), F.when(F.array_contains(axes, "strategy"), "deprecated_axis:strategy"),
        F.when(some & (F.size(missing) > 0), F.concat(F.lit("missing_sections:"), F.array_join(missing, ","))), F.when(some & (wanted != "") & (told != wanted), "other_recommendation"),
        F.when(some & abroad & markdown.rlike(r"국내\s*(?:권|특허|출원|등록)"), "domestic_wording"), F.when(some & abroad & markdown.contains("권리범위 참고도 및 이해"), "drawing_block"),
    ]
    return F.filter(F.array(*out), lambda x: x.isNotNull())


# --- sections that are no prose -------------------------------------------------------------------


def _count(c: Column, word: str) -> Column:
    return F.regexp_count(c, F.lit(word))


def _shares(c: Column) -> Column:
    """Tokens of a text, and the shares of single letters and of tokens of one or two characters among them."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    return let(words, lambda w: F.struct(F.size(w).alias("n"), (F.size(F.filter(w, lambda x: x.rlike("^[A-Za-z]$"))) / F.greatest(F.size(w), F.lit(1))).alias("letters"), (F.size(F.filter(w, lambda x: F.length(x) <= 2)) / F.greatest(F.size(w), F.lit(1))).alias("short")))


@once
def is_figures_only(c: Column) -> Column:
    marks, sentences = _count(c, "Figure ") + _count(c, "Table "), _count(c, r"\. ")
    small = (F.length(c) < 180) & c.contains("Figure ") & c.contains("Source:")
    return (F.length(c) <= 900) & (((marks >= 3) & (sentences <= 2)) | ((marks >= 2) & (sentences <= 1)) | small)


@once
def is_chart_noise(c: Column) -> Column:
    """A chart's letters as recognition reads them."""
    marked = c.contains("Figure ") | c.contains("Source:") | c.contains("Data source:")
    return (F.length(c) <= 260) & let(_shares(c), lambda s: (s["n"] >= 18) & ((s["letters"] >= 0.35) | (s["short"] >= 0.75) | (marked & (s["letters"] >= 0.25))))


@once
def is_chart_tail(c: Column) -> Column:
    marked = c.contains("Chart:") | c.contains("Figure ") | c.contains("Data source:")
    return marked & let(_shares(c), lambda s: (s["n"] >= 25) & ((s["letters"] >= 0.15) | (s["short"] >= 0.45)))


@once
def without_chart_tail(c: Column) -> Column:
    """The text up to the first source mark behind which only a chart's letters follow; from the sentence's end before it, if that is near. Source marks come before data source marks."""

    def cut(mark: str) -> Column:
        parts = F.split(c, mark)
        tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), mark).alias("head"), F.concat(F.lit(mark), F.array_join(F.slice(parts, k + 1, F.size(parts)), mark)).alias("tail")))
        found = F.get(F.filter(tails, lambda x: is_chart_tail(x["tail"])), F.lit(0))["head"]

        def ended(head: Column) -> Column:
            end = F.length(head) - F.locate(" .", F.reverse(head))  # place of the full stop of the last ". ", from 1
            near = (F.locate(" .", F.reverse(head)) > 0) & (F.length(head) - (end - 1) <= 180)
            return F.when(near, F.substring(head, F.lit(1), end)).otherwise(F.trim(head))

        return F.when(F.size(parts) > 1, let(found, lambda h: F.when(h.isNotNull(), ended(h))))

    return F.coalesce(cut(" Source:"), cut(" Data source:"), c)


@once
def is_source_note(c: Column) -> Column:
    low = F.lower(c)
    rounding = reduce(Column.__or__, map(low.contains, ROUNDING_NOTES))
    return (F.length(c) <= 260) & (c.rlike(SOURCE_NOTE_START) | (c.rlike(r"^[0-9]+\s+") & rounding))


def is_footnote(c: Column) -> Column:
    return (F.length(c) <= 500) & c.rlike(FOOTNOTE_START)


def is_running_head(c: Column, title: str) -> Column:
    """Little more than the report's running title."""
    return (F.length(c) < 220) & F.contains(c, F.lit(title)) & ~c.contains(". ")


@once
def is_no_prose(c: Column, title: str) -> Column:
    return is_figures_only(c) | is_chart_noise(c) | is_source_note(c) | is_footnote(c) | is_running_head(c, title)


def numbered_heading(line: Column, stops: tuple[str, ...] = SENTENCE_STARTS, most: int = 100) -> Column:
    """`n.n Title`, up to the first word that begins a sentence; null without one."""
    found = F.regexp_extract(F.coalesce(line, F.lit("")), NUMBERED_HEADING, 1)
    for stop in stops:
        found = F.substring_index(found, stop, 1)
    return F.nullif(F.substring(F.trim(found), 1, most), F.lit(""))


def lines_from_words(words: Column, gap: float = 3.0) -> Column:
    """A page's text from its words (text, top, x): by rounded top, then x; a new line where the top is further than gap from the line's first word; within a line by x."""
    number = lambda w, name: w[name].cast("double").alias(name)
    ordered = F.array_sort(F.transform(words, lambda w, i: F.struct(F.bround(w["top"].cast("double")).alias("r"), number(w, "x"), i.alias("i"), number(w, "top"), w["text"].alias("text"))))

    def step(line: Column, w: Column) -> Column:
        fresh = line["top"].isNull() | (F.abs(w["top"] - line["top"]) > gap)
        return F.when(fresh, F.struct(w["top"].alias("top"), (line["no"] + 1).alias("no"))).otherwise(line)

    def lines(ws: Column) -> Column:
        start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0).alias("no"))
        numbered = let(scan(ws, start, "struct<top:double,no:int>", step), lambda at: F.transform(ws, lambda w, i: F.struct(F.get(at, i)["no"].alias("no"), w["x"].alias("x"), i.alias("i"), w["text"].alias("text"))))
        return runs(F.array_sort(numbered), lambda xs, i: F.get(xs, i)["no"] != F.get(xs, i - 1)["no"])

    return F.array_join(F.transform(let(ordered, lines), lambda line: F.array_join(F.transform(line, lambda w: w["text"]), " ")), "\n")


# --- texts of scanned documents -------------------------------------------------------------------


@once
def has_text(c: Column) -> Column:
    """A page's text says something: an abstract, claims, a numbered line, or 400 characters beside images."""
    lines = F.filter(F.transform(lines_of(c), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"(?i)^!\[image\s+[0-9]+\]\(.+\)$"))
    keyed = c.rlike(r"(?i)\babstract\b") | c.rlike(r"(?i)\bclaims?\b") | c.rlike(r"\b[0-9]+\.\s+\S+")
    return F.coalesce(keyed | ((F.length(F.trim(c)) >= 200) & (F.length(F.array_join(lines, " ")) >= 400)), F.lit(False))


@once
def is_drawing_sheet(c: Column) -> Column:
    """A page of drawings: sheet marks, figures with little prose, or few letters among digits."""
    sheet = r"(?i)\b(?:sheet|heet)\s+[0-9]+\s+of\s+[0-9]+\b"

    def of(lines: Column) -> Column:
        count = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
        figures, sheets, prose = count(r"(?i)\bFIGS?\b"), count(rf"{sheet}|(?i)\bU\.?S\.?\s+Patent\b"), count("[A-Za-z]{4,}.*[A-Za-z]{4,}")
        letters, digits = F.length(F.regexp_replace(c, r"[^\p{L}]", "")), F.length(F.regexp_replace(c, r"[^0-9]", ""))
        sparse = (letters < 200) & (digits > F.floor(letters / 2)) & ((figures > 0) | (sheets > 0))
        return ((figures >= 2) & (prose <= 8)) | ((sheets >= 2) & (prose <= 10)) | sparse

    blank = F.trim(F.coalesce(c, F.lit(""))) == ""
    return blank | c.rlike(sheet) | let(F.filter(F.transform(lines_of(c), lambda x: F.trim(x)), lambda x: x != ""), of)


def without_front_matter(c: Column) -> Column:
    """The text from the first heading of a description on; the whole text without one."""
    body = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?im)^(\s*(?:TECHNICAL FIELD|BACKGROUND ART|BACKGROUND|DISCLOSURE|SUMMARY|BEST MODE|DETAILED DESCRIPTION|DESCRIPTION OF DRAWINGS|BRIEF DESCRIPTION OF (?:THE )?DRAWINGS)\b(?s:.*))", 1)
    return F.regexp_replace(F.when(body != "", body).otherwise(F.coalesce(c, F.lit(""))), r"^\s+|\s+$", "")
