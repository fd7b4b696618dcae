"""Text functions. Patterns name their characters, so that Java and SQL engines agree on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..config import DOCUMENT_INDICATORS, INDICATOR_STARTS, NEWS_STOPWORDS
from .patents import let

TOKEN = "[0-9a-zA-Z가-힣]{2,}"


def present(c: Column) -> Column:
    """The trimmed text, or null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def first_present(*columns: Column) -> Column:
    return F.coalesce(*(present(c) for c in columns))


def collapse(c: Column) -> Column:
    """Runs of white space (Unicode) to one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s  - 　]+", " "))


def keywords(c: Column, stopwords: tuple[str, ...] = NEWS_STOPWORDS) -> Column:
    """Distinct lower-case tokens of two characters or more that are neither stop words nor all digits; null counts as empty."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({TOKEN})"), 1)
    return F.array_distinct(F.filter(tokens, lambda t: ~t.isin(*stopwords) & ~t.rlike("^[0-9]+$")))


def tokens(c: Column) -> Column:
    """Tokens between white space, in order, with repeats."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[\s 　]+"), lambda t: t != "")


def similarity_tokens(c: Column) -> Column:
    """Distinct lower-case runs of letters, digits and hangul of two characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z가-힣]+"), lambda t: F.length(t) >= 2))


def jaccard(a: Column, b: Column, places: int = 4) -> Column:
    """Of two arrays without repeats: shared over all, 0 when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.round(shared / (F.size(a) + F.size(b) - shared), places))


def digits(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit(""))


def document_key(c: Column) -> Column:
    """Letters and digits in upper case."""
    return F.nullif(F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", "")), F.lit(""))


def product_family(c: Column) -> Column:
    """The text before the first bracket, without spaces, in upper case."""
    return F.nullif(F.upper(F.regexp_replace(F.regexp_extract(F.coalesce(c, F.lit("")), r"^([^(\[（]*)", 1), r"\s+", "")), F.lit(""))


def management_family(c: Column) -> Column:
    """A letter and nine digits, with or without a country suffix: the part before it, in upper case, else null."""
    return F.nullif(F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), r"^([A-Za-z][0-9]{9})(?:-[A-Za-z]{2}[0-9])?$", 1)), F.lit(""))


def slug(c: Column) -> Column:
    """Runs of other characters to _, without _ at the ends; unknown where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9A-Za-z가-힣.-]+", "_"), r"^[_.]+|[_.]+$", ""), F.lit("")), F.lit("unknown"))


def strip_html(c: Column) -> Column:
    """Tags to spaces, the five XML entities and nbsp decoded, white space collapsed."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def sanitize(c: Column) -> Column:
    """Control characters away, but for tab and line ends."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def truncate(c: Column, most: int) -> Column:
    """Cut with an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def hits(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """How many of the words the text contains, each once, whatever the case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w.lower())).cast("int") for w in words], F.lit(0))


def word_hits(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """As hits; Latin words must stand between characters that are no letters or digits, hangul ones may stand anywhere."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: word_hits_in(low, words))


def word_hits_in(low: Column, words: list[str] | tuple[str, ...]) -> Column:
    """The same for a text that is in lower case and not null. A word's edges are only looked for where it occurs at all."""
    has = lambda w: F.contains(low, F.lit(w))
    one = lambda w: has(w) if any("가" <= c <= "힣" for c in w) else has(w) & low.rlike(f"(^|[^0-9a-z]){w}($|[^0-9a-z])")
    return reduce(lambda a, b: a + b, [one(w.lower()).cast("int") for w in words], F.lit(0))


def indicators(text: Column, patterns: dict[str, str] | None = None, starts: dict[str, str] | None = None) -> dict[str, Column]:
    """How often each pattern occurs, whatever the case. starts: the characters that a match can begin with, where known; elsewhere no alternative is tried."""
    first = {n: f"(?=[{c}])" for n, c in (starts or ({} if patterns else INDICATOR_STARTS)).items()}
    return {name: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?iu){first.get(name, '')}(?:{p})")) for name, p in (patterns or DOCUMENT_INDICATORS).items()}


def url_normal(c: Column) -> Column:
    """Scheme and host in lower case, a path at least, no fragment; null unless http or https."""
    scheme, host = F.lower(F.regexp_extract(c, "^([A-Za-z]+)://", 1)), F.lower(F.regexp_extract(c, "^[A-Za-z]+://([^/?#]*)", 1))
    path, query = F.regexp_extract(c, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(c, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query))


def url_host(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), "^[A-Za-z]+://([^/?#:]*)", 1)), F.lit(""))


def in_domain(host: Column, domains: list[str] | tuple[str, ...]) -> Column:
    """The host is one of the domains or below one."""
    return reduce(lambda a, b: a | b, [(host == d) | host.endswith(f".{d}") for d in domains], F.lit(False))


def truthy(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("y", "yes", "true", "1", "t")


def json_object(c: Column) -> Column:
    """The text between the first { and the last }, where that parses as JSON."""
    cut = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(F.nullif(cut, F.lit(""))).isNotNull(), cut)
