"""Landed pages of patent archives: sections, claims, references and figures out of their HTML.

Pages are read as trees (or, if their tags are plain, in one pass that keeps the open elements): elements know what stands inside them, so a table row ends where it ends, claims may be nested, and tags that
were never closed are closed by what follows, as browsers do. The reader is a small helper in Arrow batches; what is done with the
parts is columns and rows. Broken and empty pages give empty parts.
"""

from __future__ import annotations

import html
import html.parser
import itertools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..functions.patents import let

_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
#: What a start tag ends, if it is still open, and where the search for it stops.
_ENDS = {
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "li": ({"li"}, {"ul", "ol"}), "option": ({"option"}, {"select"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    **{t: ({"p"}, {"td", "th", "li", "div", "section", "article"}) for t in ("p", "div", "section", "article", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6")},
}
_HIDDEN = frozenset({"script", "style", "svg", "noscript"})
_HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
_REFERENCE = ("publicationNumber", "priorityDate", "publicationDate", "assigneeOriginal", "title")
_INNER = frozenset({*_REFERENCE, "examinerCited"})


class Element:
    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def walk(self):
        """Elements below, in the order of their start tags."""
        stack = [p for p in reversed(self.parts) if isinstance(p, Element)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(p for p in reversed(node.parts) if isinstance(p, Element))

    def text(self) -> str:
        if all(isinstance(p, str) for p in self.parts):
            return " ".join("".join(self.parts).split())
        out: list[str] = []
        stack: list = list(reversed(self.parts))
        while stack:
            part = stack.pop()
            if isinstance(part, str):
                out.append(part)
            elif part.tag not in _HIDDEN:
                out.append(" ")
                stack.append(" ")
                stack.extend(reversed(part.parts))
        return " ".join("".join(out).split())

    def has_class(self, name: str) -> bool:
        return "class" in self.attrs and name in self.attrs["class"].split()

    def prop(self) -> str:
        return self.attrs.get("itemprop") or ""


class _Tree(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Element("", {}, None)
        #: All elements in the order of their start tags.
        self.elements: list[Element] = []

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        ends, stops = _ENDS.get(tag, ((), ()))
        node, last = self.here, None
        while ends and node.parent and node.tag not in stops:
            if node.tag in ends:
                last = node
            node = node.parent
        if last:
            self.here = last.parent
        node = Element(tag, attrs, self.here)
        self.here.parts.append(node)
        self.elements.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_starttag(self, tag, attrs):
        self.start(tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.here.tag == tag and tag not in _VOID:
            self.here = self.here.parent

    def handle_endtag(self, tag):
        node = self.here
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:  # an end without a start changes nothing
            self.here = node.parent

    def handle_data(self, data):
        self.here.parts.append(data)


#: Tags that every reader of HTML reads alike: plain names and attributes, nothing escaped. Pages of such tags and text alone need no HTMLParser and no tree.
_START = re.compile("""<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][-a-zA-Z0-9_:.]*(?:=(?:"[^"<>&]*"|'[^'<>&]*'|[^ \t\n\r\f\v"'=<>`&/]+))?)*)[ \t\n\r\f]*>""")
_ATTRIBUTE = re.compile("""([a-zA-Z][-a-zA-Z0-9_:.]*)(?:=(?:"([^"]*)"|'([^']*)'|([^ \t\n\r\f"']+)))?""")
_END = re.compile("</([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*>")
#: Elements whose content isn't tags.
_RAW = frozenset({"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "svg", "math"})
def _tag(piece: str) -> tuple[str, dict[str, str] | None] | None:
    """Name and attributes (None: an end tag) of a plain tag; None where HTMLParser has to read it."""
    if m := _END.fullmatch(piece):
        return (m[1].lower(), None)
    if (m := _START.fullmatch(piece)) and m[1].lower() not in _RAW:
        return (m[1].lower(), {x[1].lower(): x[2] or x[3] or x[4] or "" for x in _ATTRIBUTE.finditer(m[2])})
    return None


class _Mark:
    """What a start tag means for the parts of a page."""

    __slots__ = ("void", "meta", "row", "reference", "link", "figure", "heading", "abstract", "description", "claim_text", "claim", "prop", "more")

    def __init__(self, tag: str, attrs: dict[str, str]):
        prop, classes = attrs.get("itemprop") or "", attrs.get("class", "").split()
        self.void = tag in _VOID
        name = (attrs.get("name") or "").lower() if tag == "meta" else ""
        self.meta = (name, " ".join((attrs.get("content") or "").split())) if name in ("dc.title", "dc.description") else None
        self.row = tag == "tr"
        self.reference = ("backward" if prop.startswith("backward") else "forward") if self.row and prop.startswith(("backwardReferences", "forwardReferences")) else None
        self.link = tag == "a" and bool(attrs.get("href"))
        self.figure = attrs.get("src") if tag == "img" and prop == "thumbnail" else None
        self.heading = tag in _HEADINGS
        self.abstract = tag in ("section", "div") and "abstract" in classes
        self.description = prop == "description"
        self.claim_text = "claim-text" in classes
        self.claim = int(attrs["num"]) if "claim" in classes and (attrs.get("num") or "").isdecimal() else None
        self.prop = prop if prop in _INNER else None
        self.more = self.claim is not None or any((self.meta, self.row, self.link, self.figure, self.heading, self.abstract, self.description, self.claim_text))


class _Open(dict):
    """The elements that are open at some place of a page. By a tag as it stands: what is open after it, how many of those that were stay
    open (-1: the tag changes nothing) and its mark, if it has one; None where HTMLParser has to read the page.

    Pages share these, since few tags follow few others; they are begun anew when there are many."""

    __slots__ = ("name", "above", "depth", "below")
    made = 0

    def __init__(self, name: str = "", above: _Open | None = None):
        super().__init__()
        self.name, self.above, self.depth, self.below = name, above, above.depth + 1 if above is not None else 0, {}

    def __missing__(self, piece: str) -> tuple[_Open, int, _Mark | None] | None:
        _Open.made += 1
        if _Open.made > _KNOWN_MOST + _KNOWN_OF_A_PAGE:
            return None
        self[piece] = step = self._step(piece)
        return step

    def _step(self, piece: str) -> tuple[_Open, int, _Mark | None] | None:
        if not (told := _tag(f"<{piece}>")):
            return None
        tag, attrs = told
        node, last = self, None
        if attrs is None:
            while node.above is not None and node.name != tag:
                node = node.above
            return (self, -1, None) if node.above is None else (node.above, node.above.depth, None)
        ends, stops = _ENDS.get(tag, ((), ()))
        while ends and node.above is not None and node.name not in stops:
            if node.name in ends:
                last = node
            node = node.above
        stays = self if last is None else last.above
        mark = _Mark(tag, attrs)
        if mark.void:
            inner = stays
        elif (inner := stays.below.get(tag)) is None:
            inner = stays.below[tag] = _Open(tag, stays)
        return inner, stays.depth, mark if mark.prop or mark.more else None


#: Steps that a worker remembers between pages, and more that one page may add.
_KNOWN_MOST, _KNOWN_OF_A_PAGE = 4_096, 16_384
_root = _Open()


def _plain(page: str) -> tuple | None:
    """The parts of a page of plain tags and text, in one pass without a tree; None for other pages.

    An element's text lies between its start and its end, and any tag that starts or ends one is white space to it."""
    global _root
    if _Open.made > _KNOWN_MOST:
        _root, _Open.made = _Open(), 0
    here, (first, *rest) = _root, page.split("<")
    texts = [first]
    meta: dict[str, str] = {}
    abstract = description = shown = None
    claims, waiting, loose, references, citing, figures, headings, rows, links = [], [], [], [], [], [], [], 0, 0
    inside: list[list] = []  # elements whose text is asked for and that are open: depth, first text, end
    deepest = 0
    for part in rest:
        piece, end, data = part.partition(">")
        if not end or not (step := here[piece]):
            return None
        here, stay, mark = step
        if "&" in data:
            data = data.replace("&amp;", "&") if data.count("&") == data.count("&amp;") else html.unescape(data)
        if stay < 0:
            texts.append(data)
            continue
        if deepest > stay:
            while inside and inside[-1][0] > stay:
                gone = inside.pop()
                gone[2] = len(texts)
                if gone is shown:
                    shown = None
                if waiting and waiting[-1][2] is gone:
                    waiting.pop()
                if citing and citing[-1][0] is gone:
                    citing.pop()
            deepest = inside[-1][0] if inside else 0
        if mark is not None:
            at, asked = [stay + 1, len(texts), len(texts) if mark.void else None], False
            if mark.prop and citing:
                asked = True
                for _, found in citing:
                    found.setdefault(mark.prop, at)
            if mark.more:
                if mark.claim_text and (waiting or shown is None):
                    asked = True
                    for claim in waiting:
                        claim[1] = at
                    waiting.clear()
                    if shown is None:
                        loose.append(at)
                        if not mark.void:
                            shown = at
                if mark.claim is not None:
                    asked = True
                    claims.append([mark.claim, None, at])
                    if not mark.void:
                        waiting.append(claims[-1])
                if mark.row:
                    rows += 1
                    if mark.reference:
                        asked, found = True, {}
                        references.append((mark.reference, found))
                        citing.append((at, found))
                elif mark.link:
                    links += 1
                elif mark.figure:
                    figures.append(mark.figure)
                elif mark.heading:
                    asked = True
                    headings.append(at)
                elif mark.meta:
                    meta.setdefault(*mark.meta)
                if mark.abstract and abstract is None:
                    asked, abstract = True, at
                if mark.description and description is None:
                    asked, description = True, at
            if asked and not mark.void:
                inside.append(at)
                deepest = stay + 1
        texts.append(" " + data)

    def text_of(at: list | None) -> str:
        return " ".join("".join(texts[at[1] : at[2]]).split()) if at else ""

    told = [(n, body) for n, at, _ in claims if (body := text_of(at))] or list(enumerate(filter(None, map(text_of, loose)), 1))
    cited = [(kind, *(text_of(found.get(n)) or None for n in _REFERENCE), "examinerCited" in found) for kind, found in references]
    return (
        meta.get("dc.title") or None, meta.get("dc.description") or text_of(abstract) or None, text_of(description) or None,
        told, cited, list(dict.fromkeys(figures)), list(filter(None, map(text_of, headings))), rows, links,
    )


def tree(page: str | None) -> _Tree:
    made = _Tree()
    made.feed(page or "")
    made.close()
    return made


def parse(page: str | None) -> Element:
    return tree(page).root


_PART = "struct<title:string,abstract:string,description:string,claims:array<struct<number:int,text:string>>,references:array<struct<kind:string,number:string,priority_date:string,publication_date:string,assignee:string,title:string,examiner_cited:boolean>>,figures:array<string>,headings:array<string>,n_rows:int,n_links:int>"


def _parts(page: str | None) -> tuple:
    if made := _plain(page or ""):
        return made
    meta: dict[str, str] = {}
    found: dict[str, str] = {}
    claims, loose, references, figures, headings, rows, links = [], [], [], [], [], 0, 0
    for e in tree(page).elements:
        prop = e.prop()
        if e.tag == "meta":
            meta.setdefault((e.attrs.get("name") or "").lower(), " ".join((e.attrs.get("content") or "").split()))
        elif e.tag == "title":
            found.setdefault("title", e.text())
        elif e.tag == "tr":
            rows += 1
            if prop.startswith(("backwardReferences", "forwardReferences")):
                inner: dict[str, str] = {}
                for x in e.walk():
                    if x.prop():
                        inner.setdefault(x.prop(), x.text())
                kind = "backward" if prop.startswith("backward") else "forward"
                references.append((kind, *(inner.get(n) or None for n in _REFERENCE), "examinerCited" in inner))
        elif e.tag == "a" and e.attrs.get("href"):
            links += 1
        elif e.tag == "img" and prop == "thumbnail" and e.attrs.get("src"):
            figures.append(e.attrs["src"])
        elif e.tag in _HEADINGS:
            headings.append(e.text())
        if not e.attrs:
            continue
        if e.tag in ("section", "div") and e.has_class("abstract"):
            found.setdefault("abstract", e.text())
        if prop == "description":
            found.setdefault("description", e.text())
        if e.has_class("claim-text") and not any(a.has_class("claim-text") for a in _above(e)):
            loose.append(e.text())
        if e.has_class("claim") and (e.attrs.get("num") or "").isdecimal():
            body = next((x.text() for x in e.walk() if x.has_class("claim-text")), "")
            if body:
                claims.append((int(e.attrs["num"]), body))
    told = claims or [(i, t) for i, t in enumerate((x for x in loose if x), 1)]
    return (
        meta.get("dc.title") or found.get("title") or None, meta.get("dc.description") or found.get("abstract") or None, found.get("description") or None,
        told, references, list(dict.fromkeys(figures)), [h for h in headings if h], rows, links,
    )


def _above(e: Element):
    while e.parent:
        e = e.parent
        yield e


def _lists(rows: tuple[list, ...], values: Callable[[list], pa.Array]) -> pa.Array:
    """A list for each row, of the values that are made of all of them at once."""
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values(list(itertools.chain.from_iterable(rows))))


def _structs(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Array:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _struct(got: list[tuple]) -> pa.Array:
    """The parts of many pages, column by column."""
    s, text = pa.string(), lambda x: pa.array(x, pa.string())
    title, abstract, description, claims, references, figures, headings, rows, links = zip(*got, strict=True) if got else [()] * 9
    cited = ["kind", "number", "priority_date", "publication_date", "assignee", "title", "examiner_cited"]
    return pa.StructArray.from_arrays(
        [
            text(title), text(abstract), text(description),
            _lists(claims, lambda x: _structs(x, ["number", "text"], [pa.int32(), s])), _lists(references, lambda x: _structs(x, cited, [s] * 6 + [pa.bool_()])),
            _lists(figures, text), _lists(headings, text), pa.array(rows, pa.int32()), pa.array(links, pa.int32()),
        ],
        ["title", "abstract", "description", "claims", "references", "figures", "headings", "n_rows", "n_links"],
    )


def read(df: DataFrame, column: str, name: str = "page") -> DataFrame:
    """df with a struct of each page's parts: title, abstract, description, claims (number, text), references (kind backward or forward, number, dates, assignee, title, examiner_cited),
    figures (addresses of thumbnails), headings, n_rows of tables and n_links."""

    @F.arrow_udf(_PART)
    def parts(pages: pa.Array) -> pa.Array:
        return _struct([_parts(p) for p in pages.to_pylist()])

    return df.withColumn(name, parts(column))


def references(pages: DataFrame, key: str, page: str = "page") -> DataFrame:
    """A row for each document that a page refers to, each number and direction once, the first that comes: key, position, kind, country_code, document_number, kind_code, display_number and the reference's fields.

    Numbers that are no country, digits and kind are left out."""
    # outer: of an inner one Spark would ask the size first, and read each page twice
    rows = pages.select(key, F.posexplode_outer(f"{page}.references").alias("position", "r")).where("r IS NOT NULL")
    plain = F.regexp_replace(F.upper(F.coalesce("r.number", F.lit(""))), "[^0-9A-Z]", "")
    cut = lambda i: F.regexp_extract("_plain", r"^([A-Z]{2})([0-9]+)([A-Z][0-9]?)$", i)
    whole = rows.withColumn("_plain", plain).withColumns({"country_code": cut(1), "document_number": cut(2), "kind_code": cut(3)}).where("country_code <> ''")
    first = whole.groupBy(key, "r.kind", F.col("_plain").alias("publication_number")).agg(F.min(F.struct("position", "country_code", "document_number", "kind_code", "r.priority_date", "r.publication_date", "r.assignee", "r.title", "r.examiner_cited")).alias("f"))
    return first.select(key, "kind", "publication_number", "f.*", F.concat_ws(" ", "f.country_code", "f.document_number", "f.kind_code").alias("display_number"))


def markdown(page: Column) -> Column:
    """The parts of a page as Markdown sections; missing ones are left out."""
    some = lambda head, body: F.when(text.present(body).isNotNull(), F.concat(F.lit(head), body))
    claims = F.array_join(F.transform(page["claims"], lambda c: F.concat(c["number"].cast("string"), F.lit(". "), c["text"])), "\n\n")
    number = lambda r: F.regexp_replace(F.upper(F.coalesce(r["number"], F.lit(""))), "[^0-9A-Z]", "")
    cited = F.array_distinct(F.filter(F.transform(F.filter(page["references"], lambda r: r["kind"] == "backward"), number), lambda n: n.rlike(r"^[A-Z]{2}[0-9]+[A-Z][0-9]?$")))
    shown = let(cited, lambda ns: F.array_join(F.transform(ns, lambda n: F.concat(F.lit("- "), F.regexp_replace(n, r"^([A-Z]{2})([0-9]+)(.*)$", "$1 $2 $3"))), "\n"))
    return F.concat_ws("\n\n", some("# ", page["title"]), some("## ABSTRACT\n\n", page["abstract"]), some("## DETAILED DESCRIPTION\n\n", page["description"]), some("## CLAIMS\n\n", claims), some("## REFERENCES CITED\n\n", shown))
