"""General HTML as tokens: a state machine over a page's text.

The states are those of a browser's tokenizer, without its error reports: data,
tags with quoted, unquoted and bare attributes, comments, declarations and
other markup that counts as a comment, text that ends only at its own end tag (script, style and
their like raw, title and textarea with character references). References are
decoded by the rules of HTML 5, named ones by their longest known name, in attributes not
before a letter, digit or equals sign.

Pages go through in Arrow batches, one after another, whole; the work is linear in
their length. Tokens are rows, so what is wanted of pages (text, links, tags) is
asked in DataFrame terms. A null page has no tokens, an empty one neither.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

from sheafline.session import ship

SPACES = " \t\n\r\f"
RAW = ("script", "style", "xmp", "iframe", "noembed", "noframes")
REFERENCES_ONLY = ("title", "textarea")
#: Elements whose text a reader doesn't see.
HIDDEN = ("script", "style", "title", "template", "iframe", "noembed", "noframes")
#: Elements that begin and end a line.
BLOCKS = ("address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul")

_LETTER = re.compile("[A-Za-z]")
_NAME_END = re.compile(r"[ \t\n\r\f/>]")
_ATTRIBUTE_END = re.compile(r"[ \t\n\r\f/>=]")
_UNQUOTED_END = re.compile(r"[ \t\n\r\f>]")
_COMMENT_END = re.compile("--!?>")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|([A-Za-z][A-Za-z0-9]*+)(;|(?!=)))")


class Token(NamedTuple):
    kind: str  # text, start, end, comment, doctype
    name: str = ""
    text: str = ""
    attributes: dict[str, str] | None = None
    closed: bool = False


def _attribute_value(raw: str) -> str:
    """References decoded: a name only as a whole word, and without its semicolon only where one of that form is known."""

    def decoded(m: re.Match[str]) -> str:
        return html5.get(m[1] + m[2], m[0]) if m[1] else unescape(m[0])

    return _REFERENCE.sub(decoded, raw) if "&" in raw else raw


def _small(name: str) -> str:
    """A to Z in small letters, others as they are."""
    return name.lower() if name.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), name)


def _tag(page: str, at: int) -> tuple[int, str, dict[str, str], bool] | None:
    """Of a tag whose name begins at a place: where it has ended, name, attributes, whether it closes itself; None where the page ends inside."""
    end = _NAME_END.search(page, at)
    if end is None:
        return None
    name, at = _small(page[at : end.start()]), end.start()
    attributes: dict[str, str] = {}
    closed = False
    while at < len(page):
        c = page[at]
        if c == ">":
            return at + 1, name, attributes, closed
        if c in SPACES or c == "/":
            at += 1
            closed = c == "/"  # counts where the tag ends next
            continue
        end = _ATTRIBUTE_END.search(page, at + 1)  # an equals sign may begin a name
        if end is None:
            return None
        key, at = _small(page[at : end.start()]), end.start()
        while at < len(page) and page[at] in SPACES:
            at += 1
        value = ""
        if at < len(page) and page[at] == "=":
            at += 1
            while at < len(page) and page[at] in SPACES:
                at += 1
            if at >= len(page):
                return None
            if page[at] in "\"'":
                close = page.find(page[at], at + 1)
                if close < 0:
                    return None
                value, at = page[at + 1 : close], close + 1
            elif page[at] != ">":
                end = _UNQUOTED_END.search(page, at)
                if end is None:
                    return None
                value, at = page[at : end.start()], end.start()
        attributes.setdefault(key, _attribute_value(value))
        closed = False
    return None


def tokens(page: str) -> Iterator[Token]:
    """The tokens of a page in order; text between two of them is one token."""
    at, size, held = 0, len(page), []

    def text() -> Iterator[Token]:
        if held:
            found = unescape("".join(held))
            held.clear()
            if found:
                yield Token("text", text=found)

    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            held.append(page[at:])
            break
        held.append(page[at:begin])
        after = page[begin + 1 : begin + 2]
        if _LETTER.match(after):
            yield from text()
            found = _tag(page, begin + 1)
            if found is None:
                return  # the page ends inside a tag
            at, name, attributes, closed = found
            yield Token("start", name, attributes=attributes, closed=closed)
            if name == "plaintext":
                if at < size:
                    yield Token("text", text=page[at:])
                return
            if name in RAW or name in REFERENCES_ONLY:
                close = re.compile(rf"</{name}(?=[ \t\n\r\f/>])", re.IGNORECASE | re.ASCII).search(page, at)
                inner = page[at : close.start() if close else size]
                inner = inner if name in RAW else unescape(inner)
                if inner:
                    yield Token("text", text=inner)
                at = close.start() if close else size
        elif after == "/" and _LETTER.match(page, begin + 2):
            yield from text()
            found = _tag(page, begin + 2)
            if found is None:
                return
            at = found[0]
            yield Token("end", found[1])
        elif page.startswith("<!--", begin):
            yield from text()
            if early := re.compile("-?>").match(page, begin + 4):
                yield Token("comment")
                at = early.end()
                continue
            close = _COMMENT_END.search(page, begin + 4)
            yield Token("comment", text=page[begin + 4 : close.start() if close else size])
            at = close.end() if close else size
        elif after in ("!", "?") or after == "/" and begin + 2 < size:
            yield from text()
            close = page.find(">", begin + 1)
            inner, at = page[begin + (1 if after == "?" else 2) : close if close >= 0 else size], close + 1 if close >= 0 else size
            if after == "!" and inner[:7].lower() == "doctype":
                yield Token("doctype", _small(inner[7:].strip().split(" ")[0]))
            elif inner or after != "/":
                yield Token("comment", text=inner)
        else:
            held.append("<")
            at = begin + 1
    yield from text()


def html_tokens(pages: DataFrame, html: str, *keys: str) -> DataFrame:
    """keys, pos, kind, name, text, attributes: the tokens of each page, a row each."""
    ship(pages.sparkSession)
    own = pages.select(*keys, F.col(html).cast("string").alias("_html"))
    more = [StructField("pos", IntegerType()), *(StructField(c, StringType()) for c in ("kind", "name", "text")), StructField("attributes", MapType(StringType(), StringType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page_of: list[int] = []
            rows: list[tuple[int, str, str, str, list[tuple[str, str]]]] = []
            held = 0

            def out(page_of: list[int] = page_of, rows: list = rows, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                given = [c.take(pa.array(page_of, pa.int64())) for c in batch.columns[:-1]]
                kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                return pa.RecordBatch.from_arrays([*given, *made], [*keys, "pos", "kind", "name", "text", "attributes"])

            for k, page in enumerate(batch.columns[-1]):
                for pos, t in enumerate(tokens(page.as_py() or "")):
                    page_of.append(k)
                    rows.append((pos, t.kind, t.name, t.text, list((t.attributes or {}).items())))
                    held += len(t.text) + 64
                    if held > 1 << 23:
                        yield out()
                        held = 0
                        page_of.clear()
                        rows.clear()
            if rows:
                yield out()

    return own.mapInArrow(run, StructType([*own.schema.fields[:-1], *more]))


def content(page: str) -> str:
    """All text of a page, that of scripts and styles too: what an element made of it would give as its text."""
    return "".join(t.text for t in tokens(page) if t.kind == "text")


def visible(page: str) -> str:
    """The text that a reader sees: a line for each block and after each br, spaces run together, empty lines left out."""
    lines, hidden = [[]], ""
    for t in tokens(page):
        if hidden:
            if t.kind == "end" and t.name == hidden:
                hidden = ""
        elif t.kind == "text":
            lines[-1].append(t.text)
        elif t.kind == "start" and t.name in HIDDEN:
            hidden = t.name
        elif t.name in BLOCKS or t.name == "br":
            lines.append([])
    found = (" ".join(x for x in re.split(r"[ \t\n\r\f]+", "".join(parts)) if x) for parts in lines)
    return "\n".join(x for x in found if x)


def _of_pages(pages: Column, read: str) -> Column:
    read_page = {"content": content, "visible": visible}[read]
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def of(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else read_page(x))

    return of(pages)


def text_content(pages: Column) -> Column:
    """``content`` of HTML pages; null stays null."""
    return _of_pages(pages, "content")


def visible_text(pages: Column) -> Column:
    """``visible`` of HTML pages; null stays null."""
    return _of_pages(pages, "visible")
