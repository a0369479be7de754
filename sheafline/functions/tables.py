"""Table functions for SQL: numbered replies and notes as rows, by lateral join or over a table.

    SELECT r.conv_id, t.* FROM replies AS r, LATERAL numbered_lines(r.raw, r.expected) AS t
    SELECT * FROM note_items(TABLE(notes) PARTITION BY doc)

``register`` makes them known to a session. They give the rows of ``replies.parse_replies``
and ``store.parse`` (but for ts: what can't be read as a time is null here); a
partition is one note, or its parts in any number of rows, in the order that the call asks for.
Rows stream; one note is in memory at a time.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from sheafline.schema import META_V1, META_V2, META_V3, MISSING
from sheafline.session import ship

# Line ends as the JVM's expressions have them.
_ENDS = "\n\r\u0085\u2028\u2029"
_NUMBERED = re.compile(rf"(?:^|(?<=[{_ENDS}]))[ \t\n\x0b\f\r]*([0-9]+)\.[ \t\n\x0b\f\r]+([^{_ENDS}]+?)(?:\n|(?=[{_ENDS}])|\Z)")
_NUMBER = re.compile(r"^[ \t\n\x0b\f\r]*[0-9]+\.[ \t\n\x0b\f\r]*")
_SPACE = " \t\n\x0b\f\r\u00a0"


def numbered(raw: str, expected: int) -> list[str]:
    """The expected lines of a numbered reply, as ``replies.parse_numbered`` has them."""
    pairs = [(int(n), t) for n, t in _NUMBERED.findall(raw) if len(n) <= 9 and 1 <= int(n) <= expected]
    found: list[str | None] = [None] * max(expected, 0)
    for n, t in pairs:
        found[n - 1] = t.strip(_SPACE)
    if len(pairs) < expected * 0.5:
        plain = [_NUMBER.sub("", x.strip(_SPACE)) for x in raw.strip(_SPACE).split("\n")]
        found = plain if len(plain) == expected else [plain[k] if k < len(plain) else x for k, x in enumerate(found)]
    return [MISSING if x is None else x for x in found]


@udtf(returnType="ord: int, line: string")
class NumberedLines:
    def eval(self, raw: str, expected: int) -> Iterator[tuple[int, str]]:
        if raw is not None and expected is not None:
            yield from enumerate(numbered(raw, expected))


NOTE_ITEMS = "doc: string, page_key: string, ord: int, page: int, text_content: string, translated_text: string, rel_left: double, rel_top: double, rel_width: double, rel_height: double, font_size: double, font_family: string, original_font_sizes: array<double>"
_HEADING = re.compile(r"^##[ \t\n\x0b\f\r]+page[ \t\n\x0b\f\r]+([0-9]+)", re.I | re.A)
_CELL = re.compile(r"(?<!\\)\|")


def _front(content: str, key: str) -> str | None:
    block = re.search(r"^---\n(.*?)\n---", content, re.S)
    value = re.search(rf"^{key}:[ \t]*(.*)$", block[1], re.M) if block else None
    return (value[1] or None) if value else None


def _metadata(text: str | None) -> dict | None:
    """What an item's metadata says, if its box and page are whole."""
    try:
        found = json.loads(text or "")
    except ValueError:
        return None
    box = found.get("r") if isinstance(found, dict) else None
    values = [box.get(c) for c in "ltwh"] if isinstance(box, dict) else [None]
    if not all(isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v) for v in [*values, found.get("page")]):
        return None
    return found if values[2] > 0 and values[3] > 0 else None


def _number(x: object) -> float | None:
    return float(x) if isinstance(x, int | float) and not isinstance(x, bool) else None


def items(content: str) -> Iterator[tuple]:
    """page_key, page, text, translation, box, size, family, sizes of the items of a note in any of the three formats."""
    found = _front(content, "format-version") or _front(content, "version") or "1"
    version = int(found) if re.fullmatch(r"\s*[+-]?[0-9]{1,9}\s*", found) else 1
    body = re.sub(r"^---\n.*?\n---\n?", "", content, count=1, flags=re.S)
    lines = [x for x in (line.strip(_SPACE) for line in body.split("\n")) if x]
    key, rows = None, []
    for k, line in enumerate(lines):
        if heading := _HEADING.match(line):
            key = heading[1]
            if version < 3:
                rows = [r for r in rows if r[0] != key]  # a repeated heading begins anew
        elif key is None:
            continue
        elif version >= 3:
            meta = re.search(META_V3, line)
            m = _metadata(meta[1]) if meta else None
            if m:
                after = lines[k + 1] if k + 1 < len(lines) else ""
                special = bool(_HEADING.match(after) or re.search(META_V3, after))
                rows.append((key, m, str(m.get("ot") or ""), "" if special else after.replace("<br>", "\n"), m.get("fs"), m.get("ff"), m.get("ofs")))
        else:
            cells = [x.replace("\\|", "|").strip(_SPACE) for x in _CELL.split(re.sub(r"^\||\|$", "", line))]
            if len(cells) == 2:
                coded, plain = re.search(META_V2, cells[0]), re.search(META_V1, cells[0])
                try:
                    text = base64.b64decode(coded[1], validate=True).decode() if coded and coded[1] else plain[1] if plain else None
                except (binascii.Error, UnicodeDecodeError):
                    text = None
                m = _metadata(text)
                if m:
                    rows.append((key, m, re.sub(META_V1, "", re.sub(META_V2, "", cells[0])).strip(_SPACE), cells[1].replace("\\n", "\n"), m.get("fontSize"), m.get("fontFamily"), m.get("originalFontSizes")))
    at: dict[str, int] = {}
    for key, m, text, translated, size, family, sizes in rows:
        number = at[key] = at.get(key, -1) + 1
        box = m["r"]
        yield key, number, int(m["page"]), text, translated, *(float(box[c]) for c in "ltwh"), _number(size), family if isinstance(family, str) else None, [_number(x) for x in sizes] if isinstance(sizes, list) else None


@udtf(returnType=NOTE_ITEMS)
class NoteItems:
    """Over a table of doc and content, partitioned by doc: a note's rows are put together as they come."""

    def __init__(self) -> None:
        self.doc: str | None = None
        self.parts: list[str] = []

    def eval(self, row: Row) -> None:
        self.doc = row["doc"]
        if row["content"] is not None:
            self.parts.append(row["content"])

    def terminate(self) -> Iterator[tuple]:
        for found in items("\n".join(self.parts)):
            yield (self.doc, *found)


def register(spark: SparkSession) -> None:
    """Make numbered_lines and note_items callable from SQL."""
    ship(spark)
    spark.udtf.register("numbered_lines", NumberedLines)
    spark.udtf.register("note_items", NoteItems)
