"""Personal data with offset-preserving deobfuscation.

Base identifiers are found on the text as it is. Then two transducers rewrite
the text while keeping, for every output character, the source span it stands
for: a character transducer (homoglyphs, width forms, other digits, invisible
characters, look-alike letters between digits) and a token transducer (spelled
digits, at/dot disguises). The same detectors run on the output, and what they
find is mapped back to source characters.

Map-only. Texts that the transducers would leave as they are skip them: for runs
of digits this is found by the transducers' own expressions, for at/dot disguises
by a sign that each of them shows, so nothing is lost.

Defined cases: a null text counts as empty; a match that fails its check (IP
parts, Luhn, number of digits) is dropped and the search goes on behind it;
repeated rows give repeated rows; an empty table gives none. Spans are code
points, end exclusive. Added spans may overlap base spans but are never inside
one of the same kind.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.columns import column, map_batches
from sheafline.session import ship

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Each search consumes the whole run of digits that it began in, so that no run is read twice from every start.
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def find_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; each run before an @ is read once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        match = _DOMAIN.match(text, at) if begin < at else None
        last = match.end() if match else max(last, at)
        if match:
            out.append((begin, last))
        at = text.find("@", max(last, at + 1))
    return out


def find_base(text: str) -> list[Span]:
    """The base identifiers, by kind as in KINDS, then by start."""
    out = [("email", a, b) for a, b in find_emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# Characters that look like ASCII letters.
HOMOGLYPHS = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "ѐ": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ԝ": "w", "ʋ": "u",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "η": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
# Characters without width.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufe0e\ufe0f\ufeff"
# Digits spelled in four languages.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_ODD = re.compile("[" + INVISIBLE + "ıɑɡʋͰ-ԯ٠-\u0dff\u2000-\u206f℀-⓿✀-➿﹐-\ufe6f！-～\u00a0\U0001d400-\U0001d7ff]")
_LOOKALIKE_RUN = re.compile(r"(?<![^\W_])\+?[0-9OoIl|][0-9OoIl|().\x20-]{7,}[0-9OoIl|](?![^\W_])")
_DIGIT_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
# A dot between figures in a disguise: in brackets, as a reference, between signs.
_HARD_DOT = r"\s{0,3}(?:[\[({<]\s{0,3}(?:dot|\.|punkt|point|punto)\s{0,3}[\])}>]|&#(?:46|x2e);|&period;|[_-]dot[_-])\s{0,3}"
_SPELLED_RUN = re.compile(
    rf"(?<!\w)(?:(?P<plus>plus|\+)[\s,-]{{0,3}})?(?:double\s+|triple\s+)?(?:{_DIGIT_WORD}|[0-9]+)(?:(?:{_HARD_DOT}|[\s,./-]{{1,3}})(?:{_DIGIT_WORD}|dot|point|punkt|punto|double|triple|[0-9]+))+(?!\w)", re.I
)
_RUN_TOKEN = re.compile(rf"(?P<harddot>{_HARD_DOT})|(?P<word>{_DIGIT_WORD})|(?P<worddot>dot|point|punkt|punto)|(?P<dot>\.)|(?P<times>double|triple)|(?P<digits>[0-9]+)|(?P<plus>plus|\+)|(?P<gap>[\s,/-]+)", re.I)
_DISGUISE_SIGN = re.compile(r"[\[({<]\s*(?:at|@|dot|\.|punkt|point|punto|ät|arroba|arobase)\s*[\])}>]|(?<=\w)\s+(?:dot|punkt|point|punto)\s+(?=\w)|&#(?:64|46|x40|x2e);|&(?:commat|period);|%40|\w(?:\s+@\s*|\s*@\s+)\w|[_-]dot[_-]", re.I)
# Marks inside the rewritten text: an at or a dot that counts only together with another disguise.
_SOFT_AT, _SOFT_DOT = "\ue000", "\ue001"
_DISGUISE = re.compile(
    r"(?P<at>\s*[\[({<]\s*(?:at|@|ät|arroba|arobase)\s*[\])}>]\s*|&#(?:64|x40);|&commat;|%40|(?<=\w)\s+@\s*(?=\w)|(?<=\w)\s*@\s+(?=\w))"
    r"|(?P<dot>\s*[\[({<]\s*(?:dot|\.|punkt|point|punto)\s*[\])}>]\s*|&#(?:46|x2e);|&period;)"
    r"|(?P<softat>(?<=\w)(?:\s+(?:at|ät|arroba|arobase)\s+|[_-]at[_-])(?=\w))|(?P<softdot>(?<=\w)(?:\s+(?:dot|punkt|point|punto)\s+|[_-]dot[_-]|\s+\.\s*|\s*\.\s+)(?=\w))",
    re.I,
)
_DISGUISED_EMAIL = re.compile(
    rf"(?P<local>[A-Za-z0-9_%+-]+(?:[.{_SOFT_DOT}][A-Za-z0-9_%+-]+)*)(?P<at>[@{_SOFT_AT}])(?P<domain>[A-Za-z0-9-]+(?:[.{_SOFT_DOT}][A-Za-z0-9-]+)+)"
)


class Mapped:
    """A text and, for each of its characters, the source span that it stands for."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts: list[int], ends: list[int]):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def plain(cls, text: str) -> Mapped:
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace non-overlapping [start, end) by strings, in order."""
        out, starts, ends, last = [], [], [], 0
        for a, b, new in edits:
            out.append(self.text[last:a])
            starts += self.starts[last:a]
            ends += self.ends[last:a]
            if new and b > a:
                out.append(new)
                starts += [self.starts[a]] * len(new)
                ends += [self.ends[b - 1]] * len(new)
            last = b
        out.append(self.text[last:])
        return Mapped("".join(out), starts + self.starts[last:], ends + self.ends[last:])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def fold_characters(text: Mapped) -> Mapped:
    """The character transducer: homoglyphs, width forms, digits of other scripts, invisible characters."""
    edits = []
    for m in _ODD.finditer(text.text):
        c = m[0]
        if c in INVISIBLE:
            new = ""
        elif c in HOMOGLYPHS:
            new = HOMOGLYPHS[c]
        elif c.isdecimal():
            new = str(unicodedata.decimal(c))
        elif unicodedata.category(c) == "Pd" or c == "−":
            new = "-"
        elif unicodedata.category(c) == "Zs":
            new = " "
        else:
            new = unicodedata.normalize("NFKC", c)
            new = new if new.isascii() else c
        if new != c:
            edits.append((m.start(), m.end(), new))
    return text.rewrite(edits) if edits else text


def _lookalike_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _LOOKALIKE_RUN.finditer(text):
        digits, letters = sum(c.isdigit() for c in m[0]), sum(c in "OoIl|" for c in m[0])
        if letters and digits >= 2 * letters and digits + letters >= 9:
            edits += [(m.start() + k, m.start() + k + 1, "0" if c in "Oo" else "1") for k, c in enumerate(m[0]) if c in "OoIl|"]
    return edits


def fold_lookalikes(text: Mapped) -> Mapped:
    """Letters that stand for 0 or 1 in runs that consist of digits for the most part."""
    edits = _lookalike_edits(text.text)
    return text.rewrite(edits) if edits else text


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED_RUN.finditer(text):
        digits, words, times = [], 0, 1
        for t in _RUN_TOKEN.finditer(m[0]):
            if t["word"]:
                digits.append(SPELLED[t["word"].lower()] * times)
                words, times = words + 1, 1
            elif t["digits"]:
                digits.append(t["digits"] * times)
                times = 1
            elif t["times"]:
                times = 2 if t["times"].lower() == "double" else 3
            elif t["harddot"] or t["worddot"]:
                digits.append(".")
                words += 1  # a disguise as much as a spelled digit
            elif t["dot"]:
                digits.append(".")
            elif t["plus"]:
                digits.append("+")
        new = "".join(digits)
        if words < 2 - (new.count(".") == 3) or len(new) < 4:  # one disguised dot is enough for an address
            continue
        edits.append((m.start(), m.end(), new))
    return edits


def fold_spelled(text: Mapped) -> tuple[Mapped, list[tuple[int, int]]]:
    """Runs of spelled digits as digits; the runs' places in the output."""
    edits, shift, places = _spelled_edits(text.text), 0, []
    for a, b, new in edits:
        places.append((a + shift, a + shift + len(new)))
        shift += len(new) - (b - a)
    return (text.rewrite(edits), places) if edits else (text, [])


def _detect(folded: Mapped, source: str, spelled: list[tuple[int, int]]) -> Iterator[Span]:
    text = folded.text
    for kind, a, b in find_base(text):
        begin, end = folded.source(a, b)
        if source[begin:end] != text[a:b]:
            yield kind, begin, end
    for a, b in spelled:  # a spelled number needs no plus sign to be a phone number
        digits = text[a:b].lstrip("+")
        if digits.isdigit() and 10 <= len(digits) <= 15 and not (len(digits) >= 13 and _luhn(digits)):
            yield "phone", *folded.source(a, b)


def _detect_disguised(folded: Mapped, source: str) -> Iterator[Span]:
    edits = []
    for m in _DISGUISE.finditer(folded.text):
        new = "@" if m["at"] else "." if m["dot"] else _SOFT_AT if m["softat"] else _SOFT_DOT
        edits.append((m.start(), m.end(), new))
    if not edits:
        return
    marked = folded.rewrite(edits)
    for m in _DISGUISED_EMAIL.finditer(marked.text):
        local, at, domain, end = m["local"], m["at"], m["domain"], m.end("domain")
        local_begin = m.start("local")
        # A soft dot in the local part is a full stop of the prose before it as often as not: keep what follows the last.
        if _SOFT_DOT in local and at != _SOFT_AT:
            local_begin += local.rfind(_SOFT_DOT) + 1
        parts = re.split(f"([.{_SOFT_DOT}])", domain)
        spans = [marked.source(m.start("domain") + sum(map(len, parts[:k])), m.start("domain") + sum(map(len, parts[: k + 1]))) for k in range(len(parts))]

        keep, disguised = 1, 0
        for k in range(1, len(parts), 2):
            written = source[spans[k][0] : spans[k][1]]
            if parts[k] != "." and not any(c.isalpha() for c in written):
                break  # a full stop and a space: the next sentence
            keep = k + 2
            disguised += written != "."
        if keep < 3 or not parts[keep - 1].isalpha() or len(parts[keep - 1]) < 2:
            continue
        if at == _SOFT_AT and not disguised:
            continue
        end = m.start("domain") + sum(map(len, parts[:keep]))
        yield "email", *marked.source(local_begin, end)


def find_disguised(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that only the rewritten text shows."""
    odd = not text.isascii() and _ODD.search(text) is not None
    disguise = odd or _DISGUISE_SIGN.search(text) is not None
    if not (disguise or _lookalike_edits(text) or _spelled_edits(text)):
        return []
    folded = fold_characters(Mapped.plain(text))
    folded = fold_lookalikes(folded)
    found: list[Span] = []
    if disguise:
        found += _detect_disguised(folded, text)
    folded, places = fold_spelled(folded)
    found += _detect(folded, text, places)
    out = []
    for kind, a, b in dict.fromkeys(found):
        if not any(k == kind and x <= a and b <= y for k, x, y in base + out):
            out.append((kind, a, b))
    return out


def personal_data(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of one text."""
    text = text or ""
    base = find_base(text)
    return base, find_disguised(text, base)


def _joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: numbers and digest of base spans, and all spans."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in column(batch, "text"):
                base, added = personal_data(text.as_py())
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added)))
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", *names])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SCHEMA, "pii")
