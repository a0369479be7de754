"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType

from sheafline.schema import LANGUAGES, MATH_CHAR, MATH_FONT, OPERATOR_CHAR


def trim(text: Column) -> Column:
    """Without white space at both ends, no-break spaces included."""
    return F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")


def rgb(color: Column) -> Column:
    """[r, g, b] of rgb(), rgba(), #rgb and #rrggbb; black otherwise."""
    pattern = r"(?i)rgba?\(\s*(\d+)[,\s]+(\d+)[,\s]+(\d+)"
    hexa = F.lower(F.trim(color))
    short, long = hexa.rlike("^#[0-9a-f]{3}$"), hexa.rlike("^#[0-9a-f]{6}$")

    def number(text: Column) -> Column:
        return F.conv(text, 16, 10).cast("int")

    return (
        F.when(color.rlike(pattern), F.array(*[F.regexp_extract(color, pattern, k).cast("int") for k in (1, 2, 3)]))
        .when(short, F.array(*[number(F.repeat(F.substring(hexa, k, 1), 2)) for k in (2, 3, 4)]))
        .when(long, F.array(*[number(F.substring(hexa, k, 2)) for k in (2, 4, 6)]))
        .otherwise(F.array(F.lit(0), F.lit(0), F.lit(0)))
    )


def weight(text: Column) -> Column:
    """A font weight as a number: its leading integer, 700 for bold, else 400."""
    number = F.regexp_extract(text, r"^\s*(-?\d+)", 1)
    return F.when(F.length(number) > 0, number.cast("int")).when(F.lower(text) == "bold", 700).otherwise(400)


def weights(spans: DataFrame, name: str = "font_weight") -> Column:
    """The font weights of a table as numbers; those that are numbers need no reading."""
    number = F.col(name)
    return F.coalesce(number.cast("int"), F.lit(400)) if isinstance(spans.schema[name].dataType, (ByteType, ShortType, IntegerType)) else weight(number.cast("string"))


def _either(text: Column, near: str, whole: str) -> Column:
    """Does ``whole`` (signs of Latin-1, all of them in ``near``, and others from U+0370 on) match.

    Java goes through a long class for each letter, so it is looked for only in texts with a letter from U+0370 on, and there only at such letters.
    """
    far = r"[^\x{0000}-\x{036F}]"
    return text.rlike(f"[{near}]") | ((F.octet_length(text) > F.length(text)) & text.rlike(far) & text.rlike(f"(?={far})(?:{whole})"))


def is_math(text: Column, family: Column) -> Column:
    return (F.length(F.coalesce(text, F.lit(""))) > 0) & (F.coalesce(family, F.lit("")).rlike(MATH_FONT) | _either(text, r"=+\-%±×÷", MATH_CHAR))


def has_operator(text: Column) -> Column:
    return _either(F.coalesce(text, F.lit("")), r"=+\-±×÷", "[" + OPERATOR_CHAR.replace("-", r"\-") + "]")


def math_context(text: Column, family: Column) -> Column:
    return F.when(is_math(text, family), F.when(text.contains("=") | text.contains("∑"), "equation").otherwise("inline")).otherwise("none")


def style_signature(family: Column, size: Column, weight_: Column, style: Column, color: Column) -> Column:
    half = F.floor(size * 2 + 0.5) / 2
    return F.concat_ws("|", family, F.format_string("%.1f", half), weight_.cast("string"), style, F.concat_ws(",", F.transform(rgb(color), lambda x: x.cast("string"))))


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def plain_text(html: Column) -> Column:
    """Text of the small HTML dialect: comments and tags go, the five entities come back."""
    text = F.regexp_replace(F.regexp_replace(html, "(?s)<!--.*?-->", ""), "<[^>]*>", "")
    for entity, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def tagged(text: Column, weight_: Column, style: Column) -> Column:
    """Escaped text inside <b> from weight 700 on, that inside <i> if italic."""
    content = escape_html(text)
    content = F.when(weight_ >= 700, F.concat(F.lit("<b>"), content, F.lit("</b>"))).otherwise(content)
    return F.when(style == "italic", F.concat(F.lit("<i>"), content, F.lit("</i>"))).otherwise(content)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace {name} by values, one name after the other, literally."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def blockquote(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")


def escape_json(text: Column) -> Column:
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def json_path(document: Column, path: str) -> Column:
    """The value at a dotted and indexed path of a JSON text."""
    return F.get_json_object(document, "$." + path)


def language_name(code: Column) -> Column:
    """The name of a language code; other codes pass through."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), code)


def to_breaks(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("<br>"))


def from_breaks(text: Column) -> Column:
    return F.replace(text, F.lit("<br>"), F.lit("\n"))


def decode_metadata(encoded: Column) -> Column:
    return F.decode(F.unbase64(encoded), "UTF-8")


def clean_link(text: Column) -> Column:
    """The path of [[path|alias]], quoted or not."""
    bare = F.regexp_replace(F.trim(text), r"^['\"]?(?:\[\[)?|(?:\]\])?['\"]?$", "")
    return F.trim(F.split(bare, r"\|")[0])


def storage_path(folder: Column) -> Column:
    """A folder with one slash at its end and none doubled or leading; the root is empty."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(folder), "/+", "/"), "^/|/$", "")
    return F.when(inner.isin("", ".", ".."), "").otherwise(F.concat(inner, F.lit("/")))


def strip_pdf(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.pdf$", "")


def note_path(folder: Column, pdf_path: Column, suffix: str = ".translations.md") -> Column:
    base = strip_pdf(F.element_at(F.split(pdf_path, "/"), -1))
    return F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), base, F.lit(suffix))


def truncate(text: Column, most: int = 3000) -> Column:
    return F.substring(text, 1, most)


def ends_sentence(text: Column) -> Column:
    return trim(text).rlike(r"[.?!]\s*$")


def ends_sentence_html(text: Column) -> Column:
    done = trim(text)
    return done.endswith("<br>") | done.rlike(r"[.?!](?:\s*</[bi]>)*\s*$")


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_time(text: Column, otherwise: Column) -> Column:
    """A timestamp; what can't be read takes the clock that is given."""
    return F.coalesce(F.try_to_timestamp(text), otherwise)
