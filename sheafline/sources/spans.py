"""Spans: positioned pieces of text, read from a table or derived from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions import text as T


#: Characters of text in a task that makes spans; with the columns and numbers of its spans some 20 times as many bytes.
TASK_CHARS = 4_000_000


def tasks_for(documents: DataFrame) -> int:
    """How many tasks of ``TASK_CHARS`` the texts fill, at least one a core. Files don't tell: copies of a text are stored once."""
    chars = documents.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    return max(documents.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))


def spans_of(documents: DataFrame, clustered: bool = True, tasks: int | None = None) -> DataFrame:
    """A deterministic page layout of plain documents.

    Runs of eight words of each line become spans of 40 rows a column, one or two
    columns a page. A span's number is its place in the document's own array, so
    no shuffle is needed to count it. ``clustered`` deals the documents by id
    first: windows and aggregates by page then need no exchange of the spans, which
    are several times as wide as the texts. With a number of ``tasks`` (``tasks_for``) a task's
    rows don't grow with the input, whatever the session's number of shuffle partitions.
    """
    source = documents.select("doc_id", "lang", "text")
    if clustered:
        source = source.repartition(tasks, "doc_id") if tasks else source.repartition("doc_id")

    # Here, where a text is made once, not as a column that each condition on it would make anew.
    def one_spaced(x: Column) -> Column:
        return F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " +", " ")).otherwise(x)

    def runs(line: Column, number: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit("([^ ]+(?: +[^ ]+){0,7})"), F.lit(1))
        return F.transform(found, lambda x, c: F.struct(number.alias("ln"), c.alias("c"), one_spaced(x).alias("text")))

    # The place on its page is a field too: a filter on what follows from it would write it out again and again, in more code than the JVM compiles.
    per_page = 40 * (1 + F.pmod("doc_id", F.lit(2)))
    placed = F.transform(F.flatten(F.transform(F.split("text", "\n"), runs)), lambda x, k: F.struct((F.floor(k / per_page) + 1).cast("int").alias("page"), (k % per_page).cast("int").alias("slot"), x["ln"].alias("ln"), x["c"].alias("c"), x["text"].alias("text")))
    rows = source.select("doc_id", "lang", F.posexplode(placed).alias("k", "run"))
    slot = F.col("run.slot")
    row = slot % 40
    indent = F.when(F.col("run.c") == 0, 25).otherwise(0)
    left = 50.0 + 290.0 * F.floor(slot / 40) + indent
    top = 60.0 + 16.0 * row + F.when(row >= 20, 24.0).otherwise(0.0)
    width = F.least(255.0 - indent, 5.0 * F.length("run.text"))
    height = F.when(F.col("run.ln") == 0, 15.0).otherwise(11.0)
    return rows.select(
        "doc_id",
        "lang",
        F.col("run.page").alias("page"),
        F.col("k").cast("long").alias("span_id"),
        F.col("run.text").alias("text"),
        left.cast("double").alias("left"),
        top.cast("double").alias("top"),
        width.cast("double").alias("width"),
        height.alias("height"),
        (left + width).cast("double").alias("right"),
        (top + height).cast("double").alias("bottom"),
        F.when(F.col("run.ln") == 0, 14.0).otherwise(10.0).alias("font_size"),
        F.when(F.col("run.ln") == 0, 700).otherwise(400).alias("font_weight"),
        F.when((F.col("doc_id") + F.col("run.ln")) % 7 == 0, "italic").otherwise("normal").alias("font_style"),
        F.when(F.col("doc_id") % 5 == 0, "Mono").otherwise("Serif").alias("font_family"),
        F.lit("rgb(0, 0, 0)").alias("color"),
    )


def snapshot(spans: DataFrame, pixel_ratio: float = 1.0) -> DataFrame:
    """Typed columns of style and formula content; geometry divided by the pixel ratio."""
    scaled = {c: F.col(c) / pixel_ratio for c in ("left", "top", "right", "bottom", "width", "height", "font_size") if c in spans.columns}
    return spans.withColumns(scaled).withColumns(
        {
            "rgb": T.rgb(F.col("color")),
            "weight": T.weights(spans),
            "is_math": T.is_math(F.col("text"), F.col("font_family")),
            "math_context": T.math_context(F.col("text"), F.col("font_family")),
            "style_sig": T.style_signature(F.col("font_family"), F.col("font_size"), F.col("font_weight"), F.col("font_style"), F.col("color")),
        }
    )


def whole_spans(spans: DataFrame) -> DataFrame:
    """Spans that belong to a page and have a place on it: ids are known, numbers finite."""
    ok = F.col("doc_id").isNotNull() & F.col("page").isNotNull() & F.col("span_id").isNotNull()
    for c in ("left", "top", "width", "height"):
        ok &= F.abs(F.col(c)) < float("inf")  # NaN is more than that, null is neither
    return spans.filter(ok)


def is_valid(text: Column, width: Column, height: Column) -> Column:
    """Larger than a dot, and not empty, a page number, a lone bullet or a link.

    Only texts that begin as one of these do are looked at closely.
    """
    text = F.coalesce(text, F.lit(""))
    t = T.trim(text)
    close = (F.length(t) > 0) & ~t.rlike(r"^[0-9]{1,3}$") & ~t.rlike(r"^[•\-»«]$") & ~t.startswith("http")
    return (width > 1) & (height > 1) & F.when(text.rlike(r"^[\s\x{00A0}]*[^\s\x{00A0}0-9•\-»«h]"), True).otherwise(close)


def valid_spans(spans: DataFrame) -> DataFrame:
    """Whole spans with something to translate."""
    return whole_spans(spans).filter(is_valid(F.col("text"), F.col("width"), F.col("height")))


def page_count(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.greatest(F.countDistinct("page"), F.lit(1)).alias("pages"))
