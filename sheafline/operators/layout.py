"""Layout analysis of pages: paragraphs, columns, gaps and strips.

Everything is partitioned by (doc_id, page), so windows and aggregates of a plan
share an exchange. What needs order-dependent folds runs in an Arrow function right
after a window over pages: the window has put each page's rows into one partition,
one page after the other, so neither an exchange nor a call per page is needed.
Pages are small; the number of pages is what grows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sheafline.functions import geometry as G
from sheafline.functions import text as T
from sheafline.operators import paging
from sheafline.schema import DEFAULT_FAMILY, GapSettings, LayoutSettings, Page, SegmentSettings
from sheafline.session import ship

KEYS = ("doc_id", "page")


def _page_window(*order: str) -> W:
    return W.partitionBy(*KEYS).orderBy(*order)


def initial_paragraphs(spans: DataFrame, s: LayoutSettings | None = None) -> DataFrame:
    """Adds para_id (from 0 by page): each span joins the one before it in reading order or begins a paragraph."""
    s = s or LayoutSettings()
    w = _page_window("top", "left", "span_id")

    def before(c: str) -> Column:
        return F.lag(c).over(w)

    # Made before the window, which then carries a flag in place of the text, and a colour in place of its numbers.
    hyphenated = F.coalesce("text", F.lit("")).rlike(r"[\x{00AD}-][\s\x{00A0}]*$")
    named = spans.withColumns({"_weight": T.weights(spans), "_math": T.is_math(F.col("text"), F.col("font_family")), "_hyphen": hyphenated})
    prev = {c: before(c) for c in ("left", "top", "right", "bottom", "font_size", "font_family", "font_style", "color", "_weight", "_math", "_hyphen")}
    named = named.withColumns({f"p_{c}": v for c, v in prev.items()})
    smaller, larger = F.least("font_size", "p_font_size"), F.greatest("font_size", "p_font_size")
    math = F.col("_math") | F.col("p__math")
    same_line = F.abs(F.col("bottom") - F.col("p_bottom")) < smaller * F.when(math, s.baseline_math).otherwise(s.baseline)
    dx = F.col("left") - F.col("p_right")
    kerning = same_line & (dx >= 0) & (dx < smaller * F.when(math, s.kerning_math).otherwise(s.kerning))
    hyphen = F.col("p__hyphen") & (F.col("top") > F.col("p_top")) & (F.abs(F.col("left") - F.col("p_left")) < F.col("font_size") * s.hyphen)
    reach = smaller * F.when(math, s.align_math).otherwise(s.align)
    aligned = (F.abs(F.col("left") - F.col("p_left")) < reach) | (F.abs(F.col("right") - F.col("p_right")) < reach)
    near = (F.col("top") - F.col("p_bottom")) <= F.least(larger * s.line_height * s.first_gap_lines, larger * s.first_gap_max)
    a, b = ({"family": F.col(f"{p}font_family"), "size": F.col(f"{p}font_size"), "weight": F.col(f"{p}_weight"), "style": F.col(f"{p}font_style"), "color": F.col(f"{p}color")} for p in ("", "p_"))
    joins = F.col("p_top").isNotNull() & G.styles_match(a, b, s) & ((near & aligned) | kerning | hyphen)
    breaks = named.withColumn("_break", F.when(joins, 0).otherwise(1))
    return breaks.withColumn("para_id", (F.sum("_break").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("int")).select(*spans.columns, "para_id")


def paragraph_boxes(paragraphs: DataFrame) -> DataFrame:
    """Box of each paragraph, and the sizes and the family of its spans as ``span_set`` has them."""
    return span_set(paragraphs, *KEYS, "para_id")


def span_set(spans: DataFrame, *keys: str, page: Page | None = None) -> DataFrame:
    """By ``keys``: number of spans, box from the page's corner, font sizes in reading order, their mean, family.

    A size that is 0 or unknown counts as 12. The family is the first name of the
    first list of names that does not begin with the default one.
    """
    page = page or Page()
    size = F.when(F.col("font_size") != 0, F.col("font_size")).otherwise(12.0)
    name = F.trim(F.regexp_replace(F.element_at(F.split("font_family", ","), 1), "['\"]", ""))
    ordered = F.array_sort(F.collect_list(F.struct("top", "left", "span_id", size.alias("size"))))
    found = spans.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_spans"), (F.min("left") - page.left).alias("left"), (F.min("top") - page.top).alias("top"), (F.max("right") - page.left).alias("right"), (F.max("bottom") - page.top).alias("bottom"), F.avg(size).alias("avg_font_size"),
        F.coalesce(F.min_by(name, F.when((F.length("font_family") > 0) & (name != DEFAULT_FAMILY), F.struct("top", "left", "span_id"))), F.lit(DEFAULT_FAMILY)).alias("font_family"), ordered.alias("items"),
    )
    return found.withColumn("font_sizes", F.transform("items", lambda x: x["size"])).drop("items")


def text_line_height(spans: DataFrame, s: GapSettings | None = None) -> DataFrame:
    """Median height of the spans over 3 high by page, a default where there is none."""
    s = s or GapSettings()
    return spans.groupBy(*KEYS).agg(F.coalesce(F.percentile(F.when(F.col("height") > 3, F.col("height")), F.lit(0.5)), F.lit(s.default_line)).alias("line"))


def line_height(paragraphs: DataFrame, page: Page, s: LayoutSettings | None = None) -> DataFrame:
    """Line height by page: a trimmed mean of the gaps inside paragraphs, if there are enough, not under a share of the median font; 16 where no span has a font size."""
    s = s or LayoutSettings()
    w = W.partitionBy(*KEYS, "para_id").orderBy("top", "left", "span_id")
    gap = F.col("top") - F.lag("bottom").over(w)
    gaps = paragraphs.withColumn("gap", gap).withColumn("gap", F.when((F.col("gap") > 0) & (F.col("gap") < s.max_gap_of_page * (page.bottom - page.top)), F.col("gap")))
    ordered = _page_window("gap_null", "gap", "span_id")
    ranked = gaps.withColumn("gap_null", F.col("gap").isNull()).withColumn("rank", F.row_number().over(ordered) - 1).withColumn("n", F.count("gap").over(W.partitionBy(*KEYS)))
    cut = F.floor(F.col("n") * s.trim)
    kept = (F.col("n") >= s.min_gaps_for_trim) & (F.col("rank") >= cut) & (F.col("rank") < F.col("n") - cut) & F.col("gap").isNotNull()
    found = ranked.groupBy(*KEYS).agg(F.coalesce(F.avg(F.when(kept, F.col("gap"))), F.lit(0.0)).alias("mean_gap"), F.percentile(F.when(F.col("font_size") > 0, F.col("font_size")), F.lit(0.5)).alias("font"))
    return found.select(*KEYS, F.when(F.col("font").isNull(), 16.0).otherwise(F.greatest(F.col("mean_gap") * s.line_from_gaps, F.col("font") * s.line_height * s.line_floor)).alias("line_height"))


def column_chains(paragraphs: DataFrame, s: LayoutSettings | None = None) -> DataFrame:
    """Columns by page: paragraph boxes in order of left edge, cut where it jumps; box, edge flag and gap centre to the next."""
    s = s or LayoutSettings()
    boxes = paragraphs.groupBy(*KEYS, "para_id").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.sum(F.col("bottom") - F.col("top")).alias("h"), F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(*KEYS)
    mean = F.sum("h").over(whole) / F.sum("n").over(whole)
    limit = F.when(mean > 0, mean * s.column_lines).otherwise(s.column_fallback)
    w = whole.orderBy("left", "para_id")
    jump = F.when(F.abs(F.col("left") - F.lag("left").over(w)) >= F.col("limit"), 1).otherwise(0)
    chained = boxes.withColumn("limit", limit).withColumn("jump", jump).withColumn("col_id", F.sum("jump").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    columns = chained.groupBy(*KEYS, "col_id").agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.count(F.lit(1)).alias("n_paragraphs"))
    by = whole.orderBy("col_id")
    return columns.withColumns(
        {"is_edge": (F.col("col_id") == 0) | F.lead("col_id").over(by).isNull(), "gap_x": (F.col("right") + F.lead("left").over(by)) / 2}
    )


# --- gaps -----------------------------------------------------------------------------------


def _banded(spans: DataFrame, page: Page, s: GapSettings, empty: bool) -> DataFrame:
    """Spans by the bands (a fraction of the page's text line high) that they overlap, and, if ``empty``, every band once without a span.

    One pass: the line is a window over the page, bands are exploded by number and
    then tested, so that neither a second scan nor a nested loop is needed.
    """
    w = W.partitionBy(*KEYS)
    line = F.coalesce(F.percentile(F.when(F.col("height") > 3, F.col("height")), F.lit(0.5)).over(w), F.lit(s.default_line))
    placed = spans.select(*KEYS, "left", "top", "right", "bottom", line.alias("line"), (F.row_number().over(w.orderBy("span_id")) == 1).alias("head"))
    placed = placed.withColumn("step", F.greatest(F.lit(s.band_floor), F.col("line") * s.band_lines))
    final = F.ceil((page.bottom - page.top) / F.col("step")).cast("int") - 1
    first = F.greatest(F.floor((F.col("top") - page.top) / F.col("step")) - 1, F.lit(0)).cast("int")
    last = F.least(F.floor((F.col("bottom") - page.top) / F.col("step")) + 1, final).cast("int")

    def touched(band: Column) -> Column:
        y1 = page.top + band * F.col("step")
        return (F.col("bottom") > y1) & (F.col("top") < F.least(F.lit(page.bottom), y1 + F.col("step")))

    none = F.array().cast("array<int>")
    own = F.filter(F.when(last >= first, F.sequence(first, last)).otherwise(none), touched)
    bands = F.transform(own, lambda x: F.struct(x.alias("band"), F.lit(True).alias("own")))
    if empty:
        every = F.transform(F.when(F.col("head"), F.sequence(F.lit(0), final)).otherwise(none), lambda x: F.struct(x.alias("band"), F.lit(False).alias("own")))
        bands = F.concat(bands, every)
    return placed.select(*KEYS, "left", "right", F.explode(bands).alias("b")).select(*KEYS, F.col("b.band").alias("band"), F.col("b.own").alias("own"), "left", "right")


def band_rects(spans: DataFrame, page: Page, s: GapSettings | None = None) -> DataFrame:
    """x-intervals of the spans in each band that they overlap."""
    return _banded(spans, page, s or GapSettings(), False).select(*KEYS, "band", "left", "right").distinct()


def occupied(rects: DataFrame) -> DataFrame:
    """Merged x-intervals of each band: a new one begins beyond the largest right edge so far."""
    w = W.partitionBy(*KEYS, "band").orderBy("left", "right")
    reach = F.max("right").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = rects.withColumn("new", F.when(reach.isNull() | (F.col("left") > reach), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    return islands.groupBy(*KEYS, "band", "island").agg(F.min("left").alias("left"), F.max("right").alias("right"))


def band_gaps(spans: DataFrame, page: Page, s: GapSettings | None = None) -> DataFrame:
    """Empty x-intervals of each band, page margins included; a band without spans is one gap."""
    s = s or GapSettings()
    rects = F.array_sort(F.collect_set(F.when(F.col("own"), F.struct("left", "right"))))
    found = _banded(spans, page, s, True).groupBy(*KEYS, "band").agg(rects.alias("rects"))
    gap = "array<struct<left:double,right:double>>"

    def step(acc: Column, x: Column) -> Column:
        wide = x["left"] - acc["cursor"] >= s.min_gap
        here = F.array(F.struct(acc["cursor"].alias("left"), x["left"].alias("right")))
        return F.struct(F.greatest(acc["cursor"], x["right"]).alias("cursor"), F.when(wide, F.concat(acc["gaps"], here)).otherwise(acc["gaps"]).alias("gaps"))

    end = F.struct(F.lit(page.right).alias("left"), F.lit(page.right).alias("right"))
    start = F.struct(F.lit(page.left).alias("cursor"), F.array().cast(gap).alias("gaps"))
    gaps = F.aggregate(F.concat("rects", F.array(end)), start, step, lambda acc: acc["gaps"])
    return found.select(*KEYS, "band", F.explode(gaps).alias("g")).select(*KEYS, "band", F.col("g.left").alias("left"), F.col("g.right").alias("right"))


def strips_for_columns(strips: DataFrame, s: LayoutSettings | None = None) -> DataFrame:
    """Strips that count for columns and bands."""
    s = s or LayoutSettings()
    return strips.filter((F.col("confidence") >= s.min_strip_confidence) & (F.col("right") - F.col("left") >= s.min_strip_width))


def strips_for_splits(strips: DataFrame, s: LayoutSettings | None = None) -> DataFrame:
    """Strips that count where paragraphs are split and columns compared."""
    s = s or LayoutSettings()
    return strips.filter((F.col("right") - F.col("left") >= s.split_strip_width) & (F.col("confidence") >= s.split_strip_confidence) & (F.col("bottom") - F.col("top") >= 12))


def merge_bands(bands: DataFrame, line: Column | float, s: LayoutSettings | None = None) -> DataFrame:
    """Horizontal bands (y, height, confidence) that follow closely become one with the best confidence."""
    s = s or LayoutSettings()
    line = F.lit(line) if not isinstance(line, Column) else line
    w = _page_window("y", "height", "confidence")
    reach = F.max(F.col("y") + F.col("height")).over(w.rowsBetween(W.unboundedPreceding, -1))
    gap = F.greatest(F.lit(s.band_gap), line * s.band_gap_lines)
    marked = bands.distinct().withColumn("new", F.when(reach.isNull() | (F.col("y") > reach + gap), 1).otherwise(0))
    islands = marked.withColumn("band_id", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    merged = islands.groupBy(*KEYS, "band_id").agg(F.min("y").alias("y"), F.max(F.col("y") + F.col("height")).alias("end"), F.max("confidence").alias("confidence"))
    return merged.select(*KEYS, "band_id", "y", (F.col("end") - F.col("y")).alias("height"), "confidence")


def inferred_bands(pages: DataFrame, page: Page, s: LayoutSettings | None = None) -> DataFrame:
    """Bands above and below the reach of a page's strips, where there is room; ``pages`` is one row per page, with line_height and strips."""
    s = s or LayoutSettings()
    room = F.col("line_height") * s.band_edge_lines
    top, bottom = F.array_min(F.transform("strips", lambda x: x["top"])), F.array_max(F.transform("strips", lambda x: x["bottom"]))
    above = F.when(top > page.top + room, F.struct(F.lit(page.top).alias("y"), (top - page.top).alias("height")))
    below = F.when(bottom < page.bottom - room, F.struct(bottom.alias("y"), (page.bottom - bottom).alias("height")))
    return pages.select(*KEYS, "line_height", F.inline(F.array_compact(F.array(above, below)))).withColumn("confidence", F.lit(s.inferred_band_confidence))


def columns_of_boundaries(boundaries: DataFrame, page: Page, s: GapSettings | None = None) -> DataFrame:
    """Column intervals between boundaries x that increase strictly inside the page; the first few by page."""
    s = s or GapSettings()
    inside = boundaries.filter((F.col("x") > page.left) & (F.col("x") < page.right)).select(*KEYS, "x").distinct()
    edges = inside.unionByName(boundaries.select(*KEYS).distinct().withColumn("x", F.lit(page.right)))
    w = _page_window("x")
    return edges.select(*KEYS, F.row_number().over(w).alias("col"), F.coalesce(F.lag("x").over(w), F.lit(page.left)).alias("left"), F.col("x").alias("right")).filter(F.col("col") <= s.max_columns)


def sure_bands(bands: DataFrame, s: LayoutSettings | None = None) -> DataFrame:
    """Given bands that are confident enough to count."""
    return bands.filter(F.col("confidence") >= (s or LayoutSettings()).min_band_confidence)


def horizontal_gutters(spans: DataFrame, line: Column, least_lines: float = 1.5, s: LayoutSettings | None = None) -> DataFrame:
    """Thin bands in the middle of each stretch without text between texts, from the y-projection of a page's spans.

    ``line`` is the page's line height, a column of ``spans``. Not part of ``page_layout``
    unless it is asked for ``gutters``.
    """
    s = s or LayoutSettings()
    w = _page_window("top", "bottom", "span_id")
    reach = F.max("bottom").over(w.rowsBetween(W.unboundedPreceding, -1))
    found = spans.select(*KEYS, "top", reach.alias("reach"), (line * (s.band_gap_lines or 1)).alias("height"), line.alias("line")).filter(F.col("top") - F.col("reach") >= F.col("line") * least_lines)
    return found.select(*KEYS, ((F.col("reach") + F.col("top")) / 2 - F.col("height") / 2).alias("y"), "height", F.lit(0.95).alias("confidence"))


# --- pages as a whole -----------------------------------------------------------------------


def by_page(placed: DataFrame, run: Callable[[paging.Pages], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Map whole pages, several at a time. ``placed`` comes out of a window over pages, in its order."""
    ship(placed.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in paging.whole_pages(batches, KEYS):
            yield from run(pages)

    return placed.mapInArrow(task, schema)


def begun(spans: DataFrame, s: LayoutSettings, carried: dict[str, Column] | None = None) -> DataFrame:
    """First paragraphs with what the page algorithms read, and what else is ``carried``, page by page, in reading order."""
    rgb = T.rgb(F.col("color"))
    extra = {"own_rgb": rgb[0] * 65536 + rgb[1] * 256 + rgb[2], "own_math": T.is_math(F.col("text"), F.col("font_family")), "own_operator": T.has_operator(F.col("text")), "own_weight": T.weights(spans)}
    # What the page algorithms read is made before the window, which then carries no text; what is carried after it, as one
    # piece of code for all of it would be more than the JVM compiles.
    found = initial_paragraphs(spans.withColumns(extra), s)
    return found.select(*KEYS, "span_id", "para_id", "left", "top", "right", "bottom", "height", "font_size", F.coalesce("font_family", F.lit("")).alias("font_family"), F.coalesce("font_style", F.lit("")).alias("font_style"), F.col("own_weight").alias("weight"), F.col("own_rgb").alias("rgb"), F.col("own_math").alias("is_math"), F.col("own_operator").alias("is_operator"), *[v.alias(k) for k, v in (carried or {}).items()])


def page_profiles(spans: DataFrame, page: Page, s: LayoutSettings | None = None, gaps: GapSettings | None = None, gutters: float = 0.0) -> DataFrame:
    """One row per page: text line, line height, strips for columns (left, right, top, bottom, confidence), bands (y, height, confidence)."""
    s, gaps = s or LayoutSettings(), gaps or GapSettings()

    def run(pages: paging.Pages) -> Iterator[pa.RecordBatch]:
        found = [x for x, _, _ in paging.profiles(pages, page, s, gaps, gutters)]
        strips = [[dict(zip(("left", "right", "top", "bottom", "confidence"), x, strict=True)) for x in f.strips] for f in found]
        bands = [[dict(zip(("y", "height", "confidence"), x, strict=True)) for x in f.bands] for f in found]
        strip, band = (pa.list_(pa.struct([(n, pa.float64()) for n in names])) for names in (("left", "right", "top", "bottom", "confidence"), ("y", "height", "confidence")))
        yield pa.RecordBatch.from_arrays([pages.first("doc_id"), pages.first("page"), pa.array([f.text_line for f in found]), pa.array([f.line for f in found]), pa.array(strips, strip), pa.array(bands, band)], ["doc_id", "page", "text_line", "line_height", "strips", "bands"])

    fields = ("struct<left:double,right:double,top:double,bottom:double,confidence:double>", "struct<y:double,height:double,confidence:double>")
    return by_page(begun(spans, s), run, f"doc_id long, page int, text_line double, line_height double, strips array<{fields[0]}>, bands array<{fields[1]}>")


def vertical_strips(spans: DataFrame, page: Page, s: GapSettings | None = None) -> DataFrame:
    """Vertical strips of empty space by page, with a confidence."""
    s = s or GapSettings()
    # A window that puts pages together; the number itself is not needed.
    placed = spans.withColumn("_n", F.row_number().over(_page_window("span_id"))).select(*KEYS, "left", "top", "right", "bottom", "height", "_n")

    def run(pages: paging.Pages) -> Iterator[pa.RecordBatch]:
        found = paging.all_strips(pages, paging.text_lines(pages, s), page, s)
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        values = np.array([x for own in found for x in own]).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays([pages.first(k).take(pa.array(owner)) for k in KEYS] + [pa.array(values[:, k]) for k in range(5)], [*KEYS, "left", "right", "top", "bottom", "confidence"])

    return by_page(placed, run, "doc_id long, page int, left double, right double, top double, bottom double, confidence double")


def page_layout(spans: DataFrame, page: Page, s: LayoutSettings | None = None, gaps: GapSettings | None = None, gutters: float = 0.0) -> DataFrame:
    """doc_id, page, para_id, pos, span_id: the paragraphs of every page, each span in one of them.

    ``gutters`` (in lines; 0: none) adds bands where a page has that much room between lines.
    """
    s, gaps = s or LayoutSettings(), gaps or GapSettings()

    def run(pages: paging.Pages) -> Iterator[pa.RecordBatch]:
        place, para, pos = [], [], []
        for begin, (profile, columns, first) in zip(pages.begin.tolist(), paging.profiles(pages, page, s, gaps, gutters), strict=True):
            for p, own in enumerate(paging.merged(profile, columns, first, s, gaps)):
                place += [begin + x for x in own]
                para += [p] * len(own)
                pos += range(len(own))
        rows = pages.rows.take(pa.array(place, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(para, pa.int32()), pa.array(pos, pa.int32()), rows.column(2)], [*KEYS, "para_id", "pos", "span_id"])

    return by_page(begun(spans, s), run, "doc_id long, page int, para_id int, pos int, span_id long")


def merge_pass(spans: DataFrame, page: Page, step: str, s: LayoutSettings | None = None, gaps: GapSettings | None = None) -> DataFrame:
    """doc_id, page, span_id, group_id: one step of the page layout on first paragraphs; a group has the id of its least span.

    ``step``: split (at wide gaps of lines), merge (in the order given), stack (downward, one pass in the
    order of boxes) or nest (pairs that hold each other or share a formula, one pass).
    """
    s, gaps = s or LayoutSettings(), gaps or GapSettings()

    def run(pages: paging.Pages) -> Iterator[pa.RecordBatch]:
        place, group = [], []
        ids = pages.column("span_id").tolist()
        for begin, (profile, columns, first) in zip(pages.begin.tolist(), paging.profiles(pages, page, s, gaps), strict=True):
            for own in paging.one_step(step, profile, columns, first, s, gaps):
                place += [begin + x for x in own]
                group += [min(ids[begin + x] for x in own)] * len(own)
        rows = pages.rows.take(pa.array(place, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(group, pa.int64())], [*KEYS, "span_id", "group_id"])

    return by_page(begun(spans, s), run, "doc_id long, page int, span_id long, group_id long")


def first_paragraph_only(paragraphs: DataFrame) -> DataFrame:
    """A span that several paragraphs hold stays in the first; for paragraphs that come from elsewhere."""
    w = W.partitionBy(*KEYS, "span_id").orderBy("para_id", "pos")
    return paragraphs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def one_segment(pages: DataFrame, page: Page) -> DataFrame:
    """The trivial segmentation: each page is one segment."""
    return pages.select(*KEYS).distinct().select(*KEYS, F.lit(0).alias("segment"), *[F.lit(getattr(page, c)).alias(c) for c in ("top", "bottom", "left", "right")], F.lit(1).alias("columns"))


def segments(spans: DataFrame, page: Page, s: SegmentSettings | None = None, pages: DataFrame | None = None, gaps: GapSettings | None = None) -> DataFrame:
    """Vertical segments of a page by number of columns; ``pages`` (doc_id, page) without spans are one segment."""
    s, gaps = s or SegmentSettings(), gaps or GapSettings()
    placed = spans.withColumn("_n", F.row_number().over(_page_window("span_id"))).select(*KEYS, "left", "top", "right", "bottom", "height", "_n")

    def run(found: paging.Pages) -> Iterator[pa.RecordBatch]:
        lines = paging.text_lines(found, gaps).tolist()
        edges = [found.column(c).astype(float) for c in ("left", "top", "right", "bottom")]
        own = [paging.segments(*(e[a:b] for e in edges), line, page, s) for a, b, line in zip(found.begin.tolist(), found.end.tolist(), lines, strict=True)]
        owner = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
        columns = list(zip(*(x for rows in own for x in rows), strict=True))
        kinds = (pa.float64(),) * 4 + (pa.int32(),)
        yield pa.RecordBatch.from_arrays([*(found.first(k).take(owner) for k in KEYS), pa.array([k for x in own for k in range(len(x))], pa.int32()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [*KEYS, "segment", "top", "bottom", "left", "right", "columns"])

    found = by_page(placed, run, "doc_id long, page int, segment int, top double, bottom double, left double, right double, columns int")
    return found if pages is None else found.unionByName(one_segment(pages.join(spans.select(*KEYS).distinct(), list(KEYS), "left_anti"), page))
