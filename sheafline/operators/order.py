"""An optional reading order of pages: bands from top to bottom, columns inside a band, lines inside a column.

``page_layout`` orders spans by rows, whatever the columns. Here each span is laid
into one band of its page (the one it overlaps most, by its share of the larger of
both; where it overlaps none, the one with the nearest centre), each band is cut into column regions at the
middles of the strips that lie in it, and a page or paragraph is read band by band and region by
region. The bands of a page are those of its profile (which has gutters between lines as bands
where it is asked for them), and, with ``rest``, the stretches between them, where its columns are.

A page's few bands and strips are one row, joined to its spans by page; all the rest
are array functions in the JVM and one window, which reuses the pages' exchange. Ties go to the upper band, then
to the smaller span_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sheafline.operators.layout import KEYS
from sheafline.schema import LayoutSettings, Page


def _shared(top: Column, bottom: Column, other_top: Column, other_bottom: Column) -> tuple[Column, Column]:
    """Common height of two intervals, and its share of the larger (of one at least)."""
    common = F.least(bottom, other_bottom) - F.greatest(top, other_top)
    return common, common / F.greatest(F.lit(1.0), bottom - top, other_bottom - other_top)


def zones(bands: Column, page: Page, rest: bool = True) -> Column:
    """top, bottom of each band (y, height) of a page in order; with the stretches between them, if there is a ``rest``; the whole page where there is no band."""
    own = F.array_sort(F.transform(bands, lambda b: F.struct(b["y"].alias("top"), (b["y"] + b["height"]).alias("bottom"))))
    if rest:
        edge = F.struct(F.lit(page.bottom).alias("top"), F.lit(page.bottom).alias("bottom"))
        start = F.struct(F.lit(page.top).alias("reach"), F.array().cast("array<struct<top:double,bottom:double>>").alias("found"))

        def step(acc: Column, b: Column) -> Column:
            between = F.when(b["top"] > acc["reach"], F.array(F.struct(acc["reach"].alias("top"), b["top"].alias("bottom")))).otherwise(F.array().cast("array<struct<top:double,bottom:double>>"))
            return F.struct(F.greatest(acc["reach"], b["bottom"]).alias("reach"), F.concat(acc["found"], between).alias("found"))

        own = F.array_sort(F.concat(own, F.aggregate(F.concat(own, F.array(edge)), start, step, lambda acc: acc["found"])))
    whole = F.array(F.struct(F.lit(page.top).alias("top"), F.lit(page.bottom).alias("bottom")))
    return F.when(F.size(own) > 0, own).otherwise(whole)


def strips_in(zone: Column, strips: Column, s: LayoutSettings) -> Column:
    """The strips that lie in a zone for a share of the larger of both."""

    def inside(x: Column) -> Column:
        common, share = _shared(x["top"], x["bottom"], zone["top"], zone["bottom"])
        return (common > 0) & (share >= s.band_overlap)

    return F.filter(strips, inside)


def regions(strips: Column, page: Page, s: LayoutSettings) -> Column:
    """left, right of the column regions between the middles of strips; narrow ones are left out, without any the region is unbounded."""
    middles = F.filter(F.array_distinct(F.array_sort(F.transform(strips, lambda x: (x["left"] + x["right"]) / 2))), lambda m: m > page.left)
    edges = F.concat(F.array(F.lit(page.left)), middles, F.array(F.lit(page.right)))
    cut = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges)), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    wide = F.filter(cut, lambda r: r["right"] - r["left"] > s.region_width)
    endless = F.array(F.struct(F.lit(float("-inf")).alias("left"), F.lit(float("inf")).alias("right")))
    return F.when(F.size(strips) == 0, F.array(F.struct(F.lit(page.left).alias("left"), F.lit(page.right).alias("right")))).when(F.size(wide) > 0, wide).otherwise(endless)


def page_zones(profiles: DataFrame, page: Page, s: LayoutSettings | None = None, rest: bool = True) -> DataFrame:
    """keys, zones: the zones of each page (of ``layout.page_profiles``) with top, bottom and column regions."""
    s = s or LayoutSettings()
    found = profiles.select(*KEYS, "strips", zones(F.col("bands"), page, rest).alias("zones"))
    return found.select(*KEYS, F.transform("zones", lambda z: F.struct(z["top"].alias("top"), z["bottom"].alias("bottom"), regions(strips_in(z, F.col("strips"), s), page, s).alias("regions"))).alias("zones"))


def zone_of(top: Column, bottom: Column, found: Column) -> Column:
    """Index of the zone with the largest share of overlap; the one with the nearest centre where none overlaps."""

    def overlap(z: Column, i: Column) -> Column:
        common, share = _shared(top, bottom, z["top"], z["bottom"])
        return F.when(common > 0, F.struct(share.alias("share"), (-i).alias("before")))

    best = F.array_max(F.filter(F.transform(found, overlap), lambda x: x.isNotNull()))
    near = F.array_min(F.transform(found, lambda z, i: F.struct(F.abs((top + bottom) / 2 - (z["top"] + z["bottom"]) / 2).alias("away"), i.alias("at"))))
    return F.coalesce(-best["before"], near["at"])


def column_of(middle: Column, found: Column) -> Column:
    """Index of the first region that holds a place; the first or last one beside them."""
    inside = F.array_min(F.filter(F.transform(found, lambda r, i: F.when((middle >= r["left"]) & (middle < r["right"]), i)), lambda i: i.isNotNull()))
    return F.coalesce(inside, F.when(middle < found[0]["left"], 0).otherwise(F.size(found) - 1))


def reading_order(spans: DataFrame, profiles: DataFrame, page: Page, *within: str, s: LayoutSettings | None = None, rest: bool = True) -> DataFrame:
    """The spans with band, col and pos: their place in the order of their page, or of what ``within`` names inside it (a paragraph)."""
    placed = spans.join(page_zones(profiles, page, s, rest), list(KEYS)).withColumn("band", zone_of(F.col("top"), F.col("bottom"), F.col("zones")))
    placed = placed.withColumn("col", column_of((F.col("left") + F.col("right")) / 2, F.element_at("zones", F.col("band") + 1)["regions"])).drop("zones")
    order = W.partitionBy(*KEYS, *within).orderBy("band", "col", "top", "left", "span_id")
    return placed.withColumn("pos", F.row_number().over(order) - 1)


def text_in_order(ordered: DataFrame, *within: str) -> DataFrame:
    """keys, text: spans of ``reading_order`` as lines in its order."""
    lines = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return ordered.groupBy(*KEYS, *within).agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))
