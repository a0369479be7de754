"""The reading order by bands and columns: a page by hand, and a second implementation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sheafline.operators import layout, order
from sheafline.schema import LayoutSettings, Page

PAGE = Page()


def spans_of(spark, rows):
    data = [(1, 1, k, t, float(x), float(y), float(w), float(h), float(x + w), float(y + h), 10.0, 400, "normal", "Serif", "rgb(0, 0, 0)") for k, (x, y, w, h, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, page int, span_id long, text string, left double, top double, width double, height double, right double, bottom double, font_size double, font_weight int, font_style string, font_family string, color string")


def test_two_columns_under_a_title_read_by_column(spark):
    rows = [(50, 40, 510, 14, "title")]
    for n in range(30):  # lines come row by row, left and right in turn
        y = 120 + 18 * n
        rows += [(50, y, 230, 11, f"L{n}"), (330, y, 230, 11, f"R{n}")]
    spans = spans_of(spark, rows)
    ordered = order.reading_order(spans, layout.page_profiles(spans, PAGE, gutters=1.5), PAGE)  # the room under the title is a band
    want = ["title", *(f"L{n}" for n in range(30)), *(f"R{n}" for n in range(30))]
    assert order.text_in_order(ordered).first()["text"].split("\n") == want
    # Row by row it is in the plain order.
    assert [r["text"] for r in spans.orderBy("top", "left").limit(3).collect()] == ["title", "L0", "R0"]


def slow_order(spans, bands, strips, s, rest):
    own = sorted((y, y + h) for y, h in bands)
    if rest:
        reach, more = PAGE.top, []
        for top, bottom in [*own, (PAGE.bottom, PAGE.bottom)]:
            if top > reach:
                more.append((reach, top))
            reach = max(reach, bottom)
        own = sorted(own + more)
    own = own or [(PAGE.top, PAGE.bottom)]
    columns = []
    for top, bottom in own:
        inside = [(x0, x1) for x0, x1, a, b in strips if (c := min(bottom, b) - max(top, a)) > 0 and c / max(1, b - a, bottom - top) >= s.band_overlap]
        edges = [PAGE.left]
        for m in sorted((a + b) / 2 for a, b in inside):
            if m > edges[-1]:
                edges.append(m)
        edges.append(PAGE.right)
        found = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b - a > s.region_width] if inside else [(PAGE.left, PAGE.right)]
        columns.append(found or [(-math.inf, math.inf)])
    out = {}
    for k, (x, y, w, h) in enumerate(spans):
        best, at = 0.0, None
        for i, (top, bottom) in enumerate(own):
            c = min(y + h, bottom) - max(y, top)
            if c > 0 and c / max(1, h, bottom - top) > best:
                best, at = c / max(1, h, bottom - top), i
        if at is None:
            at = min(range(len(own)), key=lambda i: (abs((y + y + h) / 2 - (own[i][0] + own[i][1]) / 2), i))
        middle = (x + x + w) / 2
        col = next((i for i, (a, b) in enumerate(columns[at]) if a <= middle < b), None)
        out[k] = (at, col if col is not None else 0 if middle < columns[at][0][0] else len(columns[at]) - 1)
    ranked = sorted(out, key=lambda k: (*out[k], spans[k][1], spans[k][0], k))
    return {k: (*out[k], ranked.index(k)) for k in out}


@pytest.mark.parametrize("rest", [True, False])
def test_order_against_a_second_implementation(spark, rest):
    rng = random.Random(7)
    pages, profiles, want = [], [], {}
    s = LayoutSettings()
    for p in range(40):
        spans = [(rng.uniform(-20, 600), rng.choice([rng.uniform(-30, 800), 100.0]), rng.choice([0.0, 40.0, 200.0]), rng.choice([0.0, 0.5, 11.0, 90.0])) for _ in range(rng.randint(1, 25))]
        bands, at = [], rng.uniform(0, 200)
        for _ in range(rng.randint(0, 4)):
            bands.append((at, rng.choice([0.0, 8.0, 150.0])))
            at += bands[-1][1] + rng.uniform(5, 200)
        strips = [(x, x + rng.choice([4.0, 0.2, 30.0]), a, a + rng.uniform(1, 700)) for x, a in ((rng.choice([rng.uniform(0, 600), 300.0]), rng.uniform(0, 400)) for _ in range(rng.randint(0, 5)))]
        pages += [(1, p, k, x, y, x + w, y + h) for k, (x, y, w, h) in enumerate(spans)]
        profiles.append((1, p, [(*t, 0.9) for t in strips], [(*b, 0.9) for b in bands]))
        want |= {(p, k): v for k, v in slow_order(spans, bands, strips, s, rest).items()}
    df = spark.createDataFrame(pages, "doc_id long, page int, span_id long, left double, top double, right double, bottom double")
    found = spark.createDataFrame(profiles, "doc_id long, page int, strips array<struct<left:double,right:double,top:double,bottom:double,confidence:double>>, bands array<struct<y:double,height:double,confidence:double>>")
    got = {(r["page"], r["span_id"]): (r["band"], r["col"], r["pos"]) for r in order.reading_order(df, found, PAGE, rest=rest).collect()}
    # The regions' zone_of compares y + h of a span that was made of left and width: the same sums here.
    assert got == want


def test_order_inside_paragraphs_and_empty_pages(spark):
    df = spark.createDataFrame([(1, 1, k, k % 2, 0.0, float(10 * k), 10.0, 10.0 * k + 8) for k in range(6)], "doc_id long, page int, span_id long, para_id int, left double, top double, right double, bottom double")
    profiles = spark.createDataFrame([(1, 1, [], [])], "doc_id long, page int, strips array<struct<left:double,right:double,top:double,bottom:double,confidence:double>>, bands array<struct<y:double,height:double,confidence:double>>")
    for rest in (True, False):
        got = order.reading_order(df, profiles, PAGE, "para_id", rest=rest)
        assert {(r["span_id"], r["band"], r["col"], r["pos"]) for r in got.collect()} == {(k, 0, 0, k // 2) for k in range(6)}
    assert order.reading_order(df.filter(F.lit(False)), profiles, PAGE).count() == 0
