"""The page layout against a plain second implementation, on all pages of the smallest tables and on made pages."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.operators import layout, paging
from sheafline.schema import LayoutSettings, Page
from sheafline.session import table
from sheafline.sources import spans as S
from tests import slow_layout

DATA = "/root/testdata/sf0.001"
PAGE = Page()
SCHEMA = "doc_id long, page int, span_id long, text string, left double, top double, width double, height double, right double, bottom double, font_size double, font_weight int, font_style string, font_family string, color string"


def span(k, x, y, w, h, size=10.0, text="word", weight=400, family="Serif", style="normal", color=(0, 0, 0)):
    return {"id": k, "text": text, "left": float(x), "top": float(y), "right": float(x + w), "bottom": float(y + h), "size": float(size), "family": family, "style": style, "weight": weight, "rgb": color}


def as_rows(doc, spans):
    return [(doc, 1, x["id"], x["text"], x["left"], x["top"], x["right"] - x["left"], x["bottom"] - x["top"], x["right"], x["bottom"], x["size"], x["weight"], x["style"], x["family"], "rgb({}, {}, {})".format(*x["rgb"])) for x in spans]


def made_pages():
    """Two columns, nesting, formulas, headings over columns, ragged lines, clutter; the first ones are fixed."""
    rng = random.Random(21)
    pages = []
    # A large bold box whose first span is of normal weight, and a light paragraph below it.
    pages.append([span(0, 50, 100, 40, 10, weight=400), span(1, 95, 100, 200, 40, weight=700), span(2, 50, 150, 240, 10, weight=100)])
    # Columns under a heading, a formula, an inset.
    pages.append([span(0, 50, 40, 500, 20, 18, weight=700)] + [span(1 + k, 50 + 290 * (k % 2), 80 + 14 * (k // 2), 250, 11) for k in range(60)])
    pages.append([span(k, 50 + 100 * k, 100, 80, 11) for k in range(5)] + [span(5 + k, 60, 130 + 13 * k, 480, 11, text="a = b") for k in range(6)] + [span(20, 100, 140, 60, 11, text="α")])
    pages.append([span(k, 50, 60 + 13 * k, 240, 11) for k in range(40)] + [span(40 + k, 320, 60 + 13 * k, 240, 11) for k in range(40)] + [span(90, 50, 700, 510, 11)])
    pages.append([span(k, 50, 60 + 13 * k, 240, 11) for k in range(20)] + [span(30 + k, 330, 400 + 13 * k, 240, 11) for k in range(20)])
    for kind in range(60):
        spans, k, y = [], 0, rng.randint(20, 120)
        columns = rng.choice((1, 1, 2, 3))
        while y < 740 and k < 90:
            for c in range(columns):
                if rng.random() < 0.1:
                    continue
                width = 520 // columns
                x, w = 40 + c * (width + 12) + rng.choice((0, 0, 0, 12, 30)), rng.uniform(0.3, 0.95) * width
                pieces = rng.choice((1, 1, 2, 3))
                for p in range(pieces):
                    text = rng.choice(("word", "word", "word", "hy-", "x = y", "∑", "αβ"))
                    own = span(k, x + p * w / pieces, y + rng.choice((0, 0, 0, 1.5)), w / pieces - rng.choice((0, 3, 20)), rng.choice((9, 11, 11, 14)), rng.choice((10, 10, 10, 10.8, 12)), text, rng.choice((400, 400, 700)), rng.choice(("Serif", "Serif", "Serif", "STIX Math")), rng.choice(("normal", "italic")), rng.choice(((0, 0, 0), (0, 0, 0), (4, 4, 4), (200, 0, 0))))
                    if own["right"] > own["left"]:
                        spans.append(own)
                        k += 1
            y += rng.choice((12, 13, 13, 14, 30, 60))
        if kind % 4 == 0:
            for _ in range(8):
                spans.append(span(k, rng.uniform(30, 400), rng.uniform(30, 700), rng.uniform(5, 200), rng.uniform(2, 60)))
                k += 1
        pages.append(spans)
    return pages


def found_paragraphs(df):
    out = defaultdict(lambda: defaultdict(list))
    for r in sorted(df.collect(), key=lambda r: (r["doc_id"], r["page"], r["para_id"], r["pos"])):
        out[r["doc_id"], r["page"]][r["para_id"]].append(r["span_id"])
    return {key: list(v.values()) for key, v in out.items()}


@pytest.fixture(scope="module")
def made(spark):
    pages = made_pages()
    return pages, spark.createDataFrame([r for doc, spans in enumerate(pages) for r in as_rows(doc, spans)], SCHEMA).repartition(4)


def test_made_pages(made):
    pages, df = made
    got = found_paragraphs(layout.page_layout(df, PAGE))
    for doc, spans in enumerate(pages):
        assert got[doc, 1] == slow_layout.layout(spans), doc
    assert sum(len(v) < len(slow_layout.first_groups(pages[doc])) for (doc, _), v in got.items()) > 30  # the merges have work to do


def test_small_batches_do_not_matter(spark, made):
    _, df = made
    whole = found_paragraphs(layout.page_layout(df, PAGE))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found_paragraphs(layout.page_layout(df, PAGE)) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def spans_by_page(spark):
    spans = S.valid_spans(S.spans_of(table(spark, DATA, "documents")))
    pages = defaultdict(list)
    for r in spans.collect():
        pages[r["doc_id"], r["page"]].append({"id": r["span_id"], "size": r["font_size"], "family": r["font_family"], "style": r["font_style"], "weight": r["font_weight"], "rgb": (0, 0, 0), **{c: r[c] for c in ("text", "left", "top", "right", "bottom")}})
    return spans, pages


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pages_of_documents(spark):
    spans, pages = spans_by_page(spark)
    got = found_paragraphs(layout.page_layout(spans, PAGE))
    assert got == {key: slow_layout.layout(v) for key, v in pages.items()}
    assert layout.first_paragraph_only(layout.page_layout(spans, PAGE)).count() == sum(map(len, pages.values()))


def test_strips_and_bands(made):
    pages, df = made
    profile = {r["doc_id"]: r for r in layout.page_profiles(df, PAGE).collect()}
    alone = defaultdict(list)
    for r in layout.strips_for_columns(layout.vertical_strips(df, PAGE)).collect():
        alone[r["doc_id"]].append(tuple(r)[2:])
    lines = {r["doc_id"]: r["line_height"] for r in layout.line_height(layout.initial_paragraphs(df), PAGE).collect()}
    for doc, spans in enumerate(pages):
        want, line = slow_layout.strips(spans), slow_layout.line_height(slow_layout.first_groups(spans))
        assert profile[doc]["line_height"] == pytest.approx(line) == lines[doc]
        assert [tuple(x) for x in profile[doc]["strips"]] == [pytest.approx(x) for x in want] == sorted(alone[doc], key=lambda x: x[0] + x[1])
        assert [(b["y"], b["y"] + b["height"]) for b in profile[doc]["bands"]] == [pytest.approx(b) for b in slow_layout.bands_of(want, line)]


def test_segments(made):
    pages, df = made
    # A page 500 wide for half its height and 100 wide from there on; a short stretch of two columns; and no spans at all.
    more = [
        [span(k, 50, 20 + 12 * k, 500 if k < 30 else 100, 11) for k in range(60)],
        [span(k, 50, 20 + 12 * k, 200, 11) for k in range(60)] + [span(90, 400, 380, 100, 11)],
        [span(k, 50 + 250 * (k % 2), 20 + 12 * (k // 2), 200, 11) for k in range(50)] + [span(50 + k, 50, 420 + 12 * k, 450, 11) for k in range(20)],
    ]
    extra = df.sparkSession.createDataFrame([r for k, spans in enumerate(more) for r in as_rows(1000 + k, spans)], SCHEMA)
    blank = df.sparkSession.createDataFrame([(2000, 1), (0, 1)], "doc_id long, page int")
    got = defaultdict(list)
    for r in layout.segments(df.unionByName(extra), PAGE, pages=blank).orderBy("doc_id", "segment").collect():
        got[r["doc_id"]].append(tuple(r)[3:])
    lines = {r["doc_id"]: r["line"] for r in layout.text_line_height(df.unionByName(extra)).collect()}
    for doc, spans in [*enumerate(pages), *((1000 + k, x) for k, x in enumerate(more))]:
        assert got[doc] == [pytest.approx(x) for x in slow_layout.segments(spans, lines[doc])], doc
    assert got[2000] == [(0, 792, 0, 612, 1)]
    assert [r[2:] for r in got[1000]] == [(50, 550, 1)]  # the right edge's shift is a change, but equal numbers of columns are one segment
    assert max(map(len, got.values())) > 1


def test_gutters(spark):
    spans = [span(k, 50, 60 + 13 * k, 240, 11) for k in range(5)] + [span(9, 50, 300, 240, 11)]
    df = spark.createDataFrame(as_rows(1, spans), SCHEMA)
    found = layout.horizontal_gutters(df.withColumn("line", F.lit(20.0)), F.col("line")).collect()
    assert [(r["y"], r["height"]) for r in found] == [((123 + 300) / 2 - 2, 4.0)]
    profile = layout.page_profiles(df, PAGE, gutters=1.5).first()
    line = profile["line_height"]
    assert [(b["y"], b["height"], b["confidence"]) for b in profile["bands"]][:1] == [(pytest.approx((123 + 300) / 2 - 0.1 * line), pytest.approx(0.2 * line), 0.95)]
    # With a band in between the last line stays apart even if gaps would allow for more.
    wide = LayoutSettings(merge_gap_lines=50, merge_gap_max=50, stack_gap_lines=50, stack_gap_max=50)
    assert [len(found_paragraphs(layout.page_layout(df, PAGE, wide, gutters=g))[1, 1]) for g in (0.0, 1.5)] == [1, 2]
    bands = spark.createDataFrame([(1, 1, 10.0, 2.0, 0.59), (1, 1, 20.0, 2.0, 0.6)], "doc_id long, page int, y double, height double, confidence double")
    assert [r["y"] for r in layout.sure_bands(bands).collect()] == [20.0]


def test_linear_settings(spark):
    """Forced merging looks at gaps alone."""
    spans = [span(0, 50, 60, 200, 11), span(1, 300, 60, 100, 11, 20, weight=900), span(2, 500, 72, 30, 11, family="Mono")]
    df = spark.createDataFrame(as_rows(1, spans), SCHEMA)
    assert len(found_paragraphs(layout.page_layout(df, PAGE))[1, 1]) == 3
    assert len(found_paragraphs(layout.page_layout(df, PAGE, LayoutSettings(linear=True)))[1, 1]) == 1


def test_split_with_a_line_height(spark):
    """With a line height, lines and cuts that lie within its tolerance count as one."""
    rows = [span(2 * k + c, 50 + 150 * c, 60 + 40 * k + 3 * c, 60, 11) for k in range(12) for c in range(2)] + [span(40 + k, 330, 60 + 13 * k, 240, 11) for k in range(38)]
    df = spark.createDataFrame(as_rows(1, rows), SCHEMA)
    loose = LayoutSettings(merge_gap_lines=9, merge_gap_max=9, split_line_height=10.0)
    got = found_paragraphs(layout.page_layout(df, PAGE, loose))[1, 1]
    assert all(len({x % 2 for x in p if x < 40}) <= 1 for p in got)


def test_gaps_of_all_pages_are_grouped_as_one_after_the_other():
    rng = np.random.default_rng(5)
    for n_pages, most, places in ((1, 40, 10_000), (7, 30, 40), (50, 60, 300), (3, 0, 5)):
        owner = np.repeat(np.arange(n_pages), rng.integers(0, most + 1, n_pages))
        centers, reach = rng.integers(0, places, len(owner)) / 2, rng.integers(1, 12, n_pages) / 2.0
        want, latest = [], [[] for _ in range(n_pages)]
        for p, c in zip(owner.tolist(), centers.tolist(), strict=True):
            k = next((k for k, x in enumerate(latest[p]) if abs(c - x) <= reach[p]), len(latest[p]))
            latest[p][k : k + 1] = [c]
            want.append(k)
        assert paging.gap_groups(owner, centers, reach).tolist() == want
