"""Hand-made pages, properties of layouts, packing and replies, store formats."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheafline.functions import text as T
from sheafline.operators import layout, paging, replies, translate, units, viewer
from sheafline.schema import MATH_CHAR, MISSING, OPERATOR_CHAR, Page, TextSettings
from sheafline.sources import spans as S
from sheafline.sources import store
from sheafline.streaming import changes

PAGE = Page()


def page_of(spark, rows):
    """(left, top, width, height, font, text) as spans of one page."""
    data = [(1, 1, k, t, float(x), float(y), float(w), float(h), float(x + w), float(y + h), float(f), 400, "normal", "Serif", "rgb(0, 0, 0)") for k, (x, y, w, h, f, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, page int, span_id long, text string, left double, top double, width double, height double, right double, bottom double, font_size double, font_weight int, font_style string, font_family string, color string")


def groups(spark, rows):
    return layout.initial_paragraphs(page_of(spark, rows)).agg(F.countDistinct("para_id")).first()[0]


@pytest.mark.parametrize(
    ("rows", "n"),
    [
        ([(50, 100, 200, 11, 10, "a"), (50, 116, 200, 11, 10, "b"), (50, 132, 200, 11, 10, "c")], 1),
        ([(50, 100, 200, 11, 10, "a"), (50, 151, 200, 11, 10, "b")], 2),
        ([(50, 100, 200, 14, 14, "a"), (50, 116, 200, 11, 10, "b")], 2),
        ([(50, 100, 200, 11, 10, "exam-"), (55, 141, 60, 11, 10, "ple")], 1),
        ([(50, 100, 100, 11, 10, "ab"), (153, 100, 100, 11, 10, "ab")], 1),
        ([(50, 100, 100, 11, 10, "ab"), (158, 100, 100, 11, 10, "ab")], 2),
    ],
)
def test_initial_groups(spark, rows, n):
    assert groups(spark, rows) == n


def test_two_columns_become_two_paragraphs(spark):
    rows = [(x, 60 + 16 * r, 255, 11, 10, "word") for r in range(40) for x in (50, 340)]
    spans = page_of(spark, rows)
    assert layout.initial_paragraphs(spans).agg(F.countDistinct("para_id")).first()[0] == 80
    found = layout.page_layout(spans, PAGE).collect()
    assert len(found) == 80 and len({r["span_id"] for r in found}) == 80
    assert len({r["para_id"] for r in found}) == 2


def test_validity(spark):
    texts = ["12", "1234", "•", "-", "http://x", " ", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").filter(S.is_valid(F.col("t"), F.lit(9.0), F.lit(9.0)))
    assert {r["t"] for r in df.collect()} == {"1234", "a"}


def test_colors_and_escapes(spark):
    rows = spark.createDataFrame([("rgb(1, 2, 3)",), ("#abc",), ("#0a0b0c",), ("red",)], "c string").select(T.rgb(F.col("c")).alias("v")).collect()
    assert [r["v"] for r in rows] == [[1, 2, 3], [170, 187, 204], [10, 11, 12], [0, 0, 0]]
    assert spark.createDataFrame([('<a & "b">',)], "c string").select(T.escape_html(F.col("c")).alias("v")).first()["v"] == "&lt;a &amp; &quot;b&quot;&gt;"


def test_strip_statistics():
    assert paging.spread([3.0]) == 0.0
    merged = paging.merge_strips([(10, 20, 0, 50, 0.7), (11, 21, 40, 90, 0.9), (60, 70, 0, 9, 0.8)], 3.0)
    assert merged == [(10, 21, 0, 90, 0.9), (60, 70, 0, 9, 0.8)]


def test_occupancy(spark):
    rects = spark.createDataFrame([(1, 1, 0, 10.0, 30.0), (1, 1, 0, 25.0, 40.0), (1, 1, 0, 60.0, 90.0)], "doc_id long, page int, band int, left double, right double")
    assert sorted((r["left"], r["right"]) for r in layout.occupied(rects).collect()) == [(10, 40), (60, 90)]


@pytest.mark.parametrize(
    ("raw", "n", "want"),
    [("1. a\n3. c", 3, ["a", MISSING, "c"]), ("a\nb\nc", 3, ["a", "b", "c"]), ("x", 3, ["x", MISSING, MISSING]), ("1. a\n1. b", 2, ["b", MISSING]), ("1. a\n2. b", 2, ["a", "b"])],
)
def test_replies(spark, raw, n, want):
    df = spark.createDataFrame([(raw, n)], "raw string, expected int")
    assert df.select(replies.parse_numbered(F.col("raw"), F.col("expected")).alias("v")).first()["v"] == want


def test_fallback(spark):
    rows = [("a", 0, "o0", "t0"), ("a", 1, "o1", MISSING), ("a", 2, "o2", "t2"), ("b", 0, "o0", MISSING), ("b", 1, "o1", MISSING), ("b", 2, "o2", "t2")]
    df = spark.createDataFrame(rows, "k string, ord int, original string, line string")
    got = {(r["k"], r["ord"]): r["final"] for r in replies.fill_missing(df, "k").collect()}
    assert [got["a", i] for i in range(3)] == ["t0", "o1", "t2"]
    assert [got["b", i] for i in range(3)] == ["o0", "o1", "o2"]


def test_packing(spark):
    df = spark.createDataFrame([(1, 1, 0, "aaaa."), (1, 1, 1, "bbbb"), (1, 1, 2, "cccc.")], "doc_id long, page int, ord int, text string")
    got = [(r["chunk_id"], r["ord_in_chunk"], r["ord"]) for r in units.pack(df, 20).orderBy("ord").collect()]
    assert got == [(0, 0, 0), (1, 0, 1), (1, 1, 2)]


def test_failed_chunks_keep_originals(spark):
    def broken(system, user):
        raise ValueError("no")

    df = spark.createDataFrame([(1, 1, 0, "u0", "para-0", "one."), (1, 1, 1, "u1", "para-0", "two.")], "doc_id long, page int, ord int, unit_id string, paragraph_id string, text string")
    got = translate.translate_units(df, broken, TextSettings(attempts=1)).collect()
    assert {r["final"] for r in got} == {"one.", "two."}


def test_rate_limits_back_off():
    seen, calls = [], []

    def slow(system, user):
        calls.append(user)
        if len(calls) < 3:
            raise translate.RateLimited
        return ""

    assert translate.call(slow, "s", "u", 3, seen.append) == "u"
    assert len(seen) == 2 and 1 <= seen[0] <= 1.5 and 2 <= seen[1] <= 2.5


OLD = """---
pdf-source: '[[a.pdf]]'
timestamp: never
version: {version}
---
## Page 2
| <!-- {{"r":{{"l":0.1,"t":0.1,"w":0.1,"h":0.1}},"page":9}} --> gone | gone |
## Page 2
| <!-- {meta} --> a \\| b | c\\nd |
| <!-- {{"r":{{"l":0.1,"t":0.1,"w":0,"h":0.1}},"page":2}} --> w | w |
"""
NEW = """---
format-version: 3
---
## Page 1
%% {"r":{"l":0.1,"t":0.2,"w":0.3,"h":0.4},"page":1,"ot":"x"} %%

y<br>z

%% {bad json} %%
%% {"r":{"l":0.1,"t":0.2,"w":0.3,"h":0.4},"page":1,"ot":"empty"} %%
## Page 1
%% {"r":{"l":0.5,"t":0.2,"w":0.3,"h":0.4},"page":7,"ot":"more"} %%
last
"""


def test_store_versions(spark):
    import base64

    plain = '{"r":{"l":0.5,"t":0.5,"w":0.2,"h":0.1},"page":2,"fontSize":9}'
    coded = "PDF_TRANSLATOR_METADATA:" + base64.b64encode(plain.encode()).decode()
    docs = spark.createDataFrame([("v1", OLD.format(version=1, meta=plain)), ("v2", OLD.format(version=2, meta=coded)), ("v3", NEW), ("none", "just text")], "doc string, content string")
    rows = store.parse(docs, F.lit("2000-01-01").cast("timestamp")).orderBy("doc", "page_key", "ord").collect()
    assert [(r["doc"], r["text_content"], r["translated_text"], r["page"], r["font_size"]) for r in rows if r["doc"] != "v3"] == [("v1", "a | b", "c\nd", 2, 9.0), ("v2", "a | b", "c\nd", 2, 9.0)]
    assert [(r["text_content"], r["translated_text"], r["page"]) for r in rows if r["doc"] == "v3"] == [("x", "y\nz", 1), ("empty", "", 1), ("more", "last", 7)]
    assert {r["ts"].year for r in rows} == {2000}


def test_compatible_reading_takes_the_next_line(spark):
    """As older readers did: an item without a text takes the line after it, whatever that is."""
    content = '---\nformat-version: 3\n---\n## Page 1\n%% {"r":{"l":0.1,"t":0.2,"w":0.3,"h":0.4},"page":1,"ot":"empty"} %%\n## Page 2\n'
    docs = spark.createDataFrame([("d", content)], "doc string, content string")
    clock = F.lit("2000-01-01").cast("timestamp")
    assert [store.parse(docs, clock, compat).first()["translated_text"] for compat in (False, True)] == ["", "## Page 2"]


def test_spans_without_a_place_are_left_out(spark):
    nan = float("nan")
    rows = [(1, 1, k, "text", left, 0.0, 10.0, 10.0) for k, left in enumerate((0.0, None, nan, float("inf")))] + [(None, 1, 9, "text", 0.0, 0.0, 10.0, 10.0), (1, None, 10, "text", 0.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, span_id long, text string, left double, top double, width double, height double")
    assert [r["span_id"] for r in S.whole_spans(df).collect()] == [0]


def test_region_replacement(spark):
    old = spark.createDataFrame([(1, 0.1, 0.1, 0.2, 0.2), (1, 0.6, 0.1, 0.2, 0.2)], "p int, rel_left double, rel_top double, rel_width double, rel_height double")
    new = spark.createDataFrame([(1, 0.3, 0.1, 0.2, 0.2)], old.schema)
    assert sorted(r["rel_left"] for r in store.replace_region(old, new, "p").collect()) == [0.3, 0.6]


def test_regions_in_cells_against_all_pairs(spark):
    rng = random.Random(12)

    def box():
        size = rng.choice([1e-5, 0.001, 0.02, 0.3, 1.4])
        return (rng.choice([1, 1, 1, 2, None]), rng.choice([rng.uniform(-0.2, 1.1), 0.25, 0.5]), rng.uniform(-0.2, 1.1), size * rng.random(), rng.choice([size, 0.0]))

    boxes = [box() for _ in range(700)]
    boxes += [boxes[0], boxes[0], (1, None, 0.1, 0.1, 0.1), (1, 0.1, 0.1, None, 0.1)]
    schema = "p int, rel_left double, rel_top double, rel_width double, rel_height double"
    old, new = boxes[::2], [b for k, b in enumerate(boxes) if k % 2 and b[0] != 2 and (b[3] or 0) < 0.05]

    def touch(o, n, e=1e-5):
        return None not in o + n and o[0] == n[0] and o[1] <= n[1] + n[3] + e and o[1] + o[3] >= n[1] - e and o[2] <= n[2] + n[4] + e and o[2] + o[4] >= n[2] - e

    want = Counter([o for o in old if not any(touch(o, n) for n in new)] + new)
    dfs = [spark.createDataFrame(x, schema).selectExpr("*", "1 AS level", "2 AS own", "3 AS row") for x in (old, new)]
    got = Counter(tuple(r)[:5] for r in store.replace_region(*dfs, "p").collect())
    assert got == want and 50 < sum(want.values()) < len(old) + len(new) - 50
    assert store.replace_region(dfs[0], dfs[1].limit(0), "p").count() == len(old) and store.replace_region(dfs[0].limit(0), dfs[1], "p").count() == len(new)


def test_pairs_in_cells_grow_in_proportion(spark):
    """Twice as many lines on pages twice as long, or on one page with lines half as high: pairs double, they don't grow with the square."""

    def pairs(n, high):
        rows = spark.range(n).selectExpr("1 AS p", f"(id % 4) / 4D AS rel_left", f"floor(id / 4) * {high}D AS rel_top", "0.2D AS rel_width", f"{high * 0.8}D AS rel_height", "id AS _box")
        return store.pairs_in_cells(rows, rows.drop("_box"), "p").select("_box").count()

    assert pairs(1600, 0.01) <= 2.3 * pairs(800, 0.01) <= 2.3 * 800 * 120
    assert pairs(1600, 0.0025) <= 3 * pairs(800, 0.005)


def test_source_link(spark):
    df = spark.createDataFrame([("---\npdf-source: '[[old.pdf]]'\nx: 1\n---\nbody",), ("---\nx: 1\n---\nbody",), ("body",)], "c string")
    got = [r["v"] for r in df.select(store.source_link(F.col("c"), F.lit("new.pdf")).alias("v")).collect()]
    assert got == ["---\npdf-source: '[[new.pdf]]'\nx: 1\n---\nbody", "---\npdf-source: '[[new.pdf]]'\nx: 1\n---\nbody", "body"]


def test_debounce_on_a_stream_equals_the_table(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:0{s}") for s in (0, 1, 5, 6)]
    df = spark.createDataFrame(rows, "k int, ts string").select("k", F.col("ts").cast("timestamp").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    batch = changes.debounced(df, "2 seconds", "1 second", "k").collect()
    query = changes.debounced(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "2 seconds", "1 second", "k").writeStream.format("memory").queryName("bursts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["n_events"] for r in batch) == [2, 2] == sorted(r["n_events"] for r in spark.sql("select * from bursts").collect())


def test_viewer_on_odd_values(spark):
    pages = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 5.0), (1, 2, 0.0, 5.0, 10.0, 10.0), (2, 1, 0.0, -50.0, 10.0, -40.0), (3, 1, 0.0, 0.0, 0.0, 0.0)], "doc long, page int, left double, top double, right double, bottom double")
    found = {r["doc"]: tuple(r)[1:] for r in viewer.pages_in_view(pages, 10.0, 20.0, "doc").collect()}
    assert found == {1: (1, 1, 2, 2), 2: (1, None, 0, 0), 3: (None, None, 0, 1)}
    items = spark.createDataFrame([("a", k) for k in ("1", "01", "x", "-2", "0", "", None, "NaN")], "doc string, page_key string")
    assert [r["page"] for r in viewer.pages_with_items(items, "doc").collect()] == [1.0]
    stored = spark.createDataFrame([("1", "a", "s", "d0", "d0")], "id string, name string, settings string, created_at string, updated_at string")
    changed = spark.createDataFrame([("1", "b", "t", "d9"), ("2", "c", "u", None)], "id string, name string, settings string, created_at string")
    saved = viewer.save_presets(stored, changed, F.lit("d1"))
    assert sorted(map(tuple, saved.collect())) == [("1", "b", "t", "d0", "d1"), ("2", "c", "u", "d1", "d1")]
    assert viewer.delete_presets(saved, changed).count() == 0


def test_boxes_of_two_tables_meet_without_a_broadcast(spark):
    """A broadcast side lies in the driver, dealt over cells and many times as large as it was judged."""
    old, new = (spark.range(40).selectExpr("id % 2 as p", f"(id * {k} % 17) / 20d as rel_left", "(id % 11) / 12d as rel_top", "0.1d as rel_width", "0.05d as rel_height") for k in (3, 5))
    assert "Broadcast" not in store.replace_region(old, new, "p")._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_spans_follow_the_texts(spark, monkeypatch):
    """A task's spans don't grow with the input, though the session's number of shuffle partitions stays."""
    monkeypatch.setattr(S, "TASK_CHARS", 10_000)
    docs = spark.range(300).selectExpr("id as doc_id", "'en' as lang", "repeat('a word ', 100) as text")
    tasks = S.tasks_for(docs)
    assert tasks == max(21, spark.sparkContext.defaultParallelism)
    assert layout.initial_paragraphs(S.spans_of(docs, tasks=tasks)).rdd.getNumPartitions() == tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert S.tasks_for(docs.limit(0)) == spark.sparkContext.defaultParallelism


def test_math_signs_are_those_of_the_long_class_and_cheap_to_look_for(spark):
    signs = spark.range(1, 0x10000).filter("id not between 55296 and 57343").selectExpr("cast(id as int) as id").withColumn("c", F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE"))
    for quick, slow in ((T.is_math(F.concat(F.lit("né "), "c"), F.lit("")), F.col("c").rlike(MATH_CHAR)), (T.has_operator(F.concat(F.lit("né "), "c")), F.col("c").rlike("[" + OPERATOR_CHAR.replace("-", r"\-") + "]"))):
        assert signs.filter(quick != slow).count() == 0 < signs.filter(quick).count() < 1000
    texts = spark.range(0, 200_000, 1, 1).selectExpr("concat('la longue phrase n’a pas d’égalité ', id) as t").localCheckpoint()

    def seconds(found):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            texts.filter(found).count()
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(T.is_math(F.col("t"), F.lit(""))) < 0.5 * seconds(F.col("t").rlike(MATH_CHAR))
