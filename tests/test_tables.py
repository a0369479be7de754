"""Table functions give the rows of the column expressions."""

import base64
import json
import random

from pyspark.sql import functions as F

from sheafline.functions import tables
from sheafline.operators import replies
from sheafline.sources import store


def test_numbered_lines_are_those_of_the_expressions(spark):
    rng = random.Random(5)
    pieces = ["1. a", "2. b ", " 3.  c", "2.d", "x", "", "10. y", "1234567890. z", "1.\n2. q", " 4. nb", "é.", "2. again\r", "a  1. line"]
    rows = [(k, "\n".join(rng.choices(pieces, k=rng.randint(0, 6))), rng.randint(0, 5)) for k in range(400)] + [(1000, None, 2), (1001, "1. a", None), (1002, "1. a", -1)]
    df = spark.createDataFrame(rows, "id long, raw string, expected int")
    tables.register(spark)
    df.createOrReplaceTempView("replies_here")
    got = {tuple(r) for r in spark.sql("SELECT r.id, t.ord, t.line FROM replies_here AS r, LATERAL numbered_lines(r.raw, r.expected) AS t").collect()}
    want = {tuple(r) for r in replies.parse_replies(df, "id").collect()}
    assert {x for x in got if x[0] < 1000} == {x for x in want if x[0] < 1000} and len(want) > 400
    assert not [x for x in got if x[0] > 1000] or {x for x in got if x[0] > 1000} == {x for x in want if x[0] > 1000}


def test_note_items_are_those_of_the_store(spark):
    def meta(**more):
        return json.dumps({"r": {"l": 0.1, "t": 0.2, "w": 0.3, "h": 0.4}, "page": 2, **more})

    coded = base64.b64encode(meta(fontSize=9).encode()).decode()
    notes = {
        "new": f"---\nformat-version: 3\n---\n\n# x\n\n## Page 2\n\n%% {meta(ot='A', fs=8.5, ff='Serif', ofs=[8, 9.5])} %%\n\none<br>two\n\n%% {meta(ot='B')} %%\n\n%% {meta()} %%\n\n## page 3\n%% {meta(ot='C')} %%\nthree\n## Page 2\n%% {meta(ot='D')} %%\nfour",
        "old": f"---\nversion: 2\n---\n## Page 1\n| gone | gone |\n## Page 1\n| <!-- {meta(fontSize=10)} --> a \\| b | t\\nu |\n| <!-- PDF_TRANSLATOR_METADATA:{coded} --> c | d |\n| x |\n## Page 2\n| <!-- {meta()} --> e | f |",
        "bad": f"no front matter\n| <!-- {meta()} --> before any page | x |\n## Page 1\n| <!-- {{broken --> a | b |\n| <!-- {json.dumps({'r': {'l': 0, 't': 0, 'w': 0, 'h': 1}, 'page': 1})} --> a | b |\n| <!-- {json.dumps({'r': {'l': 0, 't': 0, 'w': 1, 'h': 1}})} --> a | b |",
        "empty": "",
    }
    df = spark.createDataFrame(list(notes.items()), "doc string, content string")
    tables.register(spark)
    df.createOrReplaceTempView("notes_here")
    got = spark.sql("SELECT * FROM note_items(TABLE(notes_here) PARTITION BY doc)")
    want = store.parse(df, F.current_timestamp()).select(*got.columns)
    rows = sorted(map(repr, got.collect()))
    assert rows == sorted(map(repr, want.collect())) and len(rows) == 8
    spark.createDataFrame([("n", None), ("n", None)], "doc string, content string").createOrReplaceTempView("notes_here")
    assert spark.sql("SELECT * FROM note_items(TABLE(notes_here) PARTITION BY doc)").collect() == []


def test_parts_of_a_note_come_in_the_order_asked_for(spark):
    tables.register(spark)
    lines = store.generate(spark.createDataFrame([("d", "1", k, 1, f"t{k}", f"u{k}", 0.1, 0.1, 0.1, 0.1, 9.0, "S", [9.0], None) for k in range(3)], "doc string, page_key string, ord int, page int, text_content string, translated_text string, rel_left double, rel_top double, rel_width double, rel_height double, font_size double, font_family string, original_font_sizes array<double>, ts timestamp").withColumn("ts", F.current_timestamp()))
    lines.select("doc", F.posexplode(F.split("content", "\n")).alias("at", "content")).repartition(4).createOrReplaceTempView("lines_here")
    got = spark.sql("SELECT ord, text_content, translated_text FROM note_items(TABLE(lines_here) PARTITION BY doc ORDER BY at)")
    assert sorted(tuple(r) for r in got.collect()) == [(k, f"t{k}", f"u{k}") for k in range(3)]
