"""Translation runs, providers, settings, notes as files, the store under a stream."""

import contextlib
import io
import json
import os
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sheafline.functions import geometry as G
from sheafline.functions import text as T
from sheafline.operators import layout, translate, units, viewer
from sheafline.plans import catalogue
from sheafline.schema import MATH_CHAR, MISSING, STORED_LAYOUT, LayoutSettings, Page, TextSettings, layout_settings, normal_folder, text_settings
from sheafline.session import fresh_path, table
from sheafline.sources import spans as S
from sheafline.sources import store
from sheafline.streaming import changes
from tests import slow_layout
from tests.test_pages import SCHEMA, as_rows, made_pages, span

DATA = "/root/testdata/sf0.001"
PAGE = Page()
UNITS = "doc_id long, page int, ord int, unit_id string, paragraph_id string, text string"


def units_of(spark, pages):
    """{(doc, page): texts} as units."""
    return spark.createDataFrame([(d, p, k, f"u{k}", "para-0", t) for (d, p), texts in pages.items() for k, t in enumerate(texts)], UNITS)


def lines(df, column="final"):
    out = defaultdict(dict)
    for r in df.collect():
        out[r["doc_id"], r["page"]][r["ord"]] = r[column]
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


# --- modes ----------------------------------------------------------------------------------


def test_each_mode_sends_its_own_requests(spark, tmp_path):
    log = str(tmp_path / "log")
    os.mkdir(log)

    def noted(system, user):
        with open(os.path.join(log, f"{abs(hash((system, user)))}"), "w") as file:
            json.dump([system, user], file)
        return user.upper()

    s = TextSettings(budget=30, batch_prompt="{lineCount} lines to {targetLang}{inputText}", single_prompt="one to {targetLang}{inputText}", single_limit=4)
    pages = {(1, 1): ["ab.", "cd."], (2, 1): ["abcdefgh"], (3, 1): ["first one.", "second", "third one.", "4th."]}
    found = translate.translate_units(units_of(spark, pages), noted, s)
    assert {(r["doc_id"], r["mode"]) for r in found.collect()} == {(1, "batch"), (2, "single"), (3, "chunked")}
    assert lines(found) == {(1, 1): ["AB.", "CD."], (2, 1): ["ABCD"], (3, 1): ["FIRST ONE.", "SECOND", "THIRD ONE.", "4TH."]}
    sent = sorted(tuple(json.load(open(os.path.join(log, x)))) for x in os.listdir(log))
    assert sent == sorted([("2 lines to English", "1. ab.\n2. cd."), ("one to English", "abcd"), ("1 lines to English", "1. first one."), ("2 lines to English", "1. second\n2. third one."), ("1 lines to English", "1. 4th.")])


def test_failures_by_mode(spark):
    def picky(system, user):
        if "bad" in user:
            raise ValueError("no")
        return user

    pages = {(1, 1): ["bad.", "good."], (2, 1): ["bad"], (3, 1): ["x" * 20 + ".", "bad" + "y" * 20 + "."]}
    found = translate.translate_units(units_of(spark, pages), picky, TextSettings(budget=30, attempts=1))
    assert lines(found) == pages
    assert lines(found, "line") == {(1, 1): [None, None], (2, 1): [MISSING], (3, 1): pages[3, 1]}
    status = {r["doc_id"]: (r["status"], r["missing"]) for r in translate.job_status(found).collect()}
    assert status == {1: ("failed", 2), 2: ("completed", 1), 3: ("completed", 0)}
    # Unit by unit, a reply of several lines is one line, and over half missing means all originals.
    one_by_one = TextSettings(batch=False, attempts=1)
    found = translate.translate_units(units_of(spark, {(1, 1): ["a", "bad", "c"], (2, 1): ["bad", "bad1", "c"]}), lambda system, user: picky(system, user) + "\nmore", one_by_one)
    assert lines(found) == {(1, 1): ["a\nmore", "bad", "c\nmore"], (2, 1): ["bad", "bad1", "c"]}


def test_pages_are_tried_again_and_answers_kept(spark, tmp_path):
    calls = str(tmp_path / "calls")
    answers = translate.Answers("file://" + str(tmp_path / "answers"))

    def flaky(system, user):
        with open(calls, "a") as file:
            file.write(user.replace("\n", "/") + "\n")
        with open(calls) as file:
            if "once" in user and file.read().splitlines().count(user.replace("\n", "/")) == 1:
                raise ValueError("not yet")
        return user.upper()

    pages = {(1, 1): ["once.", "b."], (1, 2): ["c.", "d."], (1, 3): ["never asked.", "for"]}
    df = units_of(spark, pages).coalesce(1)
    job = translate.JobSettings(tries=3, pause=0.0, answers=answers)
    for _ in range(2):  # the second run, as a repeated task or job, makes no call
        found = translate.page_job(df, flaky, 1, 2, TextSettings(attempts=1), job)
        assert lines(found) == {(1, 1): ["ONCE.", "B."], (1, 2): ["C.", "D."]}
        assert sorted(open(calls).read().splitlines()) == ["1. c./2. d.", "1. once./2. b.", "1. once./2. b."]
    progress = translate.job_progress(translate.job_status(found)).first()
    assert tuple(progress) == (1, 2, 2, 0, 0)


def test_pauses_and_cancelling(spark, tmp_path):
    waits = str(tmp_path / "waits")

    def note(seconds):
        with open(waits, "a") as file:
            file.write(f"{seconds}\n")

    def no(system, user):
        raise ValueError("no")

    df = units_of(spark, {(1, 1): ["a.", "b."]}).coalesce(1)
    asked = translate.with_prompts(units.requests(df), TextSettings())
    got = translate.answered(asked, no, TextSettings(attempts=1), translate.JobSettings(tries=3, after=7.0, wait=note)).first()
    assert (got["status"], got["tries"], got["error"], got["replies"]) == ("failed", 3, "no", None)
    assert [float(x) for x in open(waits).read().split()] == [1.5, 3.0, 7.0]
    control = "file://" + str(tmp_path / "job")
    job = translate.JobSettings(control=control)
    assert translate.answered(asked, translate.stub, job=job).first()["status"] == "completed"
    translate.cancel(control)
    found = translate.translate_units(df, translate.stub, job=job)
    assert {(r["status"], r["final"]) for r in found.collect()} == {("cancelled", "a."), ("cancelled", "b.")}
    assert tuple(translate.job_progress(translate.job_status(found)).first()) == (1, 1, 0, 0, 1)
    assert translate.pace(2, 100) == 72 and translate.pace(0, 100) == 0.2


# --- providers ------------------------------------------------------------------------------


def test_requests_of_providers():
    hosted = translate.request_of(translate.Provider("hosted", "https://x/chat", "m", "k"), "S", 'U"')
    assert hosted["headers"]["Authorization"] == "Bearer k" and json.loads(hosted["body"]) == {"model": "m", "messages": [{"role": "system", "content": "S"}, {"role": "user", "content": 'U"'}], "max_tokens": 4096, "temperature": 0.1}
    local = translate.request_of(translate.Provider("local", "http://h:1/", "m"), "S", "U")
    assert local["url"] == "http://h:1/api/chat" and json.loads(local["body"])["stream"] is False and local["path"] == "message.content"
    custom = translate.Provider("custom", "u", "m", "k", '{"X": "{apiKey}"}', '{"p": "{systemPrompt}|{userPrompt}", "m": "{model}"}', "out[0].t")
    made = translate.request_of(custom, "a\nb", 'c"\\d')
    assert made["headers"]["X"] == "k" and json.loads(made["body"]) == {"p": 'a\nb|c"\\d', "m": "m"} and made["path"] == "out[0].t"
    for broken in (translate.Provider("hosted", "u"), translate.Provider("local", "u"), translate.Provider("custom", "u"), translate.Provider("hosted"), translate.Provider("other", "u")):
        with pytest.raises(ValueError):
            translate.request_of(broken, "s", "u")


def test_answers_of_providers():
    provider = translate.Provider("hosted", "u", "m", "k")

    def reply(status, body):
        return translate.provider_translator(provider, lambda request: (status, body))

    assert reply(200, '{"choices": [{"message": {"content": " hi \\n"}}]}')("s", "u") == "hi"
    assert translate.call(reply(200, "{}"), "s", "the input") == "the input"
    for status, body in ((429, "slow down"), (500, '{"error": {"message": "Rate Limit hit"}}')):
        with pytest.raises(translate.RateLimited):
            reply(status, body)("s", "u")
    with pytest.raises(RuntimeError):
        reply(500, "broken")("s", "u")
    tries = []

    def late(request):
        tries.append(1)
        raise TimeoutError

    with pytest.raises(TimeoutError):
        translate.call(translate.provider_translator(provider, late), "s", "u")
    assert len(tries) == 1
    assert translate.value_at({"a": [{"b": 3}]}, "a[0].b") == 3 and translate.value_at({"a": []}, "a[0].b") is None and translate.value_at(None, "a") is None


# --- settings -------------------------------------------------------------------------------


def test_stored_settings():
    assert len(STORED_LAYOUT) == 57 and layout_settings(None) == LayoutSettings()
    own = layout_settings({"pmStackedMergeAlignTol": 3.5, "maxIterMerges": 2, "unknown": 1})
    assert own.stack_align == 3.5 and own.max_rounds == 2 and own.merge_align == 2.0
    assert text_settings({"maxBatchChars": 9, "storageLocation": "/a//b"}) == TextSettings(budget=9, folder="a/b/")
    assert [normal_folder(x) for x in ("/", ".", "..", "", " a ")] == ["", "", "", "", "a/"]


def test_languages_and_presets(spark):
    names = dict(viewer.target_languages())
    assert "auto" not in names and len(names) == 37
    stored = spark.createDataFrame([("a", "n", "s", "d", "e")], "id string, name string, settings string, created_at string, updated_at string")
    assert viewer.preset(stored, "a").count() == 1 and viewer.preset(stored, "b").count() == 0


# --- units and regions ----------------------------------------------------------------------


def slow_html(spans):
    rows = defaultdict(list)
    for x in spans:
        text = x["text"].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#039;")
        text = f"<b>{text}</b>" if x["weight"] >= 700 else text
        rows[int(x["top"] + 0.5)].append((x["left"], x["id"], f"<i>{text}</i>" if x["style"] == "italic" else text))
    return "<br>".join(" ".join(t for *_, t in sorted(rows[y])) for y in sorted(rows))


def slow_units(spans, budget):
    own = {x["id"]: x for x in spans}
    out = []
    for p, ids in enumerate(slow_layout.layout(spans)):
        parts = [(f"para-{p}", [own[i] for i in ids])]
        if len(slow_html(parts[0][1])) > budget:
            sentences = [[]]
            for x in sorted(parts[0][1], key=lambda x: (x["top"] // 5, x["left"], x["id"])):
                sentences[-1].append(x)
                if x["text"].rstrip()[-1:] in (".", "?", "!") and x["text"].strip():
                    sentences.append([])
            parts = [(f"para-{p}-sent-{k}", x) for k, x in enumerate(sentences) if x]
        out += [(name, slow_html(x), min(s["left"] for s in x), max(s["bottom"] for s in x), [s["size"] for s in x]) for name, x in parts if len(slow_html(x)) > 5]
    return out


def test_units_of_made_pages(spark):
    rng = random.Random(3)
    pages = made_pages()
    for spans in pages:
        for x in spans:
            x["text"] += rng.choice(("", "", ".", "?", " <&'\""))
    df = spark.createDataFrame([r for doc, spans in enumerate(pages) for r in as_rows(doc, spans)], SCHEMA).repartition(3)
    got = defaultdict(list)
    for r in units.page_units(df, PAGE, budget=120).orderBy("doc_id", "page", "ord").collect():
        got[r["doc_id"]].append((r["unit_id"], r["text"], r["left"], r["bottom"], r["font_sizes"]))
        assert r["font_family"] in ("Serif", "STIX Math")
    valid = {(r["doc_id"], r["span_id"]) for r in S.valid_spans(df).collect()}
    for doc, spans in enumerate(pages):
        want = slow_units([x for x in spans if (doc, x["id"]) in valid], 120)
        assert [x[:4] for x in got[doc]] == [x[:4] for x in want] and [sorted(x[4]) for x in got[doc]] == [sorted(x[4]) for x in want], doc
    assert any("-sent-" in x[0] for v in got.values() for x in v)


def test_families_of_span_sets(spark):
    spans = [span(0, 10, 10, 50, 10, family="sans-serif"), span(1, 10, 30, 50, 10, size=0, family="'My Font', serif"), span(2, 10, 50, 50, 10, family="Other"), span(3, 300, 10, 20, 10, family="")]
    df = spark.createDataFrame(as_rows(1, spans), SCHEMA)
    whole = layout.span_set(df.filter("span_id < 3"), "doc_id", page=Page(5.0, 5.0, 605.0, 705.0)).first()
    assert (whole["font_family"], whole["left"], whole["top"], whole["bottom"], whole["font_sizes"], whole["n_spans"]) == ("My Font", 5.0, 5.0, 55.0, [10.0, 12.0, 10.0], 3)
    assert whole["avg_font_size"] == pytest.approx(32 / 3)
    assert layout.span_set(df.filter("span_id = 3"), "doc_id").first()["font_family"] == "sans-serif"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_regions(spark):
    spans = S.spans_of(table(spark, DATA, "documents")).filter("doc_id < 12")
    chosen = spans.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(0.0).alias("sel_left"), F.lit(100.0).alias("sel_top"), F.lit(612.0).alias("sel_right"), F.lit(220.0).alias("sel_bottom"))
    found = units.page_units(viewer.select_spans(spans, chosen), PAGE)
    fresh = translate.region_items(translate.translate_units(found, translate.stub, carry=translate.BOX), 612.0, 792.0, 2.0)
    by_page = defaultdict(list)
    for r in S.valid_spans(spans).filter("bottom >= 100 and top <= 220").collect():
        by_page[r["doc_id"], r["page"]].append({"id": r["span_id"], "size": r["font_size"], "family": r["font_family"], "style": r["font_style"], "weight": r["font_weight"], "rgb": (0, 0, 0), **{c: r[c] for c in ("text", "left", "top", "right", "bottom")}})
    want = {(*key, k): (html, html.replace("th", "z"), round(left / 612, 9), sorted(s / 2 for s in sizes)) for key, own in by_page.items() for k, (_, html, left, _, sizes) in enumerate(slow_units(own, 7500))}
    got = {(r["doc_id"], r["page"], r["ord"]): (r["text_content"], r["translated_text"], round(r["rel_left"], 9), sorted(r["original_font_sizes"])) for r in fresh.collect()}
    assert got == want and len(got) > 10
    clicks = chosen.withColumn("sel_right", F.lit(5.0))
    assert viewer.select_spans(spans, clicks).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_spans_tell_the_selection_of_their_page(spark):
    """One selection a page, no join: the same spans."""
    spans = S.spans_of(table(spark, DATA, "documents")).filter("doc_id < 12")
    own = G.Rect(40.0 + F.col("doc_id"), 50.0 + F.col("page"), 40.0 + F.col("doc_id") * 4, F.lit(170.0))
    drawn = spans.select("doc_id", "page", *[getattr(own, c).alias(f"sel_{c}") for c in ("left", "top", "right", "bottom")]).distinct()
    told, joined = (sorted((r["doc_id"], r["page"], r["span_id"]) for r in x.collect()) for x in (viewer.spans_in(spans, own), viewer.select_spans(spans, drawn)))
    assert told == joined and 0 < len(told) < spans.count()
    assert viewer.spans_in(spans, G.Rect(*(F.lit(x) for x in (0.0, 100.0, 5.0, 220.0)))).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["region_job", "page_layout", "page_units", "nest_pass", "rich_lines", "selected_spans"])
def test_the_jvm_compiles_what_runs_for_each_span(spark, name):
    """A method of more than 8,000 bytes is run by the JVM's interpreter, however often it is called."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or the code is not shown
    try:
        printed = io.StringIO()
        with contextlib.redirect_stdout(printed):
            catalogue.QUERIES[name](spark, DATA).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", printed.getvalue())]
    assert sizes and max(sizes) <= 8000, sizes


def test_spans_as_before_where_texts_are_odd(spark):
    blank, ends = ["", " ", "\u00a0", "\t", "\n", "\u2028"], ["", " ", "\u00a0 ", "\n"]
    middles = ["", "1", "12", "123", "1234", "1a", "•", "-", "»", "«", "--", "h", "http", "https://a", "xhttp", "x", "é", "x=y", "a-b", "1-", "∑", "αβ", "ẋ", "5%", "−", "ₐ"]
    texts = [a + m + z for a in blank for m in middles for z in ends]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")

    def plainly(t):
        t = T.trim(F.coalesce(t, F.lit("")))
        return (F.length(t) > 0) & ~t.rlike(r"^[0-9]{1,3}$") & ~t.rlike(r"^[•\-»«]$") & ~t.startswith("http")

    t, two = F.col("t"), F.lit(2.0)
    seen = df.select("t", S.is_valid(t, two, two).alias("a"), plainly(t).alias("b"), T.is_math(t, F.lit("Serif")).alias("c"), ((F.length(F.coalesce(t, F.lit(""))) > 0) & t.rlike(MATH_CHAR)).alias("d"), T.has_operator(t).alias("e"), F.coalesce(t, F.lit("")).rlike("[=+\\-−×÷√∫∑≠≤≥≈±∞]").alias("f")).collect()
    assert [r for r in seen if r["a"] != r["b"] or r["c"] != r["d"] or r["e"] != r["f"]] == []
    assert {r["a"] for r in seen} == {r["c"] for r in seen} == {r["e"] for r in seen} == {True, False}
    number = spark.createDataFrame([(550, "550"), (None, None)], "font_weight int, as_text string")
    assert [tuple(r) for r in number.select(T.weights(number), T.weight(F.col("as_text"))).collect()] == [(550, 550), (400, 400)]


def test_colours_that_are_written_differently(spark):
    spans = [span(k, 10, 10 + 12 * k, 60, 10) for k in range(4)]
    df = spark.createDataFrame(as_rows(1, spans), SCHEMA).withColumn("color", F.element_at(F.array(*[F.lit(x) for x in ("rgb(1, 2, 3)", "#010203", "rgb(9, 2, 3)", "#ff0000")]), (F.col("span_id") + 1).cast("int")))
    assert [r["para_id"] for r in layout.initial_paragraphs(df).orderBy("span_id").collect()] == [0, 0, 0, 1]


# --- notes ----------------------------------------------------------------------------------


def test_notes_are_written_found_and_removed(spark):
    folder = fresh_path(spark, "notes")
    notes = spark.createDataFrame([("a b/one%20.translations.md", "---\npdf-source: '[[x.pdf]]'\n---\n"), ("two.translations.md", "---\npdf-source: lib/y.pdf\n---\n"), ("other.md", "none")], "note_path string, content string")
    assert store.write_notes(notes, folder) == 3 == store.write_notes(notes, folder)  # again: the same files
    read = store.read_documents(spark, folder)
    assert {r["doc"] for r in read.collect()} == {"a b/one%20.translations.md", "two.translations.md"}
    assert [r["doc"] for r in store.read_documents(spark, folder, "a b/").collect()] == ["a b/one%20.translations.md"]
    files = spark.createDataFrame([("deep/x.pdf",), ("lib/y.pdf",), ("lib/y.txt",)], "path string")
    known = store.corpus_map(read, files)
    assert {tuple(r) for r in known.collect()} == {("deep/x.pdf", "a b/one%20.translations.md"), ("lib/y.pdf", "two.translations.md")}
    assert {(r["pdf_path"], r["note_path"]) for r in store.find_notes(known, files.filter("path like 'lib%'")).collect()} == {("lib/y.pdf", "two.translations.md"), ("lib/y.txt", None)}
    assert store.find_files(known, spark.createDataFrame([("two.translations.md",)], "note_path string")).first()["pdf_path"] == "lib/y.pdf"
    store.remove_notes(spark, folder, notes.select("note_path").limit(1))
    assert store.read_documents(spark, folder).count() == 1


def test_notes_are_dealt_over_tasks(spark):
    folder = fresh_path(spark, "notes")
    rows = spark.range(300).coalesce(1).select(F.concat(F.lit("a/_"), (F.col("id") % 3).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".translations.md")).alias("note_path"), F.concat(F.col("id").cast("string"), F.lit("é")).alias("content"))
    assert store.write_notes(rows, folder) == 300
    read = store.read_documents(spark, folder)
    assert {tuple(r) for r in read.collect()} == {tuple(r) for r in rows.collect()} and read.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert sorted(os.listdir(folder.removeprefix("file://"))) == ["a"]  # no parts are left
    assert store.write_notes(rows.limit(0), fresh := fresh_path(spark, "notes")) == 0 == store.read_documents(spark, fresh).count()


def test_the_last_page_takes_its_document(spark):
    rows = spark.createDataFrame([("a", "1", 0), ("a", "2", 0), ("b", "1", 0)], "doc string, page_key string, ord int")
    left = store.delete_pages(rows, spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "9")], "doc string, page_key string"))
    assert [tuple(r) for r in left.collect()] == [("a", "2", 0)] and [r["doc"] for r in store.vanished(rows, left).collect()] == ["b"]
    saved = store.save_pages(rows, spark.createDataFrame([("a", "2", 5), ("d", "1", 0)], rows.schema))
    assert sorted(tuple(r) for r in saved.collect()) == [("a", "1", 0), ("a", "2", 5), ("b", "1", 0), ("d", "1", 0)]


def test_renamed_files_take_their_notes_along(spark):
    known = spark.createDataFrame([("l/a.pdf", "n/a.translations.md"), ("l/b.pdf", "n/b.translations.md")], "pdf_path string, note_path string")
    renames = spark.createDataFrame([("l/a.pdf", "l/z.PDF", 2), ("l/a.pdf", "l/y.pdf", 1)], "old_path string, path string, ts int")
    got = {tuple(r) for r in changes.move_notes(known, renames, "n").collect()}
    assert got == {("l/z.PDF", "n/z.translations.md", "n/a.translations.md"), ("l/b.pdf", "n/b.translations.md", "n/b.translations.md")}


# --- the store under a stream ---------------------------------------------------------------


def stored(doc, page, ord_, text, ts):
    return (doc, page, ord_, 1, text, f"{text} {ts}", 0.1, 0.1, 0.1, 0.1, 10.0, "Serif", [10.0], ts)


def put(spark, path, rows):
    df = spark.createDataFrame(rows, changes.STORE_SCHEMA.replace("ts timestamp", "ts int"))
    df.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(path)


def test_store_of_a_stream(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "store", "mark"))
    schema = spark.createDataFrame([], changes.STORE_SCHEMA).schema

    def run():
        changes.keep_store(spark.readStream.schema(schema).parquet(source), target, mark, 2).awaitTermination()

    def state():
        return sorted((r["doc"], r["page_key"], r["ord"], r["text_content"]) for r in changes.read_store(spark, target).collect())

    assert changes.read_store(spark, target).count() == 0
    # Two writes of a page in one batch: the later one counts as a whole, though it has fewer rows.
    put(spark, source, [stored("a", "1", k, "old", 1) for k in range(4)] + [stored("a", "1", k, "new", 2) for k in range(2)] + [stored("b", "1", 0, "b", 1), stored("b", "2", 0, "b2", 1)])
    run()
    first = [("a", "1", 0, "new"), ("a", "1", 1, "new"), ("b", "1", 0, "b"), ("b", "2", 0, "b2")]
    assert state() == first
    # The next batch touches one page, deletes another, and has a late write, which does not count.
    put(spark, source, [stored("b", "1", 0, "b again", 5), stored("b", "1", 1, "more", 5), stored("b", "2", 0, None, 6), stored("a", "1", 0, "late", 1)])
    run()
    second = [("a", "1", 0, "new"), ("a", "1", 1, "new"), ("b", "1", 0, "b again"), ("b", "1", 1, "more")]
    assert state() == second
    written = spark.read.schema(schema).parquet(f"{target}/parts=2/log/batch=1")
    assert {(r["doc"], r["page_key"]) for r in written.collect()} == {("b", "1"), ("b", "2"), ("a", "1")}  # nothing else is rewritten
    # A batch that is run again writes the same.
    copy = changes.keep_store(spark.readStream.schema(schema).parquet(source), str(tmp_path / "other"), str(tmp_path / "other-mark"), 2)
    copy.awaitTermination()
    assert sorted((r["doc"], r["page_key"], r["ord"], r["text_content"]) for r in changes.read_store(spark, str(tmp_path / "other")).collect()) == second
    changes.compact(spark, target)
    assert state() == second and {kind for x in changes.page_log(target).pieces(spark).values() for _, kind, _ in x} == {"tier"}
    # After compaction a late write of the page that went does not bring it back; a later one does.
    put(spark, source, [stored("b", "2", 0, "too late", 3)])
    run()
    assert state() == second
    put(spark, source, [stored("b", "2", 0, "back", 9)])
    run()
    changes.compact(spark, target)
    changes.compact(spark, target)  # deletes what the one before has replaced
    assert state() == [*second, ("b", "2", 0, "back")] and len([n for n in os.listdir(f"{target}/parts=2/log") if n.startswith("batch=")]) <= 1
