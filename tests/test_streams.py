"""Chains of renames, path maps and page stores kept by streams, paced and limited calls."""

import os
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.operators import translate, units
from sheafline.schema import TextSettings
from sheafline.sources import store
from sheafline.streaming import changes
from sheafline.streaming.keyedlog import KeyedLog

LOG = "old_path string, path string, ts long"
NOTES = "kind string, note_path string, link string, old_path string, path string, ts long"


# --- chains of renames ----------------------------------------------------------------------


def chains(spark, log):
    return {(r["old_path"], r["path"], r["hops"], r["replaced"]) for r in changes.rename_chains(spark.createDataFrame(log, LOG)).collect()}


def test_chains_and_names_that_come_back(spark):
    assert chains(spark, [("a", "b", 1), ("b", "c", 2)]) == {("a", "c", 2, False)}
    assert chains(spark, [("b", "a", 2), ("a", "b", 1)]) == {("a", "a", 2, False)}
    assert chains(spark, [("a", "b", 1), ("b", "a", 2), ("a", "b", 3), ("x", "y", 5)]) == {("a", "b", 3, False), ("x", "y", 1, False)}
    # Another file takes the name that became free; two files change places by a third name.
    assert chains(spark, [("a", "b", 1), ("c", "a", 2)]) == {("a", "b", 1, False), ("c", "a", 1, False)}
    assert chains(spark, [("a", "t", 1), ("b", "a", 2), ("t", "b", 3)]) == {("a", "b", 2, False), ("b", "a", 1, False)}
    # One that another file is moved onto is gone.
    assert chains(spark, [("a", "c", 1), ("b", "c", 2), ("c", "d", 3)]) == {("a", "c", 1, True), ("b", "d", 2, False)}
    assert chains(spark, [("a", "b", 1), ("a", "b", 1), ("a", "a", 2), (None, "b", 3), ("b", None, 4)]) == {("a", "b", 1, False)}
    assert chains(spark, [("a", "b", 5), ("b", "c", 5)]) == {("a", "c", 2, False)}
    assert chains(spark, []) == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_against_one_rename_after_another(spark, seed):
    rng = random.Random(seed)
    at = {k: f"f{k}" for k in range(12)}
    first, log, hops = dict(at), [], dict.fromkeys(at, 0)
    for t in range(300):
        k = rng.choice([0, 0, *at])
        free = sorted({f"f{n}" for n in range(25)} - set(at.values()))
        new = rng.choice(free)
        log.append((at[k], new, t))
        at[k], hops[k] = new, hops[k] + 1
    rng.shuffle(log)
    assert chains(spark, log) == {(first[k], at[k], hops[k], False) for k in at if hops[k]}
    # A batch after the other gives what one batch gives.
    known = spark.createDataFrame([(first[k], f"n/{k}.translations.md") for k in at] + [("other", "n/o.md")], "pdf_path string, note_path string")
    whole = {(r["pdf_path"], r["note_path"]) for r in changes.move_notes(known, spark.createDataFrame(log, LOG), "n").collect()}
    for low in (0, 100, 200):
        part = [x for x in log if low <= x[2] < low + 100]
        known = changes.move_notes(known, spark.createDataFrame(part, LOG), "n").select("pdf_path", "note_path")
    assert {tuple(r) for r in known.collect()} == whole == {(at[k], f"n/{at[k]}.translations.md" if hops[k] else f"n/{k}.translations.md") for k in at} | {("other", "n/o.md")}


def test_rounds_follow_the_digits_of_the_longest_chain(spark):
    log = [(f"p{k}", f"p{k + 1}", k) for k in range(100)]
    assert {tuple(r) for r in changes.rename_chains(spark.createDataFrame(log, LOG), most_rounds=8).select("old_path", "path", "hops").collect()} == {("p0", "p100", 100)}


def chained_rows(monkeypatch):
    """Counts of the tables that rename_chains writes while it follows chains."""
    counts, staged = [], changes.staged

    def counted(df, label):
        table = staged(df, label)
        if label == "chains":
            counts.append(table.count())
        return table

    monkeypatch.setattr(changes, "staged", counted)
    return counts


def test_long_chains_write_no_table_a_round(spark, monkeypatch):
    counts = chained_rows(monkeypatch)
    log = [(f"f{u}-{k % 3}", f"f{u}-{(k + 1) % 3}", k) for u in range(20) for k in range(100)]
    assert chains(spark, log) == {(f"f{u}-0", f"f{u}-1", 100, False) for u in range(20)}
    assert sum(counts) < len(log)  # eight rounds of all links before


def test_chains_that_run_through_many_tasks(spark, monkeypatch):
    counts = chained_rows(monkeypatch)
    monkeypatch.setattr(changes, "FEW_RUNS", 0)
    monkeypatch.setattr(changes, "CHUNK_LINKS", 1)
    rng = random.Random(5)
    names = [f"p{rng.getrandbits(40):x}" for _ in range(1201)]
    log = [(names[k], names[k + 1], k) for k in range(1200) if k % 300]  # four chains
    rng.shuffle(log)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(batch)
    try:
        spark.conf.set(batch, "4")
        assert chains(spark, log) == {(names[k + 1], names[k + 300], 299, False) for k in range(0, 1200, 300)}
    finally:
        spark.conf.set(batch, kept)
    assert len(counts) > 4 and counts[0] > 1000 and sum(counts) < 8 * len(log)  # nine rounds of all links before


def test_runs_of_a_chunk_are_put_together():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 50, 400):
        ids = rng.sample(range(10 * n + 10), n + 1)
        kept = [k for k in range(n) if rng.random() < 0.9]
        rows = [(ids[k], ids[k + 1], rng.randint(1, 5)) for k in kept]
        ring = [(-1, -2, 1), (-2, -3, 1), (-3, -1, 1), (-9, -9, 1)]
        follow, want = {a: (b, h) for a, b, h in rows}, set(ring)
        for a in set(follow) - {b for _, b, _ in rows}:
            at, hops = a, 0
            while at in follow:
                at, hops = follow[at][0], hops + follow[at][1]
            want.add((a, at, hops))
        rows += ring
        rng.shuffle(rows)
        found = changes.joined_runs(*(np.array(x, np.int64) for x in zip(*rows, strict=True)))
        assert set(zip(*(x.tolist() for x in found), strict=True)) == want and len(found[0]) == len(want)
    assert [len(x) for x in changes.joined_runs(*[np.array([], np.int64)] * 3)] == [0, 0, 0]


def test_renames_in_a_ring_at_one_time_are_refused(spark):
    with pytest.raises(RuntimeError, match="settle"):
        chains(spark, [("a", "b", 5), ("b", "a", 5), ("x", "y", 1)])


def test_files_followed_by_a_stream(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    batches = [[("u", "a", 1), ("u", "c", 3), ("v", "x", 1), (None, "q", 1)], [("u", "b", 2), ("v", None, 9)], [("u", "a", 7), ("w", "z", 1), ("u", "0", 0)]]
    for rows in batches:
        spark.createDataFrame(rows, "file string, path string, s long").select("file", "path", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("file string, path string, ts timestamp").parquet(source)
        changes.follow_files(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    found = defaultdict(list)
    for r in spark.read.parquet(out).orderBy("batch").collect():
        found[r["file"]].append((r["first_path"], r["path"], r["ts"].second, r["n_names"]))
    assert found == {"u": [("a", "c", 3, 2), ("a", "c", 3, 3), ("0", "a", 7, 5)], "v": [("x", "x", 1, 1)], "w": [("z", "z", 1, 1)]} or found["v"][-1] == ("x", "x", 1, 1)


# --- a path map by stream -------------------------------------------------------------------


def test_path_map_of_a_stream_is_that_built_anew(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "map", "mark"))
    present: set[str] = set()

    def files(session):
        return session.createDataFrame([(f,) for f in sorted(present)], "path string")

    def run(rows):
        spark.createDataFrame(rows, NOTES).coalesce(1).write.mode("append").parquet(source)
        changes.keep_path_map(spark.readStream.schema(NOTES).parquet(source), files, target, mark, "n", 4).awaitTermination()
        return {tuple(r) for r in changes.read_path_map(spark, target).collect()}

    def note(path, link, ts):
        return ("note", path, link, None, None, ts)

    present |= {"l/a.pdf", "l/b.pdf", "l/c.pdf"}
    first = run([note("n/a.translations.md", "[[l/a.pdf]]", 1), note("n/b.translations.md", "[[b.pdf|x]]", 1), note("n/b2.translations.md", "l/b.pdf", 2), note("n/x.translations.md", "[[gone.pdf]]", 1)])
    assert first == {("l/a.pdf", "n/a.translations.md"), ("l/b.pdf", "n/b2.translations.md")}
    # Notes change their link, go, and are new; of a note's rows the latest counts.
    second = run([("gone", "n/b2.translations.md", None, None, None, 5), note("n/a.translations.md", "[[l/c.pdf]]", 4), note("n/a.translations.md", "[[l/b.pdf]]", 3), note("n/x.translations.md", "[[l/a.pdf]]", 3)])
    assert second == {("l/b.pdf", "n/b.translations.md"), ("l/c.pdf", "n/a.translations.md"), ("l/a.pdf", "n/x.translations.md")}
    # Renames of files move notes, in a chain too; then a note of the same batch counts.
    present = {"l/z.pdf", "l/b.pdf", "l/c2.pdf"}
    rename = [("rename", None, None, "l/a.pdf", "l/y.pdf", 6), ("rename", None, None, "l/y.pdf", "l/z.pdf", 7), ("rename", None, None, "l/c.pdf", "l/c2.pdf", 8)]
    third = run([*rename, note("n/b.translations.md", "[[l/b.pdf]]", 9)])
    assert third == {("l/z.pdf", "n/z.translations.md"), ("l/b.pdf", "n/b.translations.md"), ("l/c2.pdf", "n/c2.translations.md")}
    # What a build of the notes as they are now gives.
    now = spark.createDataFrame([("n/z.translations.md", "l/z.pdf"), ("n/b.translations.md", "l/b.pdf"), ("n/c2.translations.md", "[[c2.pdf]]")], "note_path string, link string")
    assert {tuple(r) for r in store.path_map(now, files(spark)).collect()} == third
    # A batch writes what it changes; folding the log changes nothing; a batch that is applied again neither.
    log = changes._map_log(target)
    assert spark.read.parquet(f"{target}/parts=4/log/batch=2").filter("note_path = 'n/b.translations.md'").count() == 1
    before = {tuple(r) for r in log.current(spark).select("note_path", "pdf_path").collect()}
    for name in ("2", ".2.crc"):
        os.remove(f"{mark}/commits/{name}")
    changes.keep_path_map(spark.readStream.schema(NOTES).parquet(source), files, target, mark, "n", 4).awaitTermination()
    assert {tuple(r) for r in log.current(spark).select("note_path", "pdf_path").collect()} == before
    log.compact(spark)
    assert {tuple(r) for r in changes.read_path_map(spark, target).collect()} == third


# --- pages by range -------------------------------------------------------------------------


def page(doc, number, text, ts, write=None, ord_=0):
    return (doc, str(number), ord_, number, text, text, 0.1, 0.1, 0.1, 0.1, 10.0, "Serif", [10.0], ts, write)


PAGES = changes.STORE_SCHEMA.replace("ts timestamp", "ts int") + ", write string"


def put(spark, path, rows):
    spark.createDataFrame(rows, PAGES).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(path)


def test_a_page_range_opens_the_files_it_needs(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "store", "mark"))
    schema = spark.createDataFrame([], f"{changes.STORE_SCHEMA}, write string").schema

    def run():
        changes.keep_store(spark.readStream.schema(schema).parquet(source), target, mark, 32).awaitTermination()

    put(spark, source, [page(d, n, f"{d}{n}", 1) for d in "abcdef" for n in range(1, 101)])
    run()
    put(spark, source, [page("a", n, f"new{n}", 2) for n in range(30, 41)] + [page("a", 35, None, 3)])
    run()
    wanted = spark.createDataFrame([("a", 20, 50), ("b", 1, 3), ("zz", 1, 9)], "doc string, first int, last int")

    def check():
        got = changes.read_pages(spark, target, wanted)
        assert {(r["doc"], r["page"], r["text_content"]) for r in got.collect()} == {("a", n, f"new{n}" if 30 <= n < 41 else f"a{n}") for n in range(20, 51) if n != 35} | {("b", n, f"b{n}") for n in range(1, 4)}
        everything = changes.read_store(spark, target)
        assert everything.count() == 599
        return len(got.inputFiles()), len(everything.inputFiles())

    few, all_files = check()
    assert few <= 5 * 2 and few < all_files / 3  # three runs of a, one of b, one of zz, in two batches
    # Only parts that two batches have touched are folded, the others stay as they are.
    touched = {k for k, x in changes.page_log(target).pieces(spark).items() if len(x) == 2}
    assert set(changes.compact(spark, target, 2)) == touched and 0 < len(touched) < 12
    kept = {k: x for k, x in changes.page_log(target).pieces(spark).items() if k not in touched}
    assert check()[0] <= 5 + len(touched) and all(kind == "log" for x in kept.values() for _, kind, _ in x)
    assert changes.compact(spark, target, 2) == [] and check()[1] == len(changes.page_log(target).pieces(spark))


def test_writes_of_one_time_are_not_mixed(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "store", "mark"))
    put(spark, source, [page("a", 1, "one", 1, "w1", k) for k in range(3)] + [page("a", 1, "two", 1, "w2", k) for k in range(2)] + [page("a", 1, "two", 1, "w2", 0)])
    schema = spark.createDataFrame([], f"{changes.STORE_SCHEMA}, write string").schema
    changes.keep_store(spark.readStream.schema(schema).parquet(source), target, mark, 2).awaitTermination()
    assert sorted((r["ord"], r["text_content"]) for r in changes.read_store(spark, target).collect()) == [(0, "two"), (1, "two")]


def test_a_log_of_keys(spark, tmp_path):
    log = KeyedLog(str(tmp_path / "log"), "k long, v string", ("k",), parts=3)
    assert log.current(spark).count() == 0 and log.compact(spark) == []
    rng, want = random.Random(4), {}
    for n in range(9):
        rows = {rng.randrange(20): f"{n}-{rng.random()}" for _ in range(6)}
        want |= rows
        for _ in range(2):  # a batch that is run again
            log.append(spark.createDataFrame(list(rows.items()), "k long, v string"), n)
        if n % 3 == 2:
            log.compact(spark, 2 if n < 8 else 1)
        assert {r["k"]: r["v"] for r in log.current(spark).collect()} == want
    assert {r["k"] for r in log.current(spark, log.parts_of(spark.createDataFrame([(5,)], "k long"))).collect()} >= {5} & set(want)
    other = KeyedLog(str(tmp_path / "log"), "k long, v string", ("k",), parts=50)  # the first batch fixed the parts
    assert {r["k"]: r["v"] for r in other.current(spark).collect()} == want


# --- calls ----------------------------------------------------------------------------------


def asked(spark, pages):
    rows = [(1, p, k, f"u{k}", f"par{k}", text) for p, texts in pages.items() for k, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, page int, ord int, unit_id string, paragraph_id string, text string")
    return translate.with_prompts(units.requests(df), TextSettings())


def test_the_pace_is_that_of_the_job(spark, tmp_path):
    starts = str(tmp_path / "starts")
    os.mkdir(starts)

    def note(system, user):
        with open(f"{starts}/{user.split('.')[0]}", "w") as file:
            file.write(str(time.time()))
        return user

    after, lanes, pages = 0.25, 4, 16
    got = translate.answered(asked(spark, {p: [f"p{p}."] for p in range(pages)}), note, job=translate.JobSettings(after=after, lanes=lanes))
    assert got.filter("status = 'completed'").count() == pages
    times = sorted(float(open(f"{starts}/{x}").read()) for x in os.listdir(starts))
    assert len(times) == pages and times[-1] - times[0] >= after * (pages - lanes)
    for k in range(pages - lanes - 1):  # no window of lanes pauses holds more than lanes starts, and one at its edge
        assert times[k + lanes + 1] - times[k] >= after * lanes * 0.8


def test_a_call_has_its_time(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def slow(system, user):
        with open(calls, "a") as file:
            file.write("x")
        time.sleep(5)
        return user

    began = time.time()
    got = translate.answered(asked(spark, {1: ["a."]}).coalesce(1), slow, TextSettings(timeout=0.3)).first()
    assert got["replies"] == [None] and open(calls).read() == "x" and time.time() - began < 30  # one call: no try follows a time-out
    with pytest.raises(TimeoutError):
        translate.limited(slow, "", "", 0.2)
    with pytest.raises(ValueError, match="broken"):
        translate.limited(lambda system, user: (_ for _ in ()).throw(ValueError("broken")), "", "", 5)
    assert translate.limited(lambda system, user: user + system, "b", "a", 5) == "ab"


def test_blank_answers_are_asked_again_and_not_kept(spark, tmp_path):
    calls = str(tmp_path / "calls")
    answers = translate.Answers("file://" + str(tmp_path / "answers"))

    def blank_at_first(system, user):
        with open(calls, "a") as file:
            file.write("x")
        return "  \n" if os.path.getsize(calls) < 3 else user.upper()

    job = translate.JobSettings(tries=3, pause=0.0, answers=answers)
    got = translate.answered(asked(spark, {1: ["a.", "b."]}).coalesce(1), blank_at_first, job=job).first()
    assert (got["status"], got["tries"], got["replies"]) == ("completed", 3, ["1. A.\n2. B."])
    got = translate.answered(asked(spark, {2: ["c."]}).coalesce(1), lambda system, user: " ", job=translate.JobSettings(tries=2, pause=0.0)).first()
    assert (got["status"], got["tries"]) == ("failed", 2) and "no text" in got["error"]


def test_writes_of_one_time_stay_together(spark, tmp_path):
    """Two batches of one time, each with two writes of an item: all rows stay, over a compaction too, until a later write."""
    target = str(tmp_path / "store")
    log = changes.page_log(target, 2, together=True)

    def rows(*texts, ts):
        own = spark.createDataFrame([("d", "1", 0, t, ts) for t in texts], "doc string, page_key string, ord int, text_content string, s long")
        return own.select("doc", "page_key", "ord", F.lit(1).alias("page"), "text_content", F.lit("").alias("translated_text"), *[F.lit(0.5).alias(c) for c in ("rel_left", "rel_top", "rel_width", "rel_height", "font_size")], F.lit("").alias("font_family"), F.array(F.lit(1.0)).alias("original_font_sizes"), F.timestamp_seconds("s").alias("ts"), F.lit(None).cast("string").alias("write"))

    def texts():
        return sorted(r[0] for r in changes.read_store(spark, target, together=True).select("text_content").collect())

    log.append(rows("old", ts=1), 0)
    log.append(rows("a", "b", ts=2), 1)
    log.append(rows("c", "c", ts=2), 2)
    assert texts() == ["a", "b", "c", "c"]
    changes.compact(spark, target, together=True)
    assert texts() == ["a", "b", "c", "c"]
    log.append(rows("late", ts=1), 3)
    assert texts() == ["a", "b", "c", "c"]
    log.append(rows("new", ts=3), 4)
    assert texts() == ["new"]
