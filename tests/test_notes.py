"""Notes as a data source: what counts when a job fails, or its driver dies."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sheafline.session import dealt
from sheafline.sources import notes

NAME = notes.Notes.name()
ROWS = "note_path string, content string"


def read(spark, folder, **options):
    return {(r["note_path"], r["content"]) for r in spark.read.format(NAME).options(**options).load(folder).collect()}


def write(spark, folder, rows, mode="append", parts=3):
    spark.createDataFrame(rows, ROWS).repartition(parts).write.format(NAME).mode(mode).save(folder)


def left(folder):
    """Files but for those that a task may leave which outlives its job; no reader looks at them."""
    found = (os.path.relpath(os.path.join(d, f), folder) for d, _, files in os.walk(folder) for f in files)
    return sorted(f for f in found if not f.startswith(notes.STAGING))


def test_notes_are_written_as_a_whole(spark, tmp_path):
    notes.register(spark)
    folder = str(tmp_path / "notes")
    old = {(f"n/{k % 3}/{k}.translations.md", f"text {k}\né") for k in range(20)}
    write(spark, folder, list(old))
    assert read(spark, folder) == old and left(folder) == sorted(n for n, _ in old)
    write(spark, folder, [("n/0/0.translations.md", "new"), ("n/x.translations.md", None), (None, "lost")])
    old = {(n, "new" if n == "n/0/0.translations.md" else c) for n, c in old} | {("n/x.translations.md", "")}
    assert read(spark, folder) == old
    assert read(spark, folder, prefix="n/1/", partition_bytes="1") == {x for x in old if x[0].startswith("n/1/")}
    assert spark.read.format(NAME).option("partition_bytes", "1").load(folder).rdd.getNumPartitions() == len(old)
    with open(f"{folder}/other.txt", "w") as file:
        file.write("no note")
    write(spark, folder, [("z.translations.md", "z")], "overwrite")
    assert read(spark, folder) == {("z.translations.md", "z")} and left(folder) == ["other.txt", "z.translations.md"]
    write(spark, folder, [("z.translations.md", "z")][:0], "append")
    assert read(spark, folder) == {("z.translations.md", "z")}


@pytest.mark.parametrize("mode", ["append", "overwrite"])
def test_a_job_that_fails_midway_leaves_the_old_notes(spark, tmp_path, mode):
    notes.register(spark)
    folder = str(tmp_path / "notes")
    write(spark, folder, [(f"{k}.translations.md", "old") for k in range(8)])
    before = left(folder)
    failing = spark.range(8).repartition(4).select(F.concat(F.col("id").cast("string"), F.lit(".translations.md")).alias("note_path"), F.when(F.col("id") == 7, F.raise_error(F.lit("midway"))).otherwise(F.lit("new")).cast("string").alias("content"))
    with pytest.raises(Exception, match="midway"):
        failing.write.format(NAME).mode(mode).save(folder)
    assert read(spark, folder) == {(f"{k}.translations.md", "old") for k in range(8)} and left(folder) == before
    with pytest.raises(Exception, match="no path of a note"):
        write(spark, folder, [("../x.translations.md", "")], mode)
    assert left(folder) == before


@pytest.mark.parametrize("overwrite", [False, True])
def test_a_driver_that_dies_while_notes_are_moved(spark, tmp_path, overwrite, monkeypatch):
    notes.register(spark)
    folder = str(tmp_path / "notes")
    write(spark, folder, [("a.translations.md", "old a"), ("b.translations.md", "old b"), ("c.translations.md", "old c")])
    writer = notes.NotesWriter({"path": folder}, overwrite)
    message = writer.write(iter([{"note_path": "a.translations.md", "content": "new a"}, {"note_path": "d/d.translations.md", "content": "new d"}]))
    old = {("a.translations.md", "old a"), ("b.translations.md", "old b"), ("c.translations.md", "old c")}
    assert read(spark, folder) == old  # nothing counts yet
    with monkeypatch.context() as m:
        m.setattr(notes, "finish", lambda *a: 0)
        m.setattr(notes.NotesWriter, "_clear", lambda *a: None)
        writer.commit([message, None])
    new = {("a.translations.md", "new a"), ("d/d.translations.md", "new d")} | (set() if overwrite else old - {("a.translations.md", "old a")})
    assert read(spark, folder) == new  # all of it counts, though no note has been moved
    staged = f"{folder}/{message.list_file.rsplit('/', 1)[0]}"
    os.replace(f"{staged}/0", f"{folder}/a.translations.md")
    assert read(spark, folder) == new  # one note has
    write(spark, folder, [("e.translations.md", "e")])  # the next job moves the rest first
    assert read(spark, folder) == new | {("e.translations.md", "e")}
    assert notes.finish(folder) == 0 and json.loads(open(f"{folder}/{message.list_file}").read()) == ["a.translations.md", "d/d.translations.md"]


def test_short_notes_are_several_partitions(spark, tmp_path):
    notes.register(spark)
    folder = str(tmp_path / "notes")
    rows = dealt(spark.range(3000).coalesce(1).select(F.concat(F.col("id").cast("string"), F.lit(".translations.md")).alias("note_path"), F.col("id").cast("string").alias("content")), "note_path")
    assert rows.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    rows.write.format(NAME).mode("overwrite").save(folder)
    assert read(spark, folder) == {(f"{k}.translations.md", str(k)) for k in range(3000)}
    assert spark.read.format(NAME).load(folder).rdd.getNumPartitions() == 2
