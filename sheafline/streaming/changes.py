"""Change-driven updates: debounce, latest per key, and a store that a stream keeps up to date."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.window import Window as W

from sheafline.functions import text as T
from sheafline.session import ship, staged
from sheafline.sources import store
from sheafline.streaming.keyedlog import KeyedLog

STORE_SCHEMA = "doc string, page_key string, ord int, page int, text_content string, translated_text string, rel_left double, rel_top double, rel_width double, rel_height double, font_size double, font_family string, original_font_sizes array<double>, ts timestamp"


def debounced(events: DataFrame, pause: str = "500 milliseconds", late: str = "10 seconds", *keys: str) -> DataFrame:
    """One row per burst of events without a pause; works on streams and tables."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if source.isStreaming:
        source = source.withWatermark("ts", late)
    grouped = source.groupBy(F.session_window("ts", pause).alias("burst"), *keys).agg(F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last_ts"))
    return grouped.select(*keys, F.col("burst.start").alias("first_ts"), "last_ts", "n_events")


def latest_paths(changes: DataFrame) -> DataFrame:
    """path, ts of the paths that exist after upsert, rename and delete rows (op, path, old_path, ts)."""
    gone = changes.filter(F.col("op") == "rename").select(F.col("old_path").alias("path"), "ts", F.lit(0).alias("alive"))
    own = changes.select("path", "ts", F.when(F.col("op") == "delete", 0).otherwise(1).alias("alive"))
    last = own.unionByName(gone).groupBy("path").agg(F.max(F.struct("ts", "alive")).alias("m"))
    return last.filter("m.alive = 1").select("path", F.col("m.ts").alias("ts"))


#: Links that a task puts together at once; they and what is derived from them take about 100 MB.
CHUNK_LINKS = 1 << 20
#: Fewer runs than these are followed without being dealt anew first.
FEW_RUNS = 100_000
_RUN = "node long, last long, hops long"


def joined_runs(node: np.ndarray, last: np.ndarray, hops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (from a node to a last one, hops) put together where one begins at the node that ends another; those of a ring stay as they are."""
    n = len(node)
    if n == 0:
        return node, last, hops
    order = np.argsort(node)
    node, last, hops = node[order], last[order], hops[order]
    at = np.minimum(np.searchsorted(node, last), n - 1)
    follows = node[at] == last
    first = np.ones(n, bool)
    first[at[follows]] = False
    ahead, far, total = np.where(follows, at, n), last.copy(), hops.copy()  # n: none follows
    for _ in range(n.bit_length()):
        going = np.flatnonzero(ahead < n)
        if not len(going):
            break
        over = ahead[going]
        far[going], total[going], ahead[going] = far[over], total[going] + total[over], ahead[over]
    ring = ahead < n
    return np.concatenate([node[first], node[ring]]), np.concatenate([far[first], last[ring]]), np.concatenate([total[first], hops[ring]])


def _contracted(runs: DataFrame) -> DataFrame:
    """Runs put together where a chunk of a task's rows has both; which rows are together changes how many are left, not where they lead."""
    ship(runs.sparkSession)

    def put_together(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in joined_runs(*[columns[name].to_numpy() for name in ("node", "last", "hops")])], ["node", "last", "hops"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_LINKS:
                yield put_together(held)
                held, n = [], 0
        if held:
            yield put_together(held)

    return runs.select("node", "last", "hops").mapInArrow(task, _RUN)


def _dealt_by_coins(runs: DataFrame, number: int) -> DataFrame:
    """Runs dealt so that each meets the one that follows it with a chance of one in four at least: a node's coin says whether it waits or goes to the next."""
    waits, called = [F.xxhash64(c, F.lit(number)).bitwiseAND(F.lit(1)) == side for c, side in (("node", 0), ("last", 1))]
    meeting = F.when(waits & called, F.col("last")).otherwise(F.col("node"))
    return runs.withColumn("at", meeting).repartition("at").sortWithinPartitions("at")


def rename_chains(renames: DataFrame, most_rounds: int = 60) -> DataFrame:
    """old_path, path, ts, hops, replaced: where each file that a log of renames (old_path, path, ts) begins with ends up.

    A rename takes up the one before it at its old path, if that brought a file there; one that
    leaves a path first, in the order of ``ts``, begins a chain. Of renames that leave a path one after
    another, with none that brings a file there between, the last counts. Times only grow along a
    chain, so names may come back (a to b to a); at equal times a path is reached before it is left.
    ``replaced``: another file was moved to the last path while this one was there.

    Paths are dealt by ranges, so that names of a folder are together; tasks put together what
    links they have of a chain. If many runs are left they are dealt by coins, which puts together a
    quarter of those that have a follower each time, so that all of it costs as much as a few passes over the log,
    however long its chains are. The rest is followed by pointer doubling: at most as many rounds as
    the longest chain has binary digits, each a join of what is left with itself, written to the shared folder.
    """
    log = renames.select("old_path", "path", "ts").filter("old_path is not null and path is not null and old_path <> path").distinct()
    log = staged(log.withColumn("node", F.monotonically_increasing_id()), "renames")  # written once, so the numbers stay

    def neighbours(rows: DataFrame) -> DataFrame:
        ends = rows.select(F.col("path").alias("at"), "ts", F.lit(0).alias("leaves"), "node").union(rows.select(F.col("old_path").alias("at"), "ts", F.lit(1).alias("leaves"), "node"))
        by_path = W.partitionBy("at").orderBy("ts", "leaves", "node")
        beside = [(F.lag("leaves"), "before_leaves"), (F.lag("node"), "before_node"), (F.lead("leaves"), "after_leaves")]
        return ends.repartitionByRange("at").select("at", "ts", "leaves", "node", *[c.over(by_path).alias(name) for c, name in beside])

    beside = staged(neighbours(log), "renames")
    again = beside.filter("leaves = 1 and after_leaves = 1").select("node")
    if not again.isEmpty():
        beside = staged(neighbours(staged(log.join(again, "node", "left_anti"), "renames")), "renames")
    links = beside.filter("leaves = 1 and before_leaves = 0").select(F.col("before_node").alias("node"), F.col("node").alias("last"), F.lit(1).cast("long").alias("hops"))
    heads = beside.filter("leaves = 1 and before_node is null").select("node", "at")
    ends = beside.filter("leaves = 0 and coalesce(after_leaves, 0) = 0").select(F.col("node").alias("last"), F.col("at").alias("path"), "ts", F.col("after_leaves").isNotNull().alias("replaced"))

    state = staged(_contracted(links), "chains")
    n, left, number = links.count(), state.count(), 0
    while left > max(n // 4, FEW_RUNS):
        state = staged(_contracted(_dealt_by_coins(state, number)), "chains")
        before, left, number = left, state.count(), number + 1
        if left > before - before // 16:
            break  # most runs have no follower
    for _ in range(min(most_rounds, left.bit_length() + 1)):
        further = state.select(F.col("node").alias("mid"), F.col("last").alias("further"), F.col("hops").alias("more"))
        doubled = staged(state.join(further, F.col("last") == F.col("mid"), "left").select("node", F.coalesce("further", "last").alias("last"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("more").isNotNull().alias("moved")), "chains")
        state = doubled.drop("moved")
        if doubled.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"renames did not settle in {most_rounds} rounds")
    found = heads.join(state, "node", "left").select(F.col("at").alias("old_path"), F.coalesce("last", "node").alias("last"), (F.coalesce("hops", F.lit(0)) + 1).alias("hops"))
    return found.join(ends, "last").select("old_path", "path", "ts", "hops", "replaced")


def _moved(known: DataFrame, renames: DataFrame, folder: str) -> DataFrame:
    """The path map's rows with the file's last name (null where it kept its own), the note's path by it, ts and replaced."""
    chains = rename_chains(renames).select(F.col("old_path").alias("pdf_path"), F.col("path").alias("new_path"), "ts", "replaced")
    base = F.coalesce(F.nullif(F.lit(folder), F.lit("")), F.regexp_extract("new_path", "^(.*)/[^/]*$", 1))
    return known.join(chains, "pdf_path", "left").withColumn("new_note", T.note_path(base, F.col("new_path")))


def move_notes(known: DataFrame, renames: DataFrame, folder: str = "") -> DataFrame:
    """A path map after files were renamed (old_path, path, ts): a file's note moves to the path that its last name gives.

    Chains of renames are followed (rename_chains). Of two files at one path the one that was moved
    there last keeps it; a file that was replaced and its note leave the map.
    """
    placed = _moved(known, renames, folder).select(F.coalesce("new_path", "pdf_path").alias("pdf_path"), F.coalesce("new_note", "note_path").alias("note_path"), F.col("note_path").alias("old_note_path"), "ts", "replaced")
    last = placed.groupBy("pdf_path").agg(F.max(F.struct(F.col("ts").isNotNull().alias("moved"), "ts", "note_path", "old_note_path", "replaced")).alias("m"))
    return last.filter("not coalesce(m.replaced, false)").select("pdf_path", "m.note_path", "m.old_note_path")


_FOLLOWED = "file string, first_path string, path string, ts timestamp, n_names long"


def follow_files(changes: DataFrame) -> DataFrame:
    """A stream of names (file, path, ts) by a file's own id: its first and latest path, and how many rows gave it one.

    One small state a file, whatever the order in which names arrive: the path of the latest ``ts`` counts, of equal times the greater path.
    """

    def follow(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first_ts, first, last_ts, last, n = state.get if state.exists else (None, None, None, None, 0)
        for rows in batches:
            for path, ts in zip(rows["path"], rows["us"], strict=True):
                if pd.isna(path) or pd.isna(ts):
                    continue
                at, n = (int(ts), path), n + 1
                if first_ts is None or at < (first_ts, first):
                    first_ts, first = at
                if last_ts is None or at > (last_ts, last):
                    last_ts, last = at
        state.update((first_ts, first, last_ts, last, n))
        if n:
            yield pd.DataFrame({"file": [key[0]], "first_path": [first], "path": [last], "ts": [pd.Timestamp(last_ts, unit="us")], "n_names": [n]})

    rows = changes.select(F.col("file").cast("string").alias("file"), "path", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).filter("file is not null")
    return rows.groupBy("file").applyInPandasWithState(follow, _FOLLOWED, "first_us long, first string, last_us long, last string, n long", "update", "NoTimeout")


def drop_notes(known: DataFrame, gone: DataFrame) -> DataFrame:
    """A path map without the notes (note_path) that were deleted or renamed."""
    return known.join(gone.select("note_path").distinct(), "note_path", "left_anti").select("pdf_path", "note_path")


# --- a path map kept by a stream --------------------------------------------------------------


def _map_log(folder: str, parts: int = 64) -> KeyedLog:
    return KeyedLog(folder, "note_path string, pdf_path string", ("note_path",), parts=parts)


def keep_path_map(changes: DataFrame, files: Callable[[SparkSession], DataFrame], folder: str, checkpoint: str, notes_folder: str = "", parts: int = 64) -> StreamingQuery:
    """Keep a path map below ``folder`` by a stream of what happened: kind, note_path, link, old_path, path, ts.

    A row says that a note was written with a link (kind note), that a note went (gone) or that a
    file got another name (rename). Of a batch renames count first, then the latest row of each note.
    ``files`` gives the files (path) there are when a batch is applied: links are resolved among them.
    A batch writes the notes that it changes, no others; one that is run again writes the same.
    """
    log = _map_log(folder, parts)

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = staged(batch.select("kind", "note_path", "link", "old_path", "path", "ts"), "changes")
        known = log.current(spark, before=number).drop("_batch").filter("pdf_path is not null")
        placed = staged(_moved(known, rows.filter("kind = 'rename'"), notes_folder), "moved")
        arrived = placed.filter("new_path is not null and not replaced").select(F.col("new_note").alias("note_path"), F.col("new_path").alias("pdf_path"))
        stale = placed.join(arrived.select(F.col("pdf_path").alias("taken")).distinct(), F.col("pdf_path") == F.col("taken"), "left").filter("new_path is not null or taken is not null")
        left = stale.select("note_path").distinct().join(arrived, "note_path", "left_anti").withColumn("pdf_path", F.lit(None).cast("string"))

        newest = W.partitionBy("note_path").orderBy(F.desc("ts"), F.desc("kind"), F.desc("link"))
        own = rows.filter("kind in ('note', 'gone') and note_path is not null").withColumn("k", F.row_number().over(newest)).filter("k = 1").select("note_path", "kind", "link")
        resolved = store.resolve_links(own.filter("kind = 'note'"), files(spark))
        own = own.select("note_path").join(resolved, "note_path", "left")
        changed = arrived.unionByName(left).join(own.select("note_path"), "note_path", "left_anti").unionByName(own)
        log.append(changed, number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_path_map(spark: SparkSession, folder: str) -> DataFrame:
    """pdf_path, note_path: of a file's notes the last by its path, as in a map built anew."""
    return _map_log(folder).current(spark).filter("pdf_path is not null").groupBy("pdf_path").agg(F.max("note_path").alias("note_path"))


# --- the store under a stream ---------------------------------------------------------------

#: Pages of one document that lie together: a range of pages reads few parts, a long document is spread over many.
RUN_PAGES = 16


def _run_of(page: Column) -> Column:
    return F.floor((F.coalesce(page.try_cast("int"), F.lit(1)) - 1) / RUN_PAGES)


def page_log(folder: str, parts: int = 64, together: bool = False) -> KeyedLog:
    """The store: a page is as its last writer left it, by ``ts``, then batch, then the write's number; with ``together`` by ``ts`` alone."""
    order = ("ts",) if together else ("ts", "_batch", "write")
    return KeyedLog(folder, f"{STORE_SCHEMA}, write string", ("doc", "page_key"), order, ("ord",), lambda parts: F.pmod(F.xxhash64("doc", _run_of(F.col("page_key"))), F.lit(parts)), parts, together)


def keep_store(changes: DataFrame, folder: str, checkpoint: str, parts: int = 64, together: bool = False) -> StreamingQuery:
    """Apply a stream of page rows (columns of the store) to a store below ``folder``.

    A page is written as a whole: of a batch's rows of a page those of the latest ``ts`` count, of
    equal times those of the greatest ``write``, if the stream has a column of that name (else they
    are one write, each item once). Rows without text_content say that the page goes. Each
    batch is one writer and writes only the pages it has, into its own folder: a repeated batch
    writes the same again. The first batch fixes the number of ``parts``.

    With ``together`` none of several writes of a page at its latest ``ts`` is the last: all their rows
    stay, those of different batches too, until a later write. Readers and ``compact`` must be told the same.
    """
    log = page_log(folder, parts, together)
    write = (F.col("write").cast("string") if "write" in changes.columns else F.lit(None).cast("string")).alias("write")

    def apply(batch: DataFrame, number: int) -> None:
        log.append(batch.select(*store.COLUMNS, write), number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_store(spark: SparkSession, folder: str, together: bool = False) -> DataFrame:
    """All pages as their last writers left them; between equal times the later batch, or all of them ``together``."""
    return page_log(folder, together=together).current(spark).filter("text_content is not null").select(*store.COLUMNS)


def read_pages(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The pages first to last of the documents wanted (doc, first, last): only the parts they lie in are opened."""
    log = page_log(folder)
    runs = wanted.select("doc", F.explode(F.sequence(_run_of(F.col("first")), _run_of(F.col("last")))).alias("run"))
    parts = log.parts_of(runs.select("doc", (F.col("run") * RUN_PAGES + 1).cast("string").alias("page_key")))
    pages = log.current(spark, parts).filter("text_content is not null").select(*store.COLUMNS)
    asked = wanted.select(F.col("doc").alias("asked_doc"), F.col("first").alias("asked_first"), F.col("last").alias("asked_last")).distinct()
    number = F.col("page_key").try_cast("int")
    return pages.join(asked, (F.col("doc") == F.col("asked_doc")) & number.between(F.col("asked_first"), F.col("asked_last")), "left_semi")


def compact(spark: SparkSession, folder: str, fan_in: int = 1, together: bool = False) -> list[int]:
    """Fold the parts that ``fan_in`` batches or more have touched since they were last folded; which parts. Times of pages that went stay, so that late rows don't bring them back."""
    return page_log(folder, together=together).compact(spark, fan_in)
