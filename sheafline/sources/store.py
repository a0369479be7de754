"""The versioned store of overlays: text documents in three formats, read and written as DataFrames.

Flat rows: doc, page_key, ord, page, text_content, translated_text, rel_*,
font_size, font_family, original_font_sizes, ts.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sheafline.functions import geometry as G
from sheafline.functions import text as T
from sheafline.schema import META_V1, META_V2, META_V3
from sheafline.session import dealt, place_of, put_whole, ship, staged

_META = "struct<r:struct<l:double,t:double,w:double,h:double>,page:double,ot:string,fs:double,ff:string,ofs:array<double>,sel:string,fontSize:double,fontFamily:string,originalFontSizes:array<double>>"
COLUMNS = ("doc", "page_key", "ord", "page", "text_content", "translated_text", "rel_left", "rel_top", "rel_width", "rel_height", "font_size", "font_family", "original_font_sizes", "ts")


def _names(filesystem: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Path and whether it is a folder, of what lies in a folder; on local disks one after the other."""
    if isinstance(filesystem, pafs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                yield x.path, x.is_dir()
    else:
        for x in filesystem.get_file_info(pafs.FileSelector(folder)):
            yield x.path, x.type == pafs.FileType.Directory


def read_documents(spark: SparkSession, folder: str, prefix: str = "", suffix: str = ".translations.md") -> DataFrame:
    """doc (its path below the folder), content of every note whose path begins with the prefix.

    Names don't go through the driver: a task lists the folder, others the folders in it, and the
    names are dealt over tasks that read the notes.
    """
    ship(spark)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = place_of(folder)
        for batch in batches:
            if batch.num_rows:
                yield from _batches(((path[len(root) :].lstrip("/"), is_dir) for path, is_dir in _names(filesystem, root)), "doc", "is_dir")

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = place_of(folder)

        def walk(name: str) -> Iterator[str]:
            waiting = [name]
            while waiting:
                for path, is_dir in _names(filesystem, f"{root}/{waiting.pop()}"):
                    own = path[len(root) :].lstrip("/")
                    if is_dir:
                        waiting.append(own)
                    else:
                        yield own

        def all_of() -> Iterator[str]:
            for batch in batches:
                for name, is_dir in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield from walk(name) if is_dir else (name,)

        yield from _batches(((x,) for x in all_of() if x.endswith(suffix) and x.startswith(prefix)), "doc")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = place_of(folder)

        def notes() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    with filesystem.open_input_stream(f"{root}/{name}", compression=None) as file:
                        yield name, file.read()

        yield from _batches(notes(), "doc", "raw")

    listed = spark.range(1, numPartitions=1).mapInArrow(top, "doc string, is_dir boolean")
    names = dealt(listed, "doc").mapInArrow(below, "doc string")
    return dealt(names, "doc").mapInArrow(read, "doc string, raw binary").select("doc", F.decode("raw", "UTF-8").alias("content"))


def _batches(rows: Iterable[tuple], *names: str) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most 10,000, or of some 8 MB where they end in bytes."""
    kinds = {"doc": pa.string(), "is_dir": pa.bool_(), "raw": pa.binary()}
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(held) >= 10_000 or size > 1 << 23:
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, zip(*held, strict=True), strict=True)], list(names))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, zip(*held, strict=True), strict=True)], list(names))


def write_notes(notes: DataFrame, folder: str) -> int:
    """Write each note (note_path, content) as a file below the folder, whose folders are made; how many.

    Notes are dealt over tasks by path. A repeated task only writes its files again. Notes with the same path must be one row.
    """
    ship(notes.sparkSession)
    filesystem, root = place_of(folder)
    filesystem.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = place_of(folder)
        parts = f"{root}/.parts-{uuid.uuid4().hex}"  # a task's own: tasks that make files in one folder wait for each other
        made: set[str] = set()
        try:
            for batch in batches:
                for path, content in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("note_path", "content")), strict=True):
                    place = f"{root}/{path}"
                    for own in (parts, place.rsplit("/", 1)[0]):
                        if own not in made:
                            filesystem.create_dir(own, recursive=True)
                            made.add(own)
                    put_whole(filesystem, place, (content or "").encode(), f"{parts}/part")
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])
        finally:
            if made:
                filesystem.delete_dir(parts)

    return dealt(notes.select("note_path", "content"), "note_path").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def remove_notes(spark: SparkSession, folder: str, paths: DataFrame) -> int:
    """Delete the notes (note_path) below the folder; how many rows asked for it."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if filesystem.get_file_info(f"{root}/{path}").type == pafs.FileType.File:
                    filesystem.delete_file(f"{root}/{path}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return paths.select("note_path").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def front_matter(content: Column, key: str) -> Column:
    block = F.regexp_extract(content, r"(?s)^---\n(.*?)\n---", 1)
    value = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*)$", 1)
    return F.when(F.length(value) > 0, value)


def valid_metadata(m: Column) -> Column:
    r = m["r"]
    return m.isNotNull() & r.isNotNull() & m["page"].isNotNull() & G.is_proper(r["l"], r["t"], r["w"], r["h"])


def table_cells(line: Column) -> Column:
    """Cells of a Markdown table row; escaped pipes are text."""
    inner = F.regexp_replace(line, r"^\||\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: T.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def parse(documents: DataFrame, clock: Column, compat: bool = False) -> DataFrame:
    """Rows of all items of doc, content. ``clock`` stands in for times that can't be read.

    In format 3 the text is the next non-empty line; unless ``compat``, a heading or
    another item there means that the text is empty. A repeated page heading appends in
    format 3 and begins anew in formats 1 and 2.
    """
    content = F.col("content")
    version = F.coalesce(front_matter(content, "format-version"), front_matter(content, "version"), F.lit("1")).try_cast("int")
    body = F.regexp_replace(content, r"(?s)^---\n.*?\n---\n?", "")
    lines = documents.select(
        "doc", F.coalesce(version, F.lit(1)).alias("version"), T.parse_time(F.regexp_replace(front_matter(content, "timestamp"), r"^['\"]|['\"]$", ""), clock).alias("ts"), F.posexplode(F.split(body, "\n")).alias("pos", "raw")
    )
    lines = lines.withColumn("line", T.trim(F.col("raw"))).filter(F.length("line") > 0)
    w = W.partitionBy("doc").orderBy("pos")
    heading = F.regexp_extract("line", r"(?i)^##\s+Page\s+(\d+)", 1)
    v3_meta = F.regexp_extract("line", META_V3, 1)
    marked = lines.withColumns({"heading": F.when(F.length(heading) > 0, heading), "meta3": F.when((F.col("version") >= 3) & (F.length(v3_meta) > 0), v3_meta)})
    marked = marked.withColumns(
        {
            "page_key": F.last("heading", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)),
            "heading_pos": F.last(F.when(F.col("heading").isNotNull(), F.col("pos")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)),
            "next_line": F.lead("line").over(w),
            "next_special": F.lead(F.col("heading").isNotNull() | F.col("meta3").isNotNull()).over(w),
        }
    ).filter(F.col("page_key").isNotNull() & F.col("heading").isNull())

    three = marked.filter(F.col("meta3").isNotNull()).withColumn("m", F.from_json("meta3", _META)).filter(valid_metadata(F.col("m")))
    text3 = F.col("next_line") if compat else F.when(F.coalesce("next_special", F.lit(False)), F.lit("")).otherwise(F.col("next_line"))
    rows3 = three.select(
        "doc", "page_key", "pos", F.col("m.page").cast("int").alias("page"), F.coalesce("m.ot", F.lit("")).alias("text_content"), T.from_breaks(F.coalesce(text3, F.lit(""))).alias("translated_text"),
        F.col("m.r.l").alias("rel_left"), F.col("m.r.t").alias("rel_top"), F.col("m.r.w").alias("rel_width"), F.col("m.r.h").alias("rel_height"), F.col("m.fs").alias("font_size"), F.col("m.ff").alias("font_family"), F.col("m.ofs").alias("original_font_sizes"), "ts",
    )

    old = marked.filter(F.col("version") < 3).withColumn("cells", table_cells(F.col("line"))).filter(F.size("cells") == 2)
    first = F.col("cells")[0]
    encoded, plain = F.regexp_extract(first, META_V2, 1), F.regexp_extract(first, META_V1, 1)
    old = old.withColumn("m", F.from_json(F.when(F.length(encoded) > 0, F.decode(F.try_to_binary(encoded, F.lit("base64")), "UTF-8")).when(F.length(plain) > 0, plain), _META)).filter(valid_metadata(F.col("m")))
    last = F.max("heading_pos").over(W.partitionBy("doc", "page_key"))
    old = old.withColumn("last_heading", last).filter(F.col("heading_pos") == F.col("last_heading"))
    rows12 = old.select(
        "doc", "page_key", "pos", F.col("m.page").cast("int").alias("page"), T.trim(F.regexp_replace(F.regexp_replace(first, META_V2, ""), META_V1, "")).alias("text_content"), F.replace(F.col("cells")[1], F.lit("\\n"), F.lit("\n")).alias("translated_text"),
        F.col("m.r.l").alias("rel_left"), F.col("m.r.t").alias("rel_top"), F.col("m.r.w").alias("rel_width"), F.col("m.r.h").alias("rel_height"), F.col("m.fontSize").alias("font_size"), F.col("m.fontFamily").alias("font_family"), F.col("m.originalFontSizes").alias("original_font_sizes"), "ts",
    )
    by = W.partitionBy("doc", "page_key").orderBy("pos")
    return rows3.unionByName(rows12).withColumn("ord", (F.row_number().over(by) - 1).cast("int")).select(*COLUMNS)


def generate(items: DataFrame) -> DataFrame:
    """doc, content in format 3: pages ascending, items in order, numbers rounded."""
    rect = F.struct(*[F.round(f"rel_{long}", 4).alias(short) for short, long in (("l", "left"), ("t", "top"), ("w", "width"), ("h", "height"))])
    sizes = F.when(F.size("original_font_sizes") > 0, F.transform("original_font_sizes", lambda x: F.round(x, 2)))
    family = F.when(F.length("font_family") > 0, F.col("font_family"))
    meta = F.to_json(F.struct(rect.alias("r"), F.col("page"), T.trim(F.coalesce("text_content", F.lit(""))).alias("ot"), F.round("font_size", 2).alias("fs"), family.alias("ff"), sizes.alias("ofs")))
    entry = F.concat(F.lit("%% "), meta, F.lit(" %%\n\n"), T.to_breaks(T.trim(F.coalesce("translated_text", F.lit("")))), F.lit("\n\n"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", entry.alias("e"))))
    number = F.col("page_key").cast("int")
    pages = items.groupBy("doc", "page_key").agg(F.max("ts").alias("ts"), F.array_join(F.transform(ordered, lambda x: x["e"]), "").alias("body"))
    pages = pages.withColumn("section", F.concat(F.lit("\n## Page "), number.cast("string"), F.lit("\n\n[["), F.col("doc"), F.lit("#page="), number.cast("string"), F.lit("|→ View page]]\n\n"), F.col("body")))
    sections = F.array_sort(F.collect_list(F.struct(number.alias("n"), F.col("section").alias("s"))))
    whole = pages.groupBy("doc").agg(F.max("ts").alias("ts"), F.array_join(F.transform(sections, lambda x: x["s"]), "").alias("body"))
    base = F.element_at(F.split("doc", "/"), -1)
    head = F.concat(F.lit("---\npdf-source: '[["), F.col("doc"), F.lit("]]'\ntimestamp: "), T.iso_time(F.col("ts")), F.lit("\nformat-version: 3\n---\n\n# Translations for "), T.strip_pdf(base), F.lit("\n> Last updated: "), T.iso_time(F.col("ts")), F.lit("\n\n"))
    return whole.select("doc", F.concat(head, F.col("body")).alias("content"))


def upsert_pages(stored: DataFrame, changed: DataFrame, touched: DataFrame) -> DataFrame:
    """Pages in ``touched`` (doc, page_key) are replaced by their rows in ``changed``; without rows they go."""
    keys = touched.select("doc", "page_key").distinct()
    return stored.join(keys, ["doc", "page_key"], "left_anti").unionByName(changed.join(keys, ["doc", "page_key"], "left_semi"))


def save_pages(stored: DataFrame, items: DataFrame) -> DataFrame:
    """The pages that have items take the place of the stored ones; no other page changes."""
    return upsert_pages(stored, items, items)


def delete_pages(stored: DataFrame, pages: DataFrame) -> DataFrame:
    """Without these pages; a document whose last page goes has no rows left."""
    return stored.join(pages.select("doc", "page_key").distinct(), ["doc", "page_key"], "left_anti")


def vanished(stored: DataFrame, left: DataFrame) -> DataFrame:
    """doc of the stored documents without rows in what is left: their notes are to be removed."""
    return stored.select("doc").distinct().join(left.select("doc").distinct(), "doc", "left_anti")


def read_record(notes: DataFrame, wanted: DataFrame, clock: Column) -> DataFrame:
    """Rows of the documents (doc, content) that are wanted (doc)."""
    return parse(notes.join(wanted.select("doc").distinct(), "doc", "left_semi"), clock)


#: Smallest cells of the grid: 1 / 2**10 of a page.
MOST_LEVELS = 10


def _level(size: Column) -> Column:
    """The level of a box on one axis: that of the narrowest cells that are no narrower than it."""
    return F.greatest(F.lit(-MOST_LEVELS), F.least(F.lit(MOST_LEVELS), F.floor(-F.log2(size)))).cast("int")


def _leveled(boxes: DataFrame, margin: float) -> DataFrame:
    sizes = {"x": F.greatest("rel_width", F.lit(0.0)) + 2 * margin, "y": F.greatest("rel_height", F.lit(0.0)) + 2 * margin}
    return boxes.withColumns({f"_own_{axis}": _level(size) for axis, size in sizes.items()})


def _in_cells(boxes: DataFrame, keys: tuple[str, ...], margin: float, others: dict[str, list[int]], prefix: str) -> DataFrame:
    """A row of each box for each cell that it touches, on each axis at its own level and at those coarser ones that boxes of the other side have for their own."""
    each = boxes
    for axis, low, size in (("x", "rel_left", "rel_width"), ("y", "rel_top", "rel_height")):
        own = F.col(f"_own_{axis}")
        coarser = F.filter(F.lit(others[axis]).cast("array<int>"), lambda v: v < own)
        each = each.withColumn(f"_level_{axis}", F.explode(F.concat(F.array(f"_own_{axis}"), coarser)))
        scale = F.pow(F.lit(2.0), F.col(f"_level_{axis}"))
        each = each.withColumn(f"_cell_{axis}", F.explode(F.sequence(F.floor((F.col(low) - margin) * scale), F.floor((F.col(low) + F.col(size) + margin) * scale))))
    names = [*keys, *(f"_{c}_{axis}" for axis in "xy" for c in ("level", "cell", "own")), "rel_left", "rel_top", "rel_width", "rel_height"]
    return each.select(*[F.col(c).alias(prefix + c) for c in names], *([F.col("_box")] if "_box" in boxes.columns else []))


def pairs_in_cells(old: DataFrame, new: DataFrame, *keys: str, epsilon: float = 1e-5) -> DataFrame:
    """Pairs of boxes of one page that share a cell of a grid: _box of the old one, and both boxes with o and n before their columns.

    The grid has levels on each axis, cells half as wide at each. At its own level a box is no wider
    than a cell, so it touches two on an axis; a pair meets at the coarser of its levels on either
    axis. So a line is compared with what lies near it, not with its page, and a page of a third of
    all boxes is dealt over its cells.
    """
    o, n = _leveled(old, 2 * epsilon), _leveled(new, 2 * epsilon)
    has = [{axis: [r[0] for r in side.select(f"_own_{axis}").distinct().collect()] for axis in "xy"} for side in (o, n)]  # at most 21 numbers each
    o, n = _in_cells(o, keys, 2 * epsilon, has[1], "o"), _in_cells(n, keys, 2 * epsilon, has[0], "n")
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"o{k}") == F.col(f"n{k}")
    for axis in "xy":
        level, cell, own = (f"_{c}_{axis}" for c in ("level", "cell", "own"))
        on &= (F.col(f"o{level}") == F.col(f"n{level}")) & (F.col(f"o{cell}") == F.col(f"n{cell}")) & (F.col(f"o{level}") == F.least(f"o{own}", f"n{own}"))
    return o.hint("merge").join(n.hint("merge"), on)


def replace_region(old: DataFrame, new: DataFrame, *keys: str, epsilon: float = 1e-5) -> DataFrame:
    """Old boxes that touch no new box of their page, and the new boxes.

    Old boxes are numbered (written once, so the numbers stay; new ones are written once too, as they
    are read three times), pairs come from the cells of a grid, and those that touch go by an anti join
    on the number. A box with a null touches nothing. Neither join is a broadcast: a side's size is
    judged before its boxes are dealt over cells, and all of it would lie in the driver.
    """
    numbered, new = staged(old.withColumn("_box", F.monotonically_increasing_id()), "boxes"), staged(new, "boxes")
    whole = " and ".join(f"rel_{c} is not null" for c in ("left", "top", "width", "height"))
    pairs = pairs_in_cells(numbered.filter(whole), new.filter(whole), *keys, epsilon=epsilon)

    def rect(a: str) -> G.Rect:
        return G.Rect(F.col(f"{a}rel_left"), F.col(f"{a}rel_top"), F.col(f"{a}rel_left") + F.col(f"{a}rel_width"), F.col(f"{a}rel_top") + F.col(f"{a}rel_height"))

    touched = pairs.filter(rect("o").touches(rect("n"), epsilon)).select("_box").distinct()
    return numbered.hint("merge").join(touched.hint("merge"), "_box", "left_anti").drop("_box").unionByName(new)


def renewed(boxes: DataFrame, is_new: str, *keys: str, epsilon: float = 1e-5) -> DataFrame:
    """The same for old and new boxes of one table, told apart by a column: one grouping by page, no join.

    A page's boxes meet in one row, as its spans do everywhere else.
    """
    kept = [c for c in boxes.columns if c not in keys]
    pages = boxes.groupBy(*keys).agg(F.collect_list(F.struct(*kept)).alias("all"))

    def apart(o: Column, n: Column) -> Column:
        return ~G.Rect.in_struct(o).touches(G.Rect.in_struct(n), epsilon)

    fresh = F.filter("all", lambda x: x[is_new])
    left = F.filter("all", lambda o: o[is_new] | F.forall(fresh, lambda n: apart(o, n)))
    return pages.select(*keys, F.inline(left))


def source_link(content: Column, pdf_path: Column) -> Column:
    """The note with its pdf-source pointing to the path; inserted where front matter has none."""
    line = F.concat(F.lit("pdf-source: '[["), pdf_path, F.lit("]]'"))
    has_block, has_line = content.rlike(r"(?s)^---.*?---"), F.regexp_extract(content, r"(?s)^---.*?---", 0).rlike(r"(?m)^pdf-source:")
    replaced = F.concat(F.regexp_extract(content, r"(?s)^(.*?\n)pdf-source:", 1), line, F.regexp_extract(content, r"(?s)^.*?\npdf-source:[^\n]*(.*)$", 1))
    return F.when(has_block & has_line, replaced).when(has_block, F.concat(F.lit("---\n"), line, F.substring(content, 4, 1 << 30))).otherwise(content)


def find_notes(known: DataFrame, files: DataFrame) -> DataFrame:
    """pdf_path of the files, note_path: that of a path map, null where there is none."""
    return files.select(F.col("path").alias("pdf_path")).join(known.select("pdf_path", "note_path"), "pdf_path", "left")


def find_files(known: DataFrame, notes: DataFrame) -> DataFrame:
    """note_path, pdf_path: the files of a path map that lead to these notes."""
    return notes.select("note_path").distinct().join(known.select("pdf_path", "note_path"), "note_path")


def corpus_map(notes: DataFrame, files: DataFrame) -> DataFrame:
    """The path map of notes as they are read (doc, content): their links are in the front matter."""
    return path_map(notes.select(F.col("doc").alias("note_path"), front_matter(F.col("content"), "pdf-source").alias("link")), files)


def path_map(notes: DataFrame, files: DataFrame) -> DataFrame:
    """pdf_path, note_path: the file that each note's link resolves to; the last note wins.

    notes: note_path, link; files: path.
    """
    return resolve_links(notes, files).groupBy("pdf_path").agg(F.max("note_path").alias("note_path"))


def resolve_links(notes: DataFrame, files: DataFrame) -> DataFrame:
    """note_path, pdf_path of the notes (note_path, link) whose link is a full path, else a path below the note's folder, else a file name."""
    link = T.clean_link(F.col("link"))
    folder = F.regexp_extract("note_path", "^(.*/)[^/]*$", 1)
    n = notes.filter(F.col("note_path").endswith(".md") & F.col("link").isNotNull()).select("note_path", link.alias("link"), F.concat(folder, link).alias("beside"), F.element_at(F.split(link, "/"), -1).alias("name"))
    files = files.filter(F.lower("path").endswith(".pdf"))
    named = files.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.min("path").alias("by_name"))
    full, beside = files.select(F.col("path").alias("link"), F.col("path").alias("by_link")).distinct(), files.select(F.col("path").alias("beside"), F.col("path").alias("by_folder")).distinct()
    joined = n.join(full, "link", "left").join(beside, "beside", "left").join(named, "name", "left")
    return joined.select("note_path", F.coalesce("by_link", "by_folder", "by_name").alias("pdf_path")).filter("pdf_path is not null")
