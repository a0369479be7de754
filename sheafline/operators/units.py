"""Rich text, translation units, and packing into size-bounded batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sheafline.functions import text as T
from sheafline.operators import layout, paging
from sheafline.schema import DEFAULT_FAMILY, GapSettings, LayoutSettings, Page
from sheafline.sources.spans import valid_spans

KEYS = ("doc_id", "page")
UNIT = ("ord", "unit_id", "paragraph_id", "text", "span_ids", "left", "top", "right", "bottom", "font_sizes", "font_family")


def rich_text(spans: DataFrame, *keys: str) -> DataFrame:
    """HTML of the spans of each group: lines by rounded top, spans by left; with its size and box."""
    line = F.floor(F.col("top") + 0.5)
    item = F.struct(line.alias("line"), F.col("left"), F.col("span_id"), T.tagged(F.col("text"), F.col("font_weight"), F.col("font_style")).alias("html"))
    grouped = spans.groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.avg("font_size").alias("avg_font_size"), F.array_sort(F.collect_list("span_id")).alias("span_ids")
    )
    return grouped.withColumn("html", _html(F.col("items"))).drop("items")


def sentence_groups(spans: DataFrame) -> DataFrame:
    """Adds sentence (from 0 by paragraph): a new one begins after a span that ends a sentence."""
    w = W.partitionBy(*KEYS, "para_id").orderBy(F.floor(F.col("top") / 5), "left", "span_id")
    ends = F.lag(T.ends_sentence(F.col("text")).cast("int")).over(w)
    return spans.withColumn("_cut", F.coalesce(ends, F.lit(0))).withColumn("sentence", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_cut")


def _html(items: Column) -> Column:
    """Lines of items (line, left, span_id, html) in order: the first of a line brings <br>, the others a space."""
    return F.aggregate(
        items,
        F.struct(F.lit("").alias("html"), F.lit(None).cast("long").alias("line")),
        lambda acc, x: F.struct(F.concat(acc["html"], F.when(acc["line"].isNull(), "").when(acc["line"] == x["line"], " ").otherwise("<br>"), x["html"]).alias("html"), x["line"].alias("line")),
        lambda acc: acc["html"],
    )


def translation_units(paragraphs: DataFrame, budget: int = 7500, shortest: int = 5) -> DataFrame:
    """doc_id, page, ord, unit_id, paragraph_id, text: a paragraph, or its sentences if it is over budget.

    One pass: each paragraph's spans carry their sentence, so both forms are made from one array.
    """
    line = F.floor(F.col("top") + 0.5)
    item = F.struct(line.alias("line"), F.col("left"), F.col("span_id"), T.tagged(F.col("text"), F.col("font_weight"), F.col("font_style")).alias("html"), F.col("sentence"))
    whole = sentence_groups(paragraphs).groupBy(*KEYS, "para_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("sentence").alias("last")).withColumn("html", _html(F.col("items")))
    name = F.concat(F.lit("para-"), F.col("para_id"))

    def ids(items: Column) -> Column:
        return F.array_sort(F.transform(items, lambda x: x["span_id"]))

    def sentence(k: Column) -> Column:
        own = F.filter("items", lambda x: x["sentence"] == k)
        return F.struct(k.alias("part"), F.concat(name, F.lit("-sent-"), k).alias("unit_id"), _html(own).alias("text"), ids(own).alias("span_ids"))

    one = F.array(F.struct(F.lit(0).alias("part"), name.alias("unit_id"), F.col("html").alias("text"), ids(F.col("items")).alias("span_ids")))
    parts = F.when(F.length("html") <= budget, one).otherwise(F.transform(F.sequence(F.lit(0), F.col("last")), sentence))
    units = whole.select(*KEYS, "para_id", F.explode(parts).alias("u")).filter(F.length("u.text") > shortest)
    w = W.partitionBy(*KEYS).orderBy("para_id", "u.part")
    return units.select(*KEYS, (F.row_number().over(w) - 1).alias("ord"), "u.unit_id", name.alias("paragraph_id"), "u.text", "u.span_ids")


def page_units(spans: DataFrame, page: Page, s: LayoutSettings | None = None, gaps: GapSettings | None = None, budget: int = 7500, shortest: int = 5) -> DataFrame:
    """The units of whole pages: valid spans, their layout, each paragraph's text or its sentences, in one pass over the pages.

    doc_id, page, ord, unit_id, paragraph_id, text, span_ids, and of the unit's spans left, top, right, bottom,
    font_sizes (0 or unknown counts as 12) and font_family as ``layout.span_set`` has them.
    """
    s, gaps = s or LayoutSettings(), gaps or GapSettings()
    name = F.trim(F.regexp_replace(F.element_at(F.split("font_family", ","), 1), "['\"]", ""))
    carried = {
        "html": T.tagged(F.coalesce("text", F.lit("")), T.weights(spans), F.col("font_style")),
        "ends": T.ends_sentence(F.coalesce("text", F.lit(""))),
        "size": F.when(F.col("font_size") != 0, F.col("font_size")).otherwise(12.0),
        "name": F.when((F.length("font_family") > 0) & (name != DEFAULT_FAMILY), name),
    }

    names = (*carried, "span_id")

    def run(pages: paging.Pages) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        more = {c: pages.rows.column(pages.rows.schema.get_field_index(c)).to_pylist() for c in names}
        for k, (begin, end, (profile, columns, first)) in enumerate(zip(pages.begin.tolist(), pages.end.tolist(), paging.profiles(pages, page, s, gaps), strict=True)):
            own = columns | {c: v[begin:end] for c, v in more.items()}
            ord_ = 0
            for p, spans_ in enumerate(paging.merged(profile, columns, first, s, gaps)):
                for unit_id, part in paging.unit_parts(f"para-{p}", spans_, own, budget):
                    text = paging.html_lines(part, own)
                    if len(text) > shortest:
                        rows.append((k, ord_, unit_id, f"para-{p}", text, sorted(own["span_id"][x] for x in part), *paging.span_set(part, own, page, DEFAULT_FAMILY)))
                        ord_ += 1
        number, *rest = zip(*rows, strict=True) if rows else [()] * 12
        kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), *(pa.float64(),) * 4, pa.list_(pa.float64()), pa.string())
        of = pa.array(number, pa.int64())
        yield pa.RecordBatch.from_arrays([*(pages.first(c).take(of) for c in KEYS), *(pa.array(c, t) for c, t in zip(rest, kinds, strict=True))], [*KEYS, *UNIT])

    schema = "doc_id long, page int, ord int, unit_id string, paragraph_id string, text string, span_ids array<long>, left double, top double, right double, bottom double, font_sizes array<double>, font_family string"
    return layout.by_page(layout.begun(valid_spans(spans), s, carried), run, schema)


def _chunks(units: Column, budget: int) -> Column:
    """The chunk of each of a page's units (structs with text), from 0: numbered lines up to the budget; a chunk ends at a sentence if it can.

    One fold inside the engine. If a chunk is full and its last unit ends no
    sentence, that unit moves on to the next chunk.
    """

    def line(n: Column, size: Column) -> Column:
        return F.length(n.cast("string")) + 3 + size  # "n. text\\n"

    def step(acc: Column, text: Column) -> Column:
        size = F.length(text)
        full = (acc["used"] > 0) & (acc["used"] + line(acc["n"] + 1, size) > budget)
        moves = full & (acc["n"] > 1) & ~acc["ends"]
        # After a move the chunk begins with the moved unit; if both do not fit, that one stands alone.
        alone = line(F.lit(1), acc["size"])
        both = alone + line(F.lit(2), size) <= budget
        chunk = acc["chunk"] + F.when(moves & ~both, 2).when(full, 1).otherwise(0)
        n = F.when(moves & both, 2).when(full, 1).otherwise(acc["n"] + 1)
        used = F.when(moves & both, alone + line(F.lit(2), size)).when(full, line(F.lit(1), size)).otherwise(acc["used"] + line(acc["n"] + 1, size))
        moved = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array((acc["chunk"] + 1).cast("int")))
        out = F.concat(F.when(moves, moved).otherwise(acc["out"]), F.array(chunk.cast("int")))
        return F.struct(out.alias("out"), chunk.cast("int").alias("chunk"), n.cast("int").alias("n"), used.cast("int").alias("used"), size.alias("size"), T.ends_sentence_html(text).alias("ends"))

    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("chunk"), F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(0).alias("size"), F.lit(True).alias("ends"))
    return F.aggregate(F.transform(units, lambda u: u["text"]), start, step, lambda acc: acc["out"])


def pack(units: DataFrame, budget: int = 7500, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, chunk_id, ord_in_chunk, ord of each unit."""
    pages = units.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text")))).alias("units"))
    placed = pages.select(*keys, F.explode(F.zip_with(_chunks(F.col("units"), budget), "units", lambda c, u: F.struct(c.alias("chunk"), u["ord"].alias("ord")))).alias("p"))
    w = W.partitionBy(*keys, "p.chunk").orderBy("p.ord")
    return placed.select(*keys, F.col("p.chunk").alias("chunk_id"), (F.row_number().over(w) - 1).alias("ord_in_chunk"), F.col("p.ord").alias("ord"))


def _mode(n: Column, chars: Column, budget: int, batch: bool) -> Column:
    many = F.lit(batch) & (n > 1)
    return F.when(many & (chars > budget), "chunked").when(many, "batch").otherwise("single")


def modes(units: DataFrame, budget: int = 7500, batch: bool = True, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """How each page is translated: chunked, batch, or unit by unit; ``chars`` counts the numbered lines of all its units."""
    found = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("size"))
    # Digits of 1..n: each power of ten adds one to the numbers from it on.
    digits = sum((F.greatest(F.col("n") - (10**k - 1), F.lit(0)) for k in range(10)), F.lit(0))
    return found.withColumn("chars", F.col("size") + digits + 3 * F.col("n") - 1).withColumn("mode", _mode(F.col("n"), F.col("chars"), budget, batch)).drop("size")


def requests(units: DataFrame, budget: int = 7500, batch: bool = True, keys: tuple[str, ...] = KEYS, single_limit: int = 3000, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: mode, n, and the requests in order: request text, number of lines, and the units (ord, unit_id, paragraph_id, text, what is carried) that it asks for.

    Pages of several units are sent as numbered lines, in one request or in chunks;
    other units are sent one by one, cut at ``single_limit`` characters.
    """
    item = F.struct("ord", "unit_id", "paragraph_id", F.coalesce("text", F.lit("")).alias("text"), *carry)
    pages = units.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("units"))
    n = F.size("units")

    def numbered(own: Column) -> Column:
        return F.array_join(F.transform(own, lambda u, k: F.concat((k + 1).cast("string"), F.lit(". "), u["text"])), "\n")

    pages = pages.withColumn("n", n).withColumn("mode", _mode(n, F.length(numbered(F.col("units"))), budget, batch))
    chunk = F.when(F.col("mode") == "chunked", _chunks(F.col("units"), budget)).when(F.col("mode") == "batch", F.array_repeat(F.lit(0), n)).otherwise(F.sequence(F.lit(0), n - 1))
    pages = pages.withColumn("chunk", chunk)

    def one(c: Column) -> Column:
        own = F.filter("units", lambda u, k: F.element_at("chunk", k + 1) == c)
        text = F.when(F.col("mode") == "single", T.truncate(own[0]["text"], single_limit)).otherwise(numbered(own))
        return F.struct(text.alias("request"), F.size(own).alias("expected"), own.alias("units"))

    return pages.select(*keys, "mode", "n", F.transform(F.sequence(F.lit(0), F.array_max("chunk")), one).alias("requests"))
