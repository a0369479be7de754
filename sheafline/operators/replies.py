"""Numbered replies: parsing, repair, fallback, reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sheafline.functions import text as T
from sheafline.schema import MISSING

_LINE = r"(?m)^\s*(\d+)\.\s+(.+?)(?:\n|$)"


def parse_numbered(raw: Column, expected: Column) -> Column:
    """Array of ``expected`` lines. Numbered lines go to their places, the last of a number wins.

    With under half of the lines found, the lines without numbers are taken: all
    of them if there are as many as expected, else as many as there are places.
    """
    numbers = F.regexp_extract_all(raw, F.lit(_LINE), F.lit(1))
    texts = F.regexp_extract_all(raw, F.lit(_LINE), F.lit(2))
    pairs = F.filter(F.arrays_zip(numbers.alias("n"), texts.alias("t")), lambda p: (F.try_to_number(p["n"], F.lit("999999999")) >= 1) & (F.try_to_number(p["n"], F.lit("999999999")) <= expected))
    places = F.when(expected > 0, F.sequence(F.lit(1), expected)).otherwise(F.array().cast("array<int>"))

    def placed(k: Column) -> Column:
        own = F.filter(pairs, lambda p: F.try_to_number(p["n"], F.lit("999999999")) == k)
        return F.when(F.size(own) > 0, T.trim(F.element_at(own, -1)["t"]))

    found = F.transform(places, placed)
    plain = F.transform(F.split(T.trim(raw), "\n"), lambda x: F.regexp_replace(T.trim(x), r"^\s*\d+\.\s*", ""))
    few = F.size(pairs) < expected * 0.5
    patched = F.transform(places, lambda k: F.coalesce(F.when(k <= F.size(plain), F.element_at(plain, k)), F.element_at(found, k)))
    chosen = F.when(few & (F.size(plain) == expected), plain).when(few, patched).otherwise(found)
    return F.transform(chosen, lambda x: F.coalesce(x, F.lit(MISSING)))


def parse_replies(replies: DataFrame, *keys: str) -> DataFrame:
    """keys, ord (from 0), line: from raw and expected."""
    return replies.select(*keys, F.posexplode(parse_numbered(F.col("raw"), F.col("expected"))).alias("ord", "line"))


def fill_missing(lines: DataFrame, *keys: str) -> DataFrame:
    """Adds final: originals where a line is missing, everywhere if over half of several are."""
    w = W.partitionBy(*keys)
    missing = F.col("line").isNull() | (F.col("line") == MISSING)
    n, gone = F.count(F.lit(1)).over(w), F.sum(missing.cast("int")).over(w)
    return lines.withColumn("final", F.when(((n > 1) & (gone > 0.5 * n)) | missing, F.col("original")).otherwise(F.col("line")))


def filled(lines: Column, line: str = "line", original: str = "original") -> Column:
    """The same for the lines of one page as an array of structs: the array of final texts."""

    def missing(x: Column) -> Column:
        return x[line].isNull() | (x[line] == MISSING)

    n = F.size(lines)
    lost = (n > 1) & (F.size(F.filter(lines, missing)) > 0.5 * n)
    return F.transform(lines, lambda x: F.when(lost | missing(x), x[original]).otherwise(x[line]))


def reassemble(lines: DataFrame, *keys: str) -> DataFrame:
    """Texts of the units of a paragraph, in order, with a space between."""
    parts = F.array_sort(F.collect_list(F.struct("ord", F.col("final").alias("t"))))
    return lines.groupBy(*keys, "paragraph_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"), F.count(F.lit(1)).alias("n_units"))


def line_counts_agree(units: DataFrame, lines: DataFrame, *keys: str) -> DataFrame:
    """Pages whose number of lines differs from their number of units."""
    a = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_units"))
    b = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"))
    return a.join(b, list(keys), "full").filter(F.coalesce("n_units", F.lit(0)) != F.coalesce("n_lines", F.lit(0)))
