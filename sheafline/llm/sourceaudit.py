"""Source divergence audit by wide term vectors.

Of each language, the terms in at least ``min_docs`` of its documents are
pivoted into one row a term with an array over the language's sources. From a
group's count the array has p = 1 + floor(10**9 * (count + 5) / (N + 5V)), N
being the group's occurrences of kept terms and V their number. JVM higher-order
functions emit |p - q| for each pair of sources, which map-side aggregation sums
over all terms; the same arrays give each group's terms that stand out from the
language. All arithmetic is exact (decimals of 38 digits, then longs).

Terms are counted in numpy, some MB of text at a time, with two counters:
occurrences and documents. (In the JVM, splitting and exploding texts took four
fifths of the query's time.) The counts are combined again in the map tasks, which
leaves a frequent term one row a task and source. The audit's own tables have a
row a term or a source of a language; the one row a language that all terms need
(its sources with their N) is broadcast up to ``broadcast_bytes`` and joined by a
shuffle beyond, which adaptive execution splits. The rows of pairs are, by
the question asked, the square of the number of a language's sources.

Defined cases: a null text, language or source counts as ''; a group without
terms has N = 0 and takes part; without kept terms (V = 0) all pairs have value
0; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.llm.columns import LOWER, U64, Texts, column, map_batches, mix, slices, span_hash
from sheafline.session import ship, staged

#: The bytes of terms, in small letters: all that aren't ASCII, and letters.
IS_TERM = np.zeros(256, bool)
IS_TERM[128:] = True
IS_TERM[97:123] = True
SCALE, PRIOR = 10**9, 5


def term_counts(docs: DataFrame, slice_bytes: int = 1 << 22) -> DataFrame:
    """lang, source, term, n, d: occurrences, and documents that have the term, of each slice of the documents."""
    ship(docs.sparkSession)

    def counted(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(column(part, "text"))
        data = LOWER[texts.data]
        begin, end, row = texts.words(IS_TERM[data])
        pairs = list(zip(column(part, "lang").to_pylist(), column(part, "source").to_pylist(), strict=True))
        numbers = {x: k for k, x in enumerate(dict.fromkeys(pairs))}
        group = np.array([numbers[x] for x in pairs], U64)[row]
        keys = span_hash(texts.prefix(data), begin, end) ^ mix(group + U64(0xA0D17))
        order = np.argsort(keys, kind="stable")  # words of a document stay together
        new_key, new_row = np.ones((2, len(order)), bool)
        new_key[1:] = keys[order][1:] != keys[order][:-1]
        new_row[1:] = new_key[1:] | (row[order][1:] != row[order][:-1])
        at = np.flatnonzero(new_key)
        firsts = order[at]
        flat = data.tobytes()
        terms = [flat[a:b].decode() for a, b in zip(begin[firsts].tolist(), end[firsts].tolist(), strict=True)]
        names = list(numbers)
        own = [names[k] for k in group[firsts].tolist()]
        n = np.diff(np.append(at, len(order)))
        d = np.add.reduceat(new_row, at, dtype=np.int64) if len(at) else n
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.string()), pa.array([x[1] for x in own], pa.string()), pa.array(terms, pa.string()), pa.array(n.astype(np.int64)), pa.array(d)], ["lang", "source", "term", "n", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", slice_bytes):
            yield counted(part)

    return map_batches(docs.select("lang", "source", "text"), run, "lang string, source string, term string, n long, d long", "sourceaudit")


def term_vectors(docs: DataFrame, min_docs: int = 30) -> DataFrame:
    """lang, term, total, cells: the kept terms of each language, with their counts by source."""
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    wide = counts.groupBy("lang", "term").agg(F.sum("d").alias("docs"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("cells"))
    return wide.filter(F.col("docs") >= min_docs).select("lang", "term", "total", "cells")


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10**9 * (n + 5) / (total + 5V)), exact."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(19,0)")
    below = total.cast("decimal(20,0)") + F.lit(PRIOR).cast("decimal(1,0)") * v.cast("decimal(17,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, below).cast("long")


def source_audit(docs: DataFrame, min_docs: int = 30, most_terms: int = 50, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """lang, source, part, item, value, rank: each source against the others, and its outstanding terms."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    wide = staged(term_vectors(docs, min_docs), "terms")
    sums = wide.select("lang", F.explode("cells").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    sizes = wide.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    by_lang = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources"), F.sum("n").alias("lang_n"))
    langs = staged(by_lang.join(sizes, "lang", "left").select("lang", "sources", "lang_n", F.coalesce("v", F.lit(0)).alias("v")), "languages")

    per_lang = langs.filter("v > 0")
    size = per_lang.select(F.sum(F.octet_length("lang") + F.aggregate("sources", F.lit(64).cast("long"), lambda a, s: a + F.octet_length(s["source"]) + 32))).first()[0] or 0
    joined = wide.join(F.broadcast(per_lang) if size <= broadcast_bytes else per_lang, "lang")
    counted = F.transform("sources", lambda s: F.coalesce(F.col("cells")[s["source"]], F.lit(0)))
    vectors = joined.select("lang", "term", "v", "sources", share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"), counted.alias("counts"))
    vectors = vectors.select("lang", "term", "sources", "q", "counts", F.zip_with("sources", "counts", lambda s, n: share(n, s["n"], F.col("v"))).alias("p"))

    # Pairs: a row for each source of a term first, so that a row's array is never the square.
    first = vectors.select("lang", "p", F.posexplode("p").alias("i", "own"))
    contributions = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda x: F.abs(x - F.col("own")))
    emitted = first.filter(F.col("i") + 1 < F.size("p")).select("lang", "i", F.posexplode(contributions).alias("k", "f")).select("lang", "i", (F.col("i") + F.col("k") + 1).alias("j"), "f")
    summed = emitted.groupBy("lang", "i", "j").agg(F.sum("f").alias("f"))
    named = langs.select("lang", F.posexplode("sources").alias("i", "one"), "sources").select("lang", "i", "one", F.posexplode("sources").alias("j", "other")).filter("i <> j")
    named = named.select("lang", F.col("one.source").alias("source"), F.col("other.source").alias("item"), F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    pairs = named.join(summed, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0)).cast("long").alias("value"))

    own = vectors.select("lang", "term", "q", F.inline(F.arrays_zip("sources", "counts", "p"))).filter("counts > 0 and p > q")
    terms = own.select("lang", F.col("sources.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, terms)]
    return ranked[0].union(ranked[1].filter(F.col("rank") <= most_terms))
