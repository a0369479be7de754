"""Numeric band join: items with all sale lines of about their price.

Cents are floor(100 * x + 0.5); a line's unit price is u = floor((2a + q) / (2q)).
An item of price p pairs with the lines of other items whose gap |u - p| is at
most 50, or a 200th of the smaller price: the closed interval
[min(p - 50, ceil(1000p / 1005)), p + max(50, floor(5p / 1000))].

How it is done: the lines of a task are folded a million at a time to one row a
unit price (their number and checksum) and its first lines, so that no price is
hot. These rows are range-partitioned by u at quantiles of the distinct prices;
each distinct item price is replicated to the ranges that its interval meets (an
interval of k cents meets at most k rows, so one or two ranges for most). Within
a range, prices and lines are merged in the order of u with a sliding window:
sums come from prefix sums between the window's ends, first pairs from two
pointers that move away from p. Partial sums and first pairs are then merged by
price and joined to the items, less an item's own lines.

An item's first pairs leave out its own lines, but the fold is made for all
items: it keeps 2k lines of a unit price, with at most k of one item, which hold
the first k of any item's other lines.

Defined cases: a line pairs with nothing if its sale_id, item_id, quantity or
amount is null, its quantity zero, or its amount not finite or 2**60 cents or
more; a null line_no comes first and counts as an empty text in the checksum. An
item without price or id has no pairs; repeated items are answered one by one;
an empty table of items gives no rows. Sums are modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.llm.columns import column, map_batches
from sheafline.session import ship, staged

NO_LINE = -(2**63)
FIELDS = ("gap", "u", "sale_id", "line_no", "line_item_id")
_PAIR = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])
_PARTIAL = T.StructType([*(T.StructField(f, T.LongType()) for f in ("p", "n", "gaps", "crcs")), T.StructField("firsts", T.ArrayType(_PAIR))])
_DEALT = "part int, kind int, a long, b long, c long, d long"
CELL, LINE, PRICE = 0, 1, 2


def cents(x: Column) -> Column:
    """floor(100x + 0.5) as long; null where it isn't below 2**60."""
    scaled = F.lit(100.0) * x.cast("double") + F.lit(0.5)
    return F.when(F.abs(scaled) < F.lit(float(2**60)), F.floor(scaled))


def lowest(p: Column) -> Column:
    return F.least(p - 50, _floor_div(F.lit(1000).cast("long") * p + 1004, F.lit(1005).cast("long")))


def highest(p: Column) -> Column:
    return p + F.greatest(F.lit(50).cast("long"), _floor_div(F.lit(5).cast("long") * p, F.lit(1000).cast("long")))


def _floor_div(n: Column, d: Column) -> Column:
    """Exact floor(n / d) of longs, d > 0."""
    rest = F.pmod(n, d)
    return F.call_function("div", n - rest, d)


def unit_prices(lines: DataFrame) -> DataFrame:
    """u, sale_id, line_no, item_id, crc of the lines that can pair."""
    sale, number, item, q = (F.col(c).cast("long") for c in ("sale_id", "line_no", "item_id", "quantity"))
    found = lines.select(sale.alias("sale_id"), number.alias("line_no"), item.alias("item_id"), q.alias("q"), cents(F.col("amount")).alias("cents"))
    found = found.filter("sale_id is not null and item_id is not null and q <> 0 and cents is not null")
    sign = F.signum("q").cast("long")
    u = _floor_div(sign * (2 * F.col("cents") + F.col("q")), sign * 2 * F.col("q"))
    text = F.concat_ws(",", F.col("sale_id").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.col("item_id").cast("string"))
    return found.select(u.alias("u"), "sale_id", "line_no", "item_id", F.crc32(text.cast("binary")).alias("crc"))


def first_lines(u: np.ndarray, sale: np.ndarray, line: np.ndarray, item: np.ndarray, k: int) -> np.ndarray:
    """Indices, in order, of the first 2k lines of each u, at most k of one item among them."""
    order = np.lexsort((item, line, sale, u))
    su, si = u[order], item[order]
    by_item = np.lexsort((si, su))  # stable: a pair's lines stay in order
    kept = order[np.sort(by_item[_rank(su[by_item], si[by_item]) < k])]
    return kept[_rank(u[kept]) < 2 * k]


def _rank(*keys: np.ndarray) -> np.ndarray:
    """The place of each entry within its run of equal keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _longs(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.asarray(column(batch, c).fill_null(NO_LINE)) for c in names]


def _rows(part: np.ndarray, kind: int, *values: np.ndarray) -> pa.RecordBatch:
    n = len(part)
    columns = [pa.array(v) for v in values] + [pa.array(np.zeros(n, np.int64))] * (4 - len(values))
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.full(n, kind, np.int32)), *columns], ["part", "kind", "a", "b", "c", "d"])


def fold(lines: DataFrame, cuts: np.ndarray, k: int, fold_rows: int) -> DataFrame:
    """Of each million lines: a row for each u, and its first lines, with the range of u."""

    def folded(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        u, sale, line, item, crc = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(u, kind="stable")
        begin = np.flatnonzero(_rank(u[order]) == 0)
        cells = u[order][begin]
        number = np.diff(np.append(begin, len(u)))
        yield _rows(np.searchsorted(cuts, cells, side="right"), CELL, cells, number, np.add.reduceat(crc[order], begin))
        at = first_lines(u, sale, line, item, k)
        yield _rows(np.searchsorted(cuts, u[at], side="right"), LINE, u[at], sale[at], line[at], item[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(_longs(batch, "u", "sale_id", "line_no", "item_id", "crc"))
                rows += batch.num_rows
            if rows >= fold_rows:
                yield from folded(held)
                held, rows = [], 0
        if held:
            yield from folded(held)

    return map_batches(lines, run, _DEALT, "bandjoin")


def replicate(prices: DataFrame, cuts: np.ndarray) -> DataFrame:
    """A row of each price (p, lo, hi) for each range that its interval meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, lo, hi = _longs(batch, "p", "lo", "hi")
            first, last = np.searchsorted(cuts, lo, side="right"), np.searchsorted(cuts, hi, side="right")
            row = np.repeat(np.arange(len(p)), last - first + 1)
            part = first[row] + _rank(row) if len(row) else row
            for at in range(0, len(row), 1 << 16):
                own = row[at : at + (1 << 16)]
                yield _rows(part[at : at + (1 << 16)], PRICE, p[own], lo[own], hi[own])

    return map_batches(prices, run, _DEALT, "bandjoin")


class Range:
    """What one range has of the lines: rows in the order of u, and first lines of each."""

    def __init__(self, k: int):
        self.k = k
        self.cells: list[tuple[np.ndarray, ...]] = []
        self.lines: list[tuple[np.ndarray, ...]] = []
        self.tail: tuple[np.ndarray, ...] | None = None
        self.u = np.zeros(0, np.int64)

    def add(self, kind: int, *values: np.ndarray) -> None:
        if kind == CELL:
            u, n, crc = values[:3]
            begin = np.flatnonzero(_rank(u) == 0)
            self.cells.append((u[begin], np.add.reduceat(n, begin), np.add.reduceat(crc, begin)))
        else:  # lines come in the order of u: only the last u can go on in the next batch
            held = values if self.tail is None else tuple(np.concatenate(x) for x in zip(self.tail, values, strict=True))
            at = first_lines(*held, self.k)
            held = tuple(v[at] for v in held)
            last = held[0] == held[0][-1]
            self.lines.append(tuple(v[~last] for v in held))
            self.tail = tuple(v[last] for v in held)

    def close(self) -> None:
        """Prefix sums over the rows and the place of each one's first lines."""
        if not self.cells:
            return
        u, n, crc = (np.concatenate(x) for x in zip(*self.cells, strict=True))
        begin = np.flatnonzero(_rank(u) == 0)
        self.u, n, crc = u[begin], np.add.reduceat(n, begin), np.add.reduceat(crc, begin)
        self.sums = np.zeros((3, len(self.u) + 1), np.int64)
        for row, values in zip(self.sums, (n, n * self.u, crc), strict=True):
            np.cumsum(values, out=row[1:])
        self.lines.append(self.tail)
        lu, *self.firsts = (np.concatenate(x) for x in zip(*self.lines, strict=True))
        self.at = np.append(np.searchsorted(lu, self.u), len(lu)).tolist()

    def answers(self, p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch | None:
        """Partial sums and first pairs of the prices whose windows hold lines."""
        begin, mid, end = np.searchsorted(self.u, lo), np.searchsorted(self.u, p), np.searchsorted(self.u, hi, side="right")
        some = np.flatnonzero(end > begin)
        if not len(some):
            return None
        p, begin, mid, end = (x[some] for x in (p, begin, mid, end))
        mid = np.clip(mid, begin, end)
        (n0, s0, c0), (n1, s1, _), (n2, s2, c2) = self.sums[:, begin], self.sums[:, mid], self.sums[:, end]
        gaps = p * (n1 - n0) - (s1 - s0) + (s2 - s1) - p * (n2 - n1)
        pairs: list[tuple[int, ...]] = []
        upto = [0]
        for own, low, at, high in zip(p.tolist(), begin.tolist(), mid.tolist(), end.tolist(), strict=True):
            self._first_pairs(own, low, at, high, pairs)
            upto.append(len(pairs))
        lists = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], names=list(FIELDS))
        return pa.RecordBatch.from_arrays([pa.array(p), pa.array(n2 - n0), pa.array(gaps), pa.array(c2 - c0), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), lists)], ["p", "n", "gaps", "crcs", "firsts"])

    def _first_pairs(self, p: int, low: int, at: int, high: int, pairs: list[tuple[int, ...]]) -> None:
        """Append the first 2k lines by (gap, u, ...), at most k of one item: two pointers leave p."""
        left, right, want = at - 1, at, len(pairs) + 2 * self.k
        of_item: dict[int, int] = {}
        while len(pairs) < want and (left >= low or right < high):
            if right >= high or left >= low and p - int(self.u[left]) <= int(self.u[right]) - p:
                cell, left = left, left - 1
            else:
                cell, right = right, right + 1
            u = int(self.u[cell])
            inside = slice(self.at[cell], self.at[cell + 1])
            for sale, line, item in zip(*(x[inside].tolist() for x in self.firsts), strict=True):
                seen = of_item.get(item, 0)
                if seen < self.k and len(pairs) < want:
                    of_item[item] = seen + 1
                    pairs.append((abs(u - p), u, sale, None if line == NO_LINE else line, item))


def window_merge(dealt: DataFrame, k: int) -> DataFrame:
    """p, n, gaps, crcs, firsts of each price and range; rows come by range, lines before prices, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found, open_ = None, Range(k), True
        for batch in batches:
            parts, kinds, a, b, c, d = (np.asarray(x) for x in batch.columns)
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)], strict=True):
                if begin == end:
                    continue
                if parts[begin] != part:
                    part, found, open_ = parts[begin], Range(k), True
                own = [x[begin:end] for x in (a, b, c, d)]
                if kinds[begin] != PRICE:
                    found.add(kinds[begin], *own)
                    continue
                if open_:
                    found.close()
                    open_ = False
                for at in range(0, end - begin, 4096):
                    answer = found.answers(*(x[at : at + 4096] for x in own[:3]))
                    if answer is not None:
                        yield answer

    return map_batches(dealt, run, _PARTIAL, "bandjoin")


def band_join(items: DataFrame, lines: DataFrame, k: int = 10, range_prices: int = 2048, most_ranges: int = 10_000, fold_rows: int = 1 << 20) -> DataFrame:
    """The first k pairs of each item, or one row of rank 0, with the sums over all its pairs.

    A range has about ``range_prices`` distinct unit prices, more where there would be over ``most_ranges``.
    """
    spark = items.sparkSession
    ship(spark)
    priced = unit_prices(lines)
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), cents(F.col("price")).alias("p"))
    known = wanted.filter("item_id is not null and p is not null").distinct()

    # Cuts at quantiles of the distinct prices: at most most_ranges numbers.
    distinct = priced.select("u").distinct()
    ranges = min(most_ranges, max(1, distinct.count() // range_prices))
    cuts = np.zeros(0, np.int64)
    if ranges > 1:
        shares = [j / ranges for j in range(1, ranges)]
        cuts = np.unique(np.array(distinct.agg(F.percentile_approx("u", shares, max(10_000, 10 * ranges))).first()[0], np.int64))

    prices = known.select("p").distinct().select("p", lowest(F.col("p")).alias("lo"), highest(F.col("p")).alias("hi"))
    rows = fold(priced, cuts, k, fold_rows).union(replicate(prices, cuts))
    dealt = rows.repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "kind", "a", "b", "c", "d")
    partial = window_merge(dealt, k)
    merged = partial.groupBy("p").agg(F.sum("n").alias("n"), F.sum("gaps").alias("gaps"), F.sum("crcs").alias("crcs"), F.slice(F.array_sort(F.flatten(F.collect_list("firsts"))), 1, 2 * k).alias("firsts"))

    merged = staged(merged, "prices")  # else the join below couldn't split a price of many items

    band = (F.col("u") >= lowest(F.col("p"))) & (F.col("u") <= highest(F.col("p")))
    own = priced.select(F.col("item_id").alias("own_id"), "u", "crc").join(known, (F.col("own_id") == F.col("item_id")) & band)
    own = own.groupBy("item_id", "p").agg(F.count(F.lit(1)).alias("own_n"), F.sum(F.abs(F.col("u") - F.col("p"))).alias("own_gaps"), F.sum("crc").alias("own_crcs"))
    own = staged(own, "own-lines")

    found = wanted.join(merged.withColumnRenamed("p", "of_p"), (F.col("p") == F.col("of_p")) & F.col("item_id").isNotNull(), "left")
    found = found.join(own.select(F.col("item_id").alias("own_id"), F.col("p").alias("own_p"), "own_n", "own_gaps", "own_crcs"), (F.col("item_id") == F.col("own_id")) & (F.col("p") == F.col("own_p")), "left")
    sums = [(F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))).cast("long").alias(name) for a, b, name in (("n", "own_n", "n_pairs"), ("gaps", "own_gaps", "gap_sum"), ("crcs", "own_crcs", "lines_crc"))]
    others = F.slice(F.filter("firsts", lambda x: x["line_item_id"] != F.col("item_id")), 1, k)
    found = found.select("item_id", F.posexplode_outer(others).alias("at", "pair"), *sums)
    return found.select("item_id", F.coalesce(F.col("at") + 1, F.lit(0)).cast("int").alias("rank"), *(F.col(f"pair.{f}").alias(f) for f in FIELDS), "n_pairs", "gap_sum", "lines_crc")
