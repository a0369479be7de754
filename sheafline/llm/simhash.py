"""SimHash near-dedup by anchor-point covering.

The anchors are the words of a product of perfect codes: Golay (23,12) on bits
0-22 and 23-45, Hamming (15,11) on bits 46-60. Every fingerprint is within the
covering radius (3, 3, 1) of just one anchor, its home. A fingerprint at most t
bits away from another is within radius + t of the other's home, so each is
replicated to every anchor within radius plus threshold (with the threshold
shared between the three parts: about 150 anchors), and compared at each anchor
with those at home there, on all 64 bits. No pair is missed.

Equal fingerprints are first reduced to one (map-side combined), so groups of
copies cost one row. What is compared are distinct fingerprints at one of 2**35
anchors; a crowded anchor is split by adaptive execution, as it is an
inner join on the anchor. A fingerprint has at most 2080 partners within two
bits, whatever the number of documents.

Defined cases: a null text has no words; no words give fingerprint zero, linked
like any other; under three words the whole sequence is the one shingle;
repeated rows share a component; a null doc_id is never the component's id
unless all are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.columns import column, map_batches, slices
from sheafline.llm.components import components
from sheafline.session import ship, staged

U64 = np.uint64
#: Generator polynomial of the Golay code (23,12).
GOLAY = 0b110001110101
#: For each part: first bit, bits, covering radius.
PARTS = ((0, 23, 3), (23, 23, 3), (46, 15, 1))


def fingerprints(texts: list[str | None], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if over half of the shingle hashes have it."""
    hashes: list[int] = []
    begin, digest = [], xxhash.xxh64_intdigest
    for text in texts:
        begin.append(len(hashes))
        words = text.encode().lower().split() if text else []  # of bytes: A-Z, and the six spaces
        if len(words) <= shingle:
            if words:
                hashes.append(digest(b" ".join(words), seed))
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        hashes += [digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    out = np.zeros(len(texts), U64)
    begin.append(len(hashes))
    bounds = np.array(begin)
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, bounds[filled], axis=0, dtype=np.int64)
        over = 2 * ones > np.diff(bounds)[filled][:, None]
        out[filled] = np.packbits(over, axis=1, bitorder="little").reshape(-1).view("<u8")
    return out


class Part:
    """One code of the product: error patterns by syndrome and by how far they exceed the covering radius."""

    def __init__(self, shift: int, bits: int, radius: int, threshold: int):
        self.shift, self.bits = U64(shift), bits
        if bits == 23:
            unit = []
            for k in range(bits):
                rest = 1 << k
                for j in range(bits - 1, 10, -1):
                    if rest >> j & 1:
                        rest ^= GOLAY << (j - 11)
                unit.append(rest)
        else:
            unit = list(range(1, bits + 1))  # Hamming: a bit's syndrome is its place
        n_syndromes = max(unit).bit_length()
        low, high = min(12, bits), max(0, bits - 12)
        self.low, self.high = self._table(unit[:low]), self._table(unit[low : low + high])
        self.low_bits = low
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []
        for weights in [range(radius + 1), *([radius + k] for k in range(1, threshold + 1))]:
            patterns, syndromes = [], []
            for w in weights:
                for places in combinations(range(bits), w):
                    patterns.append(sum(1 << p for p in places))
                    s = 0
                    for p in places:
                        s ^= unit[p]
                    syndromes.append(s)
            order = np.argsort(syndromes, kind="stable")
            begin = np.searchsorted(np.array(syndromes)[order], np.arange((1 << n_syndromes) + 1))
            self.lists.append((np.array(patterns, U64)[order], begin))

    @staticmethod
    def _table(unit: list[int]) -> np.ndarray:
        table = np.zeros(1, np.int64)
        for s in unit:
            table = np.concatenate([table, table ^ s])
        return table

    def words(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = prints >> self.shift & U64((1 << self.bits) - 1)
        syndrome = self.low[(own & U64((1 << self.low_bits) - 1)).astype(np.int64)] ^ self.high[(own >> U64(self.low_bits)).astype(np.int64)]
        return own, syndrome

    def expand(self, syndrome: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the fingerprint and error pattern, for all patterns of that excess."""
        patterns, begin = self.lists[excess]
        count = begin[syndrome + 1] - begin[syndrome]
        row = np.repeat(np.arange(len(syndrome)), count)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        return row, patterns[begin[syndrome][row] + inside]


@lru_cache(maxsize=2)
def parts(threshold: int) -> list[Part]:
    return [Part(*p, threshold) for p in PARTS]


def home_anchors(prints: np.ndarray, threshold: int = 2) -> np.ndarray:
    out = np.zeros(len(prints), U64)
    for part in parts(threshold):
        own, syndrome = part.words(prints)
        row, pattern = part.expand(syndrome, 0)  # the codes are perfect: one pattern each
        out |= (own[row] ^ pattern) << part.shift
    return out


def near_anchors(prints: np.ndarray, threshold: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Index of the fingerprint and anchor, for all anchors within radius plus threshold."""
    codes = parts(threshold)
    own, syndrome = zip(*(c.words(prints) for c in codes), strict=True)
    rows, anchors = [], []

    def step(k: int, left: int, row: np.ndarray, anchor: np.ndarray) -> None:
        if k == len(codes):
            rows.append(row)
            anchors.append(anchor)
            return
        for excess in range(left + 1):
            at, pattern = codes[k].expand(syndrome[k][row], excess)
            step(k + 1, left - excess, row[at], anchor[at] | (own[k][row[at]] ^ pattern) << codes[k].shift)

    step(0, threshold, np.arange(len(prints)), np.zeros(len(prints), U64))
    return np.concatenate(rows), np.concatenate(anchors)


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            prints = fingerprints(column(part, "text").to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fp long", "simhash")


def links(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """u < v: pairs of distinct fingerprints (column fp) at most ``threshold`` bits apart."""
    ship(prints.sparkSession)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = column(batch, "fp")
            yield pa.RecordBatch.from_arrays([pa.array(home_anchors(fp.to_numpy().view(U64), threshold).view(np.int64)), fp], ["anchor", "u"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = column(batch, "fp").to_numpy()
            for at in range(0, len(fp), 2000):
                own = fp[at : at + 2000]
                row, anchor = near_anchors(own.view(U64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(own[row])], ["anchor", "v"])

    home = map_batches(prints, homes, "anchor long, u long", "simhash")
    visit = map_batches(prints, visits, "anchor long, v long", "simhash")
    # A pair meets at the home of either; it is taken at the home of the smaller.
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold)
    return visit.join(home.hint("merge"), (visit["anchor"] == home["anchor"]) & near).select("u", "v")


def simhash_components(docs: DataFrame, threshold: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", own: DataFrame | None = None, more_links: DataFrame | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    ``own`` is the fingerprint table if there is one already; ``more_links`` are pairs u, v of
    its fingerprints to be linked whatever their distance.
    """
    own = staged(fingerprint_table(docs, id_col, text_col, shingle), "fingerprints") if own is None else own
    distinct = staged(own.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct-fingerprints")
    near = links(distinct.select("fp"), threshold)
    rooted = staged(components(near if more_links is None else near.union(more_links)), "roots")
    # Only linked fingerprints have a row in rooted; a root stands for itself.
    members = rooted.union(rooted.select(F.col("root").alias("node"), "root").distinct())
    named = members.join(distinct, members["node"] == distinct["fp"]).select("fp", "root", "first_doc")
    least = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    linked = named.select("fp", "root").join(least, "root").select(F.col("fp").alias("linked_fp"), "component_id")
    label = distinct.join(linked, distinct["fp"] == linked["linked_fp"], "left").select(F.col("fp").alias("label_fp"), F.coalesce("component_id", "first_doc").alias("component_id"))
    label = staged(label, "labels")
    joined = own.join(label, own["fp"] == label["label_fp"])
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
