"""Embedding near-dedup by collision-counting projections.

Vectors of one label are linked if their cosine is at least ``threshold``. Each
unit vector is projected on ``n_projections`` orthogonal directions; two
vectors collide on one if the second lies in the window of half-width w that is
centred at the first. A pair is verified, by its cosine in double precision, if
it collides on all but ``misses`` of them. Window and count are calibrated, not
tried out: the difference of two unit vectors at the threshold has length
sqrt(2 - 2t), its share in a random direction of d has a known spread, and w is
the least multiple of it at which a pair just at the threshold passes the count
with probability ``recall`` (0.995 unless told otherwise; pairs above the
threshold pass more often).

A pair that passes misses at most ``misses`` windows, so it collides on one of
any ``misses`` + 1 projections. Only these are sorted, into cells of the
window's width: a vector is at home in its cell and visits the one below, so
every pair within a window meets in one cell. It is judged where it first
collides, so each once. Cells of over ``home_rows`` vectors are cut into chunks
by hash; a task holds one chunk (bounded) and streams what visits it, in blocks
of numpy, whatever a label's or a cell's size. It returns sums of links by
vector and spanning stars of its links, never the links themselves.

Equal vectors of a label are first reduced to one with a count (map-side
combined), so groups of copies cost one row. Work is the number of
pairs within a window on a sorted projection; for vectors without structure
in d dimensions that is a fixed share of all pairs of a label (0.4 with 64
dimensions at 0.93), which a task of c vectors a chunk reads from a shuffle of
that share of n * n / c rows.

Defined cases: a vector links with nothing if its label is null or it is null,
empty, zero or has null or non-finite components; vectors of different length don't link;
repeated rows and equal ids are vectors of their own; a null vec_id names a
component only if all of its are null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.columns import column, map_batches
from sheafline.llm.components import components, stars
from sheafline.session import ship, staged

TILE = 1024


@dataclass(frozen=True)
class Projections:
    """What decides which pairs are verified, and how large a chunk is."""

    threshold: float = 0.93
    n_projections: int = 12
    misses: int = 2
    recall: float = 0.995
    home_rows: int = 8192
    broadcast_cells: int = 200_000  # of some 60 bytes; more are joined by a shuffle
    seed: int = 20240229


@lru_cache(maxsize=8)
def half_width(own: Projections, dim: int) -> float:
    """The calibrated window: pairs at the threshold miss at most ``misses`` of the projections with probability ``recall``."""

    def passed(z: float) -> float:
        missed = 1 - erf(z / sqrt(2))
        return sum(comb(own.n_projections, k) * missed**k * (1 - missed) ** (own.n_projections - k) for k in range(own.misses + 1))

    low, high = 0.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if passed(mid) >= own.recall else (mid, high)
    return max(high * sqrt(max(2 - 2 * own.threshold, 0) / dim), 1e-6)


@lru_cache(maxsize=8)
def directions(own: Projections, dim: int) -> np.ndarray:
    """dim x n_projections: orthogonal in runs of dim, the same in every process."""
    rng, found = np.random.default_rng([own.seed, dim]), []
    while sum(x.shape[1] for x in found) < own.n_projections:
        found.append(np.linalg.qr(rng.normal(size=(dim, dim)))[0])
    return np.concatenate(found, axis=1)[:, : own.n_projections]


def _vectors(values: pa.Array) -> list[np.ndarray | None]:
    """Each list as doubles; None where it can link with nothing."""
    found: list[np.ndarray | None] = []
    for item in values:
        v = None
        if item.is_valid and len(item.values) and not item.values.null_count:
            v = np.asarray(item.values, dtype=np.float64)
            if not np.isfinite(v).all() or not v.any():
                v = None
        found.append(v)
    return found


def _packed(v: np.ndarray) -> bytes:
    """Eight bytes a component, or four where these lose nothing."""
    with np.errstate(over="ignore", under="ignore"):
        short = v.astype("<f4")
    return (short if (short == v).all() else v.astype("<f8")).tobytes()


def _unpacked(data: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(data), dim))
    for k, x in enumerate(data):
        out[k] = np.frombuffer(x, "<f4" if len(x) == 4 * dim else "<f8")
    return out


def keyed_vectors(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, key (a digest of label and vector; null if it can't link), dim, vec (its components, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = column(batch, "label")
            vectors = [None if x is None else v for x, v in zip(label.to_pylist(), _vectors(column(batch, "vec")), strict=True)]
            data = [None if v is None else (v + 0.0).astype("<f8").tobytes() for v in vectors]  # -0.0 is 0.0
            keys = [None if d is None else hashlib.blake2b(d, digest_size=16, salt=hashlib.blake2b(str(x).encode(), digest_size=16).digest()).digest() for x, d in zip(label.to_pylist(), data, strict=True)]
            packed = [None if v is None else _packed(v) for v in vectors]
            dims = [None if v is None else len(v) for v in vectors]
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), label, pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "label", "key", "dim", "vec"])

    source = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    return map_batches(source, run, "vec_id long, label string, key binary, dim int, vec binary", "vectordedup")


CELL = "label string, dim int, sorted int, cell long"


def dealt_cells(classes: DataFrame, own: Projections, homes_only: bool = False) -> DataFrame:
    """A row for each cell that a vector is at home in or visits: label, dim, sorted (which projection), cell, visits, node, n, proj, vec; or of the homes the cell alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, node, n, vec = (column(batch, c) for c in ("label", "node", "n", "vec"))
            sizes = np.asarray(column(batch, "dim"))
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                held, m = vec.take(pa.array(at)), len(at)
                projected = (unit(_unpacked(held.to_pylist(), dim)) @ directions(own, dim)).astype("<f4")
                take = [x.take(pa.array(at)) for x in (label, node, n)]
                proj = None if homes_only else pa.array([x.tobytes() for x in projected], pa.binary())
                for k in range(own.misses + 1):
                    cell = np.floor(projected[:, k] / half_width(own, dim)).astype(np.int64)
                    for visits in (0,) if homes_only else (0, 1):
                        where = [take[0], pa.array(np.full(m, dim, np.int32)), pa.array(np.full(m, k, np.int32)), pa.array(cell - visits)]
                        more = [] if homes_only else [pa.array(np.full(m, visits, np.int32)), take[1], take[2], proj, held]
                        yield pa.RecordBatch.from_arrays(where + more, ["label", "dim", "sorted", "cell", "visits", "node", "n", "proj", "vec"][: 4 + len(more)])

    return map_batches(classes, run, CELL if homes_only else f"{CELL}, visits int, node long, n long, proj binary, vec binary", "vectordedup")


def unit(values: np.ndarray) -> np.ndarray:
    scaled = values / np.abs(values).max(axis=1, keepdims=True)  # no square overflows
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Chunk:
    """The vectors at home in one chunk of a cell, against what visits it."""

    def __init__(self, own: Projections, dim: int, k: int):
        self.own, self.k, self.w = own, k, np.float32(half_width(own, dim))
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(part)

    def close(self) -> None:
        self.node, self.n, self.proj, self.vec = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.links = np.zeros(len(self.node), np.int64)

    def meet(self, node: np.ndarray, n: np.ndarray, proj: np.ndarray, vec: np.ndarray, same_cell: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Links of the visitors (summed), and both ends of stars over the links found."""
        links, ends_u, ends_v = np.zeros(len(node), np.int64), [], []
        for at in range(0, len(self.node), TILE):
            here = slice(at, at + TILE)
            v, h = self._passed(proj, self.proj[here])
            if same_cell:  # both have their home here: the pair is taken at the smaller's chunk
                later = node[v] > self.node[here][h]
                v, h = v[later], h[later]
            if not len(v):
                continue
            near = np.zeros(len(v), bool)
            for some in range(0, len(v), 1 << 16):
                part = slice(some, some + (1 << 16))
                near[part] = np.einsum("ij,ij->i", vec[v[part]], self.vec[here][h[part]]) >= self.own.threshold
            v, h = v[near], h[near] + at
            np.add.at(links, v, self.n[h])
            np.add.at(self.links, h, n[v])
            u, root = stars(node[v], self.node[h])
            ends_u.append(u)
            ends_v.append(root)
        empty = [np.zeros(0, np.int64)]
        some = np.flatnonzero(links)
        return node[some], links[some], np.concatenate(ends_u or empty), np.concatenate(ends_v or empty)

    def _passed(self, proj: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that collide on this sorted projection, on none sorted before it, and often enough on all."""
        hit = np.abs(proj[:, self.k, None] - home[None, :, self.k]) <= self.w
        v, h = np.nonzero(hit)
        missed = np.zeros(len(v), np.int8)
        for j in range(self.own.n_projections):
            if j == self.k:
                continue
            miss = np.abs(proj[v, j] - home[h, j]) > self.w
            missed += miss
            keep = missed <= self.own.misses
            if j < self.k:
                keep &= miss  # else the pair is judged there
            v, h, missed = v[keep], h[keep], missed[keep]
        return v, h


def count_links(units: DataFrame, own: Projections) -> DataFrame:
    """node, links of vectors, or u = node and v = root of stars; rows come chunk by chunk, those at home first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "root", "links"]
        key, chunk, closed = None, None, False

        def out(node: np.ndarray, root: np.ndarray | None, links: np.ndarray | None) -> pa.RecordBatch:
            nulls = pa.nulls(len(node), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(node), nulls if root is None else pa.array(root), nulls if links is None else pa.array(links)], names)

        def sums() -> Iterator[pa.RecordBatch]:
            if chunk is not None and closed:
                some = np.flatnonzero(chunk.links)
                yield out(chunk.node[some], None, chunk.links[some])

        for batch in batches:
            keys = list(zip(*(column(batch, c).to_pylist() for c in ("label", "dim", "sorted", "cell", "chunk", "role")), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                *this, role = keys[begin]
                part = batch.slice(begin, end - begin)
                if this != key:
                    yield from sums()
                    key, chunk, closed = this, Chunk(own, this[1], this[2]), False
                node, n = (np.asarray(column(part, c)) for c in ("node", "n"))
                proj = np.frombuffer(b"".join(column(part, "proj").to_pylist()), "<f4").reshape(len(node), own.n_projections)
                vec = unit(_unpacked(column(part, "vec").to_pylist(), this[1]))
                if role == 0:
                    chunk.add(node, n, proj, vec)
                    continue
                if not closed:
                    if not chunk.parts:
                        continue  # nobody is at home here
                    chunk.close()
                    closed = True
                for at in range(0, len(node), TILE):
                    own_rows = slice(at, at + TILE)
                    seen, links, u, root = chunk.meet(node[own_rows], n[own_rows], proj[own_rows], vec[own_rows], role == 1)
                    if len(seen):
                        yield out(seen, None, links)
                    if len(u):
                        yield out(u, root, None)
        yield from sums()

    return map_batches(units, run, "node long, root long, links long", "vectordedup")


def vector_links(table: DataFrame, own: Projections | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    own = own or Projections()
    spark = table.sparkSession
    ship(spark)
    rows = staged(keyed_vectors(table, id_col, vector_col, label_col), "vectors")
    grouped = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = staged(grouped.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")  # written once, so the numbers stay

    vectors = classes.select("label", "node", "n", "dim", "vec")
    where = ["label", "dim", "sorted", "cell"]
    # Cells with somebody at home; the others have no pairs. A row each, so a label has a few dozen.
    sizes = staged(dealt_cells(vectors, own, homes_only=True).groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / own.home_rows).cast("int").alias("chunks")), "cells")
    placed = dealt_cells(vectors, own).join(F.broadcast(sizes) if sizes.count() <= own.broadcast_cells else sizes, where)
    home = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    carried = [*where, "node", "n", "proj", "vec"]
    at_home = placed.filter("visits = 0").select(*carried, home.alias("chunk"), F.lit(0).alias("role"))
    visitors = placed.select(*carried, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), (F.col("visits") + 1).alias("role"))
    unit_of = [*where, "chunk"]
    units = at_home.union(visitors).repartition(*unit_of).sortWithinPartitions(*unit_of, "role")
    found = staged(count_links(units, own), "links")

    links = found.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    rooted = components(found.filter("root is not null").select(F.col("node").alias("u"), F.col("root").alias("v")))
    members = classes.select("key", "least", "n", "node").join(links, "node", "left").join(rooted.withColumnRenamed("node", "of_node"), F.col("node") == F.col("of_node"), "left")
    members = members.select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    members = staged(members, "members")
    names = members.groupBy(F.col("root").alias("of_root")).agg(F.min("least").alias("component_id"))
    named = members.join(names, F.col("root") == F.col("of_root")).select(F.col("key").alias("of_key"), "n_links", "component_id")
    joined = rows.select("vec_id", "key").join(named, F.col("key") == F.col("of_key"), "left")
    alone = F.col("of_key").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
