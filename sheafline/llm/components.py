"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation (map-side combined) and one join on the node, which
adaptive execution splits where a node has many neighbours. Every round is
written to the shared folder; the driver sees two numbers a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.columns import column, map_batches
from sheafline.session import ship, staged


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node and least node of its component, for the edges (a, b), of all nodes but the least ones."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each batch by those of stars around its components' least nodes."""
    for batch in batches:
        a, b = (column(batch, c).to_numpy() for c in ("u", "v"))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(a, b)], ["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("low"))
    moved = down.join(least, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(least.select("u", F.col("low").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root: every node of an edge (u, v) except roots, with its component's least node.

    Loops and repeated edges do no harm; no edges give no rows.
    """
    ship(edges.sparkSession)
    edges = staged(map_batches(edges, _local_stars, "u long, v long", "components").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        edges = staged(_small_star(_large_star(edges)), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
