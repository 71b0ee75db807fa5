"""Connected components of a graph given as an edge table.

Edges are first contracted inside each partition by a union-find that keeps a spanning forest, then large-star and
small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014) run until every component is
a star around its smallest node.  Each round is a partial aggregate and a join, so a hub node is pre-aggregated on the
map side and its join side can be split by adaptive execution; no component is ever gathered into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise

#: Edges held in a task before they are contracted to a forest.
CHUNK = 500_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and, for each, the smallest node of its component."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[: len(a)], inverse[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        pl, pr = parent[left], parent[right]
        apart = pl != pr
        if not apart.any():
            return nodes, nodes[parent]
        pl, pr = pl[apart], pr[apart]
        np.minimum.at(parent, np.maximum(pl, pr), np.minimum(pl, pr))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) that connect what (a, b) connect."""
    if not len(a):
        return a, b
    nodes, root = smallest_reachable(a, b)
    off = nodes != root
    return nodes[off], root[off]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= CHUNK:
            held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
            n = len(held[0][0])
    if held:
        u, v = forest(*map(np.concatenate, zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _unfinished(stars: DataFrame) -> bool:
    """Whether a node has two parents, or a parent is itself a child."""
    two = stars.groupBy("u").count().where("count > 1").select("u")
    chained = stars.join(stars.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return not two.union(chained).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reachable.

    ``edges`` has two non-null long columns.  Loops and repeated edges are harmless; an empty table gives an empty one.
    """
    a, b = (F.col(c) for c in edges.columns)
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    stars = materialise(pairs.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    while _unfinished(stars):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialise(small.union(low).distinct(), "small-star")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        stars.select(F.col("v"), F.col("v")).distinct()
    )
