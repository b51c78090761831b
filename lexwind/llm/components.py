"""Connected components: forests within tasks first, then alternating large-star and small-star steps (Kiveris et al., 2014).

Each task replaces its edges by a spanning forest, in blocks of at most HELD edges. What is left is put together in as few tasks as hold
HELD edges each and replaced by forests once more. If that is one task, its forest is the result; otherwise the stars go on from the forests.
So a small graph takes three narrow stages in place of some forty shuffled ones, and no task ever holds more than HELD edges with their forest.

In the stars only minima a node and edges are shuffled, never lists of neighbours; a node with very many edges is one row in each
aggregate, and the joins have a unique right side, so that adaptive execution can split such a node's edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwind.llm.common import cut

HELD = 1 << 17


def star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with v < u, distinct. Hang neighbours onto the smallest node of each neighbourhood."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = hung.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the roots, once, and its root: the smallest node that the edges connect it with."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low != high
        x, y, low, high = x[apart], y[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    hung = root != np.arange(len(nodes))
    return nodes[hung], nodes[root[hung]]


def forests(held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges (u, v) to forests (u, v): of all edges of a task, or of as many as have come together when they are over `held`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.int64)
        u, v, waiting, n = none, none, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return forest(*(np.concatenate(x) for x in zip((u, v), *waiting, strict=True)))

        for b in batches:
            for at in range(0, b.num_rows, held):
                part = b.slice(at, held)
                if len(u) + n + part.num_rows > held:
                    u, v = merged()
                    waiting, n = [], 0
                    if len(u) + part.num_rows > held:
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                        u, v = none, none
                waiting.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
                n += part.num_rows
        u, v = merged()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def connected_components(edges: DataFrame, held: int = HELD) -> DataFrame:
    """(node, root) for every node of an edge but the roots: the root is the component's smallest node. edges: long columns a, b."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    now = cut(now.mapInArrow(forests(held), "u long, v long"))
    tasks = -(-now.count() // held)
    now = cut(now.coalesce(max(tasks, 1)).mapInArrow(forests(held), "u long, v long"))
    if tasks > 1:
        now, seen = now.distinct(), None
        while True:
            now = cut(star(star(now, True), False))
            mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if mark == seen:
                break
            seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
