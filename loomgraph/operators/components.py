"""Connected components over an edge DataFrame.

Each round first shrinks the edges inside every partition to a spanning forest
(union-find over the rows of one partition, nothing leaves it), then does one
large-star and one small-star step, which are a grouped minimum and a join.
The number of rounds grows as the logarithm of the number of nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut

EDGE = "u bigint, v bigint"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges a-b: every node that isn't the least of its component, with that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        open_ = low < high
        if not open_.any():
            break
        x, y, low, high = x[open_], y[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        u = np.concatenate([u, b.column(0).to_numpy(zero_copy_only=False)])
        v = np.concatenate([v, b.column(1).to_numpy(zero_copy_only=False)])
        if len(u) > 400_000:
            u, v = forest(u, v)
    if len(u):
        u, v = forest(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One star step; edges are kept with u > v."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u")
    if large:
        out = out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """Columns ``id`` and ``component`` (the least id joined to it), one row for each id that an edge names.

    Edges with a null end are left out, an edge from a node to itself makes that
    node a component of its own, repeated edges count once; no edges give no rows.
    Ids must be bigint.
    """
    e = edges.select(F.col(src).cast("bigint").alias("u"), F.col(dst).cast("bigint").alias("v")).filter("u is not null and v is not null")
    loops = e.filter("u = v").select(F.col("u").alias("id")).distinct()
    e = cut(e.filter("u <> v").mapInArrow(_shrink, EDGE))
    for _ in range(max_rounds):
        e = cut(_star(_star(e, True), False).mapInArrow(_shrink, EDGE))
        # A forest of stars: each non-root occurs once, and no root occurs as a child.
        n, kids = e.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if n == kids and not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").take(1):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    done = e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    return done.union(loops.join(done.select("id"), "id", "left_anti").select("id", F.col("id").alias("component")))
