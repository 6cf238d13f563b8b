"""What the vector operators share: which vectors count, and unit length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, version: str | None = "updated_at") -> DataFrame:
    """``id bigint, v array<float>``: vectors of ``dims`` finite numbers that aren't all zero, one row an id.

    Of several usable rows of an id the latest ``version`` counts. Nulls and vectors of
    another length are left out before any Python.
    """
    d = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"), *([F.col(version).alias("ver")] if version else []))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    d = d.filter(F.col("id").isNotNull() & (F.size("v") == dims) & ok)
    best = F.max_by("v", F.struct(F.col("ver"), F.hash("v"))) if version else F.max_by("v", F.hash("v"))
    return d.groupBy("id").agg(best.alias("v"))


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a float32 matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return flat.reshape(len(col), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in the precision given; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def lists(x: np.ndarray) -> pa.ListArray:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def bounded_sample(df: DataFrame, rows: int) -> np.ndarray:
    """At most ``rows`` vectors on the driver, chosen by a hash of the id, the same on every run."""
    got = df.orderBy(F.xxhash64("id"), "id").limit(rows).select("v").toArrow()
    return matrix(got.column("v")) if got.num_rows else np.empty((0, 0), np.float32)
