"""The k most similar vectors of every vector.

An index in two parts is fitted on a bounded sample and then holds every row: coarse
cells, and additive codes, which are sums of one entry from each of several codebooks
that span all dimensions, found by beam search, with the length of the sum stored. A
query goes to the cells whose centres are nearest; there every code is scored from
lookup tables, and the best are ranked anew by the vectors themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.vectors import bounded_sample, lists, matrix, unit
from loomgraph.session import cut


@dataclass
class Index:
    """Centres (cells, d) and codebooks (books, 256, d), both float32."""

    centres: np.ndarray
    books: np.ndarray


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), 1)
        order = np.argsort(at, kind="stable")
        names, first = np.unique(at[order], return_index=True)
        c[names] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
        empty = np.setdiff1d(np.arange(k), names)
        c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) uint8 and the length of each sum; the ``beam`` best prefixes are kept after each book."""
    n, d = x.shape
    m = len(books)
    rest, codes, err = x[:, None, :].copy(), np.zeros((n, 1, m), np.uint8), np.zeros((n, 1), np.float32)
    rows = np.arange(n)[:, None]
    for j, c in enumerate(books):
        # |r - c|^2 less |r|^2, which the running error holds.
        cost = err[:, :, None] + ((c * c).sum(1) - 2 * (rest.reshape(-1, d) @ c.T)).reshape(n, -1, len(c))
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        top = np.argpartition(flat, keep - 1, 1)[:, :keep]
        src, code = top // len(c), top % len(c)
        err, rest, codes = flat[rows, top], rest[rows, src] - c[code], codes[rows, src]
        codes[:, :, j] = code
    best = err.argmin(1)
    return codes[np.arange(n), best], np.sqrt(((x - rest[np.arange(n), best]) ** 2).sum(1))


def fit(sample: np.ndarray, cells: int, books: int = 8, seed: int = 5) -> Index:
    rng = np.random.default_rng(seed)
    x = unit(sample.astype(np.float64)).astype(np.float32)
    centres = _kmeans(x, cells, rng)
    rest, out = x.copy(), []
    for _ in range(books):
        c = _kmeans(rest, 256, rng, 6)
        out.append(c)
        rest -= c[np.argmax(rest @ c.T - 0.5 * (c * c).sum(1), 1)]
    return Index(centres, np.stack(out))


def visited(cells: int, probes: int) -> int:
    """Cells that a query goes to: ``probes`` of up to 120, above that as the cells to the power 2/3, so that recall stays."""
    return int(np.ceil(probes * max(1.0, cells / 120) ** (2 / 3)))


def within_reach(u: np.ndarray, near: np.ndarray, top: np.ndarray, centres: np.ndarray, least: float) -> np.ndarray:
    """Which of the cells ``top`` (n, k) can hold a vector whose cosine to ``u`` is at least ``least``.

    Such a vector lies within ``reach`` of u, so the plane halfway between a cell's centre and u's own nearest one must, too.
    """
    reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-3
    best, rows = near.argmax(1), np.arange(len(u))
    apart = np.sqrt(((centres[top] - centres[best][:, None]) ** 2).sum(2))
    return near[rows, best][:, None] - near[rows[:, None], top] <= reach * apart + 1e-5


def _indexer(shared, probes: int, least: float = -1.0):
    """id, v, is_query -> a row for the cell that holds the vector and a row for each cell that its query goes to."""

    def run(batches):
        ix: Index = shared.value
        k = min(probes, len(ix.centres))
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                x = matrix(b.column(1))
                u = unit(x.astype(np.float64)).astype(np.float32)
                near = u @ ix.centres.T - 0.5 * (ix.centres * ix.centres).sum(1)
                top = np.argpartition(-near, k - 1, 1)[:, :k]
                codes, length = encode(u, ix.books)
                asks = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False))
                n = len(x)
                use = within_reach(u[asks], near[asks], top[asks], ix.centres, least) if least > -1 else np.ones((len(asks), k), bool)
                cell = np.concatenate([near.argmax(1), top[asks][use]])
                at = np.concatenate([np.arange(n), np.repeat(asks, use.sum(1))])
                q = len(at) - n
                ids = b.column(0).to_numpy(zero_copy_only=False)[at]
                code = [c.tobytes() for c in codes] + [None] * q
                size = np.concatenate([length, np.zeros(q, np.float32)]).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int32()), pa.array(ids, pa.int64()), lists(x[at]), pa.array(code, pa.binary()), pa.array(size)],
                    names=["cell", "id", "v", "code", "size"],
                )

    return run


def _searcher(shared, k: int, rerank: int, least: float):
    def run(t: pa.Table) -> pa.Table:
        ix: Index = shared.value
        ids, v = t.column("id").to_numpy(), unit(matrix(t.column("v")).astype(np.float64))
        held = t.column("code").is_valid().to_numpy()
        codes = np.frombuffer(b"".join(t.column("code").drop_null().to_pylist()), np.uint8).reshape(int(held.sum()), -1)
        dv, di, size = v[held], ids[held], np.maximum(t.column("size").to_numpy()[held], 1e-6)
        dv32 = dv.astype(np.float32)
        qv, qi = v[~held], ids[~held]
        out_q, out_d, out_s = [], [], []
        for lo in range(0, len(qi) if len(di) else 0, 128):
            q, own = qv[lo : lo + 128], qi[lo : lo + 128]
            # A code picks a whole row of its table: the scores of one entry for all queries of the batch.
            total, part = np.zeros((len(di), len(q)), np.float32), np.empty((len(di), len(q)), np.float32)
            for j, c in enumerate(ix.books):
                np.take(c @ q.T.astype(np.float32), codes[:, j], 0, out=part, mode="clip")
                total += part
            total /= size[:, None]
            score = np.ascontiguousarray(total.T)
            score[own[:, None] == di[None, :]] = -np.inf
            r = min(rerank, len(di))
            top = np.argpartition(-score, r - 1, 1)[:, :r]
            near = np.matmul(dv32[top], q.astype(np.float32)[:, :, None])[:, :, 0]
            near[own[:, None] == di[top]] = -np.inf
            # Single precision settles all but the last few places, which are decided in double.
            few = min(k + 8, r)
            best = np.argpartition(-near, few - 1, 1)[:, :few]
            top, near = np.take_along_axis(top, best, 1), np.take_along_axis(near, best, 1)
            exact = np.einsum("qd,qrd->qr", q, dv[top])
            exact[near == -np.inf] = -np.inf
            for i, j in _best(exact, di[top], k, least):
                out_q.append(own[i])
                out_d.append(di[top[i, j]])
                out_s.append(exact[i, j])
        return pa.table({"id": pa.array(out_q, pa.int64()), "other": pa.array(out_d, pa.int64()), "similarity": pa.array(out_s, pa.float64())})

    return run


def _best(exact: np.ndarray, ids: np.ndarray, k: int, least: float):
    """Places (row, column) of the k best of each row, least ids first among equals."""
    order = np.lexsort((ids, -exact), axis=1)[:, :k]
    rows = np.repeat(np.arange(len(exact)), order.shape[1])
    cols = order.ravel()
    ok = (exact[rows, cols] >= least) & (exact[rows, cols] > -2)
    return zip(rows[ok], cols[ok], strict=True)


def nearest_vectors(
    vectors: DataFrame,
    k: int = 5,
    queries: str | None = None,
    least: float = -1.0,
    sample_rows: int = 20_000,
    cell_rows: int = 1024,
    probes: int = 8,
    books: int = 16,
    rerank: int = 64,
    block: int = 8192,
) -> DataFrame:
    """``id, other, similarity, rank``: for each query the k others of largest cosine, at least ``least``.

    ``vectors`` has ``id`` and ``v`` as from ``usable``; ``queries`` is a condition on ``id`` (all rows if not given).
    The index is fitted on ``sample_rows`` rows at most (ten times more from ten million rows on) and holds every row.
    A query goes to ``probes`` cells of up to 120, and to more where there are more, as ``visited`` says; of these
    it leaves out those that can't hold a vector of cosine ``least``.
    A cell with more than ``block`` vectors is scored in blocks, so no task grows with it. Equal cosines are
    ordered by id. Fewer than two vectors give no rows.
    """
    spark = vectors.sparkSession
    vectors = cut(vectors)
    n = vectors.count()
    sample = bounded_sample(vectors, sample_rows if n < 10_000_000 else 10 * sample_rows)
    if n < 2:
        return spark.createDataFrame([], "id bigint, other bigint, similarity double, rank int")
    cells = int(np.clip(round(n / cell_rows), 1, max(1, len(sample) // 16)))
    shared = spark.sparkContext.broadcast(fit(sample, cells, books))
    rows = vectors.select("id", "v", F.expr(queries or "true").alias("ask"))
    placed = cut(rows.mapInArrow(_indexer(shared, visited(cells, probes), least), "cell int, id bigint, v array<float>, code binary, size float"))
    held = F.col("code").isNotNull()
    sizes = placed.groupBy("cell").agg(F.ceil(F.sum(held.cast("int")) / block).cast("int").alias("nd"), F.ceil(F.sum((~held).cast("int")) / (8.0 * block)).cast("int").alias("nq"))
    sizes = sizes.select("cell", F.greatest("nd", F.lit(1)).alias("nd"), F.greatest("nq", F.lit(1)).alias("nq"))
    placed = placed.join(F.broadcast(sizes), "cell")  # a row a cell; their number is bounded by the sample
    own = F.pmod(F.xxhash64("id"), F.when(held, F.col("nd")).otherwise(F.col("nq"))).cast("int")
    every = F.sequence(F.lit(0), F.when(held, F.col("nq")).otherwise(F.col("nd")) - 1)
    placed = placed.withColumn("own", own).withColumn("with", F.explode(every))
    placed = placed.withColumn("i", F.when(held, F.col("own")).otherwise(F.col("with"))).withColumn("j", F.when(held, F.col("with")).otherwise(F.col("own")))
    found = placed.groupBy("cell", "i", "j").applyInArrow(_searcher(shared, k, rerank, least), "id bigint, other bigint, similarity double")
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
