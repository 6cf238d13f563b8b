"""Cutting oversized texts into overlapping pieces at natural boundaries.

A text becomes an array of prefix sums of unit counts (here one unit a character;
any token counter gives another) and sorted arrays of boundary positions, one array
a rank of boundary. Each cut is a binary search for the last boundary in reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# White space, marks that end a sentence before white space, marks that end one alone.
BLANK = (32, 9, 10, 13)
STOPS = tuple(map(ord, ".!?"))
FULL_STOPS = tuple(map(ord, "。！？"))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def boundaries(c: np.ndarray) -> list[np.ndarray]:
    """Sorted cut positions by rank: after a blank line, after a sentence, after white space."""
    n = len(c)
    lf, cr = c == 10, c == 13
    para = np.zeros(n + 1, bool)
    para[2:] = lf[1:] & lf[:-1]
    para[3:] |= lf[2:] & cr[1:-1] & lf[:-2]
    blank = np.isin(c, BLANK)
    sent = np.zeros(n + 1, bool)
    sent[2:] = np.isin(c[:-1], STOPS) & blank[1:]
    sent[1:] |= np.isin(c, FULL_STOPS)
    space = np.zeros(n + 1, bool)
    space[1:] = blank
    return [np.flatnonzero(x) for x in (para, sent, space)]


def pieces(sums: np.ndarray, ranks: list[np.ndarray], limit: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Spans [start, end) over positions; ``sums[i]`` is the number of units before position i.

    A piece that isn't the last ends at the last boundary of the best rank with more than
    ``least`` and at most ``limit`` units since its start, or else at ``limit`` units.
    The next piece starts ``overlap`` units before that end.
    """
    n, start, out = len(sums) - 1, 0, []
    while sums[n] - sums[start] > limit:
        far = int(np.searchsorted(sums, sums[start] + limit, "right")) - 1
        near = int(np.searchsorted(sums, sums[start] + least, "right")) - 1
        end = far
        for r in ranks:
            i = int(np.searchsorted(r, far, "right")) - 1
            if i >= 0 and r[i] > near:
                end = int(r[i])
                break
        end = max(end, start + 1)  # a single unit may exceed the limit
        out.append((start, end))
        start = max(int(np.searchsorted(sums, sums[end] - overlap, "left")), start + 1)
    out.append((start, n))
    return out


def _cutter(limit: int, overlap: int, least: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ends, texts = [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = code_points(t)
                for s, e in pieces(np.arange(len(c) + 1), boundaries(c), limit, overlap, least):
                    ids.append(k)
                    starts.append(s)
                    ends.append(e)
                    if with_text:
                        texts.append(t[s:e])
            cols = [pa.array(ids, b.schema.field(0).type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())] + [pa.array(texts, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(cols, names=["id", "start_at", "end_at", "piece"][: len(cols)])

    return run


def split_texts(df: DataFrame, key: str, text: str, limit: int = 512, overlap: int = 50, least: int = 256, with_text: bool = False) -> DataFrame:
    """Pieces of every text longer than ``limit`` characters: ``id, start_at, end_at`` and, if asked, ``piece``.

    Shorter, empty and null texts give no rows (they fit as they are); the filter runs before Python.
    Rows are treated one by one, so repeated ids give repeated pieces: make ids unique before.
    """
    if not 0 <= overlap <= least < limit:
        raise ValueError("needs 0 <= overlap <= least < limit")
    kind = dict(df.dtypes)[key]
    long_ = df.select(F.col(key).alias("id"), F.col(text).alias("t")).filter(F.length("t") > limit)
    return long_.mapInArrow(_cutter(limit, overlap, least, with_text), f"id {kind}, start_at bigint, end_at bigint" + ", piece string" * with_text)
