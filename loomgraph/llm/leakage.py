"""Evaluation passages inside training text.

The passages, in the one form of ``canonical`` and cut into words, are put into a
generalised suffix automaton. Training texts are streamed through it word by word; the
state tracks the longest suffix that occurs in some passage. Where that is ``least``
words or more, the state for exactly the last ``least`` words names the items.

Passages of more words than one automaton should hold are taken in shards; texts without
a candidate, found by a join of selected word runs, are then left out before the shards.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.canonical import canonical
from loomgraph.session import cut

WORD = re.compile(r"[^\W_]+")
MAX_SHARD_WORDS = 400_000


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits of the canonical form, lower-cased."""
    if not text:
        return []
    form = canonical(text)
    low = form.lower()
    return WORD.findall(low) if len(low) == len(form) else [w.lower() for w in WORD.findall(form)]  # one letter becomes two when lowered


class SuffixAutomaton:
    """Over several word sequences, with the items that hold each state's words."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids: list[set[int]] = [set()]
        ends: list[tuple[int, int]] = []
        for item, seq in items:
            last = 0
            for w in seq:
                last = self._extend(last, w)
                ends.append((last, item))
        for state, item in ends:
            while state > 0 and item not in self.ids[state]:
                self.ids[state].add(item)
                state = self.link[state]

    def _state(self, length: int, link: int, nxt: dict[str, int]) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.ids.append(set())
        return len(self.next) - 1

    def _split(self, p: int, w: str, q: int) -> int:
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: str) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def holders(self, least: int) -> list[frozenset[int] | None]:
        """By state: the items that hold the last ``least`` words, once the match is that long."""
        out: list[frozenset[int] | None] = []
        for s in range(len(self.next)):
            while s > 0 and self.length[self.link[s]] >= least:
                s = self.link[s]
            out.append(frozenset(self.ids[s]) if s > 0 and self.length[s] >= least else None)
        return out


def spans(auto: SuffixAutomaton, holders: list[frozenset[int] | None], seq: list[str], least: int) -> dict[int, list[tuple[int, int]]]:
    """By item: the maximal word spans [start, end) of ``seq`` made of runs of ``least`` or more words of it."""
    nxt, link, length = auto.next, auto.link, auto.length
    root = nxt[0]
    s = n = 0
    found: dict[int, list[tuple[int, int]]] = {}
    for i, w in enumerate(seq):
        if s == 0 and w not in root:
            continue
        t = nxt[s].get(w)
        while t is None and s:
            s = link[s]
            n = length[s]
            t = nxt[s].get(w)
        if t is None:
            n = 0
            continue
        s, n = t, n + 1
        if n >= least:
            for item in holders[s] or ():
                at = found.setdefault(item, [])
                if at and at[-1][1] >= i + 1 - least:
                    at[-1] = (at[-1][0], i + 1)
                else:
                    at.append((i + 1 - least, i + 1))
    return found


_BUILT: dict[str, tuple] = {}


def _automaton(name: str, shared, least: int):
    """The automaton of a shard, built once in a worker process; only the last one is kept."""
    if name not in _BUILT:
        _BUILT.clear()
        auto = SuffixAutomaton(shared.value)
        _BUILT[name] = auto, auto.holders(least)
    return _BUILT[name]


def _matcher(name: str, shared, least: int):
    """doc_id, text -> one row for each text and item that it holds, with the spans of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, holders = _automaton(name, shared, least)
        for b in batches:
            keys, found, starts, ends, sizes = [], [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seq = words(t)
                if len(seq) >= least:
                    for item, at in spans(auto, holders, seq, least).items():
                        keys.append(k)
                        found.append(item)
                        starts.append([x for x, _ in at])
                        ends.append([y for _, y in at])
                        sizes.append(len(seq))
            many = pa.list_(pa.int64())
            cols = [pa.array(keys, pa.int64()), pa.array(found, pa.int64()), pa.array(starts, many), pa.array(ends, many), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "starts", "ends", "n_words"])

    return run


def selected_runs(seq: list[str], least: int) -> np.ndarray:
    """Hashes of some runs of half of ``least`` words, such that two texts with ``least`` words in common share one.

    In every window of ``least`` words the run of least hash is taken, so the choice depends on the window's words only.
    """
    k = max(1, least // 2)
    if len(seq) < least:
        return np.empty(0, np.int64)
    h = np.fromiter((int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in seq), np.uint64, len(seq))
    with np.errstate(over="ignore"):
        run = np.zeros(len(seq) - k + 1, np.uint64)
        for i in range(k):
            run = run * np.uint64(0x9E3779B97F4A7C15) + (h[i : len(h) - k + 1 + i] ^ (h[i : len(h) - k + 1 + i] >> np.uint64(31)))
        run ^= run >> np.uint64(29)
    return np.unique(np.lib.stride_tricks.sliding_window_view(run, least - k + 1).min(1)).view(np.int64)


def _runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [selected_runs(words(t), least) for t in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(got)), [len(g) for g in got])
            flat = np.concatenate(got) if got else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(flat, pa.int64())], names=["id", "run"])

    return run


def leaked_spans(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", least: int = 12, shard_words: int = MAX_SHARD_WORDS) -> DataFrame:
    """``doc_id, item_id, starts, ends, n_words``: by text and item the word spans [start, end) that hold ``least`` or more words of a passage in a row.

    The items are few beside the corpus, but that is checked: they are taken in shards of at
    most ``shard_words`` words, each broadcast and matched in a pass of its own, so that no
    automaton outgrows a worker. With more than one shard the corpus is first reduced, in one
    pass and a semi-join, to texts that share a selected run of words with some item; no match
    is lost by that. Null, empty and shorter passages and texts give no rows. With one shard
    the corpus isn't shuffled.
    """
    spark = docs.sparkSession
    held = items.select(F.col(item).cast("bigint"), F.col(passage)).filter(F.col(item).isNotNull() & F.col(passage).isNotNull()).distinct()
    corpus = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter(F.col(key).isNotNull() & (F.length(text) >= 2 * least - 1))
    shards, shard, size = [], [], 0
    for r in held.toLocalIterator():
        seq = words(r[1])
        if len(seq) < least:
            continue
        if size + len(seq) > shard_words and shard:
            shards.append(spark.sparkContext.broadcast(shard))
            shard, size = [], 0
        shard.append((r[0], seq))
        size += len(seq)
    shards.append(spark.sparkContext.broadcast(shard))
    if len(shards) > 1:
        kept = held.mapInArrow(_runs(least), "id bigint, run bigint").select("run").distinct()
        near = corpus.mapInArrow(_runs(least), "id bigint, run bigint").join(kept, "run", "left_semi").select("id").distinct()
        corpus = cut(corpus.join(near, corpus["doc_id"] == near["id"], "left_semi"))
    found = [corpus.mapInArrow(_matcher(uuid.uuid4().hex, s, least), "doc_id bigint, item_id bigint, starts array<bigint>, ends array<bigint>, n_words bigint") for s in shards]
    return reduce(DataFrame.union, found)


def leaked_items(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """``doc_id, item_id, longest, covered, n_words`` for each text that holds ``least`` words of a passage in a row (see ``leaked_spans``)."""
    sizes = F.zip_with("starts", "ends", lambda a, b: b - a)
    total = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return leaked_spans(docs, items, **kw).select("doc_id", "item_id", F.array_max(sizes).alias("longest"), total.alias("covered"), "n_words")


def cleaned(text: str, starts: list[int], ends: list[int], max_words: int, max_share: float) -> tuple[str, int]:
    """The one form of a text without its leaked spans, and how many words went.

    A span goes if it has ``max_words`` words or more; all go if together they cover more than
    ``max_share`` of the words. What goes is from the first character of its first word to the
    last of its last.
    """
    form = canonical(text)
    at = [m.span() for m in WORD.finditer(form)]
    merged: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    everything = sum(b - a for a, b in merged) > max_share * len(at)
    gone = [(a, b) for a, b in merged if everything or b - a >= max_words]
    for a, b in reversed(gone):
        form = form[: at[a][0]] + form[at[b - 1][1] :]
    return form, sum(b - a for a, b in gone)


def _cleaner(max_words: int, max_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [cleaned(*r, max_words, max_share) for r in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["_row", "doc_id", "text", "removed"])

    return run


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", max_words: int = 20, max_share: float = 0.2, **kw) -> DataFrame:
    """``doc_id, text, removed``: every text, with the leaked spans over the limits taken out and the number of words that went.

    Texts from which nothing is taken stay as they are stored, null and empty ones too; the others
    come in their one form. A text's spans are gathered over all items, overlapping ones count once.
    A row that is there twice comes twice.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("_row", F.xxhash64("doc_id", "text"))
    spans_ = leaked_spans(rows, items, key="_row", text="text", **kw)
    by = spans_.groupBy(F.col("doc_id").alias("_k")).agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    hit = rows.join(by, rows["_row"] == by["_k"]).select("_row", "doc_id", "text", "starts", "ends").mapInArrow(_cleaner(max_words, max_share), "_row bigint, doc_id bigint, text string, removed bigint")
    hit = cut(hit.filter("removed > 0"))
    same = rows.join(hit.select(F.col("_row").alias("_k")), F.col("_row") == F.col("_k"), "left_anti").select("doc_id", "text", F.lit(0).cast("bigint").alias("removed"))
    return same.unionByName(hit.drop("_row"))
