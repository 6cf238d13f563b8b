"""Fits the tagger of ``pii`` on labelled windows and writes its parameter file.

python -m loomgraph.llm.pii_train SF_DIR OUT.npz [--hidden 20] [--epochs 40] [--rows 40000]

At most ``--rows`` distinct texts of each table are read (a documented bound for fitting
only); texts that ``held_out`` names are left for measuring. Each window with a labelled place
is used, and for each one five without. Half of the new names put into these texts, and
all places in the sentences of ``pii_phrases``, are made of parts that don't occur in the tables.
"""

from __future__ import annotations

import argparse
import multiprocessing as mp
import time
import zlib

import numpy as np
import pyarrow.parquet as pq

from loomgraph.llm.pii_labels import ENDS, MIDDLES, ROOTS, labelled
from loomgraph.llm.pii_model import TAGS, Adam, classes, fresh, gradient
from loomgraph.llm.pii_phrases import person, phrase

LENGTH = 160


def _name(r: np.random.Generator, heads: list[str], tails: list[str]) -> str:
    """A fresh invented name in one of the ways in which names are written."""
    if r.random() < 0.5:
        return person(r)
    pick = lambda x: x[int(r.integers(len(x)))]
    given = pick(heads) + pick(tails)
    last = pick(ROOTS.split("|")) + pick(MIDDLES.split("|")) + pick(ENDS)
    way = r.random()
    if way < 0.3:
        full = f"{last}, {given}"
    elif way < 0.45:
        full = f"{given[0]}. {last}"
    elif way < 0.6:
        full = f"{given} {chr(65 + int(r.integers(26)))}. {last}"
    else:
        full = f"{given}{' ' if r.random() < 0.92 else chr(10)}{last}"
    case = r.random()
    return full.upper() if case < 0.12 else full.lower() if case < 0.24 else full


def _varied(text: str, spans: list[tuple[str, int, int]], r: np.random.Generator, heads: list[str], tails: list[str]) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with other names in the places of its names."""
    out, new, last = "", [], 0
    for kind, a, b in spans:
        out += text[last:a]
        part = _name(r, heads, tails) if kind == "person" else text[a:b]
        new.append((kind, len(out), len(out) + len(part)))
        out += part
        last = b
    return out + text[last:], new


def held_out(text: str) -> bool:
    """Every eighth text, by its checksum: not fitted on, kept for measuring."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % 8 == 0


def windows(texts: list[str], seed: int = 0, copies: int = 3, spare: int = 5, phrases: int = 30_000) -> tuple[np.ndarray, np.ndarray]:
    """x, y (N, LENGTH): classes and tags; texts with names come ``copies`` more times with other names."""
    r = np.random.default_rng(seed)
    have, none = [], []
    spanned = [(t, labelled(t)) for t in texts]
    givens = sorted({w for t, s in spanned for k, a, b in s if k == "person" and "," not in t[a:b] for w in t[a:b].split()[:1] if len(w) > 3 and w.istitle()})
    heads, tails = sorted({g[: 2 + len(g) % 2] for g in givens}), sorted({g[2 + len(g) % 2 :] for g in givens if len(g) > 4})

    def add(t: str, spans: list[tuple[str, int, int]], only: bool) -> None:
        y = np.zeros(len(t), np.int8)
        for kind, a, b in spans:
            y[a:b] = TAGS.index(kind)
        x = classes(t)
        starts = {max(0, int(a) - int(r.integers(10, LENGTH - 40))) for _, a, _ in spans} if spans else {int(r.integers(0, max(1, len(t) - LENGTH + 1)))}
        for s in starts:
            w = np.zeros((2, LENGTH), np.int16)
            part = x[s : s + LENGTH]
            w[0, : len(part)], w[1, : len(part)] = part, y[s : s + LENGTH]
            if w[1].any() or not only:
                (have if w[1].any() else none).append(w)

    for t, spans in spanned:
        add(t, spans, False)
        for _ in range(copies if any(k == "person" for k, _, _ in spans) else 0):
            add(*_varied(t, spans, r, heads, tails), True)
        if not spans and r.random() < 0.05:
            add(t.upper() if r.random() < 0.7 else t.lower(), [], False)
    for _ in range(phrases):
        out, spans = phrase(r)
        if r.random() < 0.5:
            other = texts[int(r.integers(len(texts)))][:120]
            if not labelled(other):
                spans, out = [(k, a + len(other) + 1, b + len(other) + 1) for k, a, b in spans], f"{other} {out}"
        add(out, spans, False)
    n = len(have)
    r.shuffle(none)
    all_ = np.stack(have + none[: spare * n])
    return all_[:, 0], all_[:, 1]


def _part(args):
    p, x, y = args
    return gradient(p, x.T, y.T, (x.T > 0).astype(np.float32))


def train(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, batch: int = 256, rate: float = 8e-3, workers: int = 8, seed: int = 1, seconds: float = 1e9) -> dict[str, np.ndarray]:
    p, r, began = fresh(hidden, seed), np.random.default_rng(seed), time.time()
    opt, steps, at = Adam(p), epochs * (len(x) // batch), 0
    with mp.get_context("fork").Pool(workers) as pool:
        for epoch in range(epochs):
            order, total = r.permutation(len(x)), 0.0
            for lo in range(0, len(x) - batch + 1, batch):
                parts = np.array_split(order[lo : lo + batch], workers)
                got = pool.map(_part, [(p, x[i], y[i]) for i in parts], 1)
                g = {k: sum(b[k] for _, b in got) / workers for k in p}
                done = max(at / steps, (time.time() - began) / seconds)
                opt.step(p, g, rate * min(1.0, (at + 1) / 50) * max(0.02, 0.5 * (1 + np.cos(np.pi * min(1, done)))))
                total += sum(a for a, _ in got) / workers
                at += 1
            print(f"epoch {epoch}: loss {total / (len(x) // batch):.4f}, {time.time() - began:.0f} s", flush=True)
            if time.time() - began > seconds:
                break
    return p


def texts_of(sf_dir: str, rows: int) -> list[str]:
    out = []
    for t in ("memories", "chat_messages"):
        c = pq.read_table(f"{sf_dir}/{t}.parquet", columns=["content"]).column(0).drop_null().unique().slice(0, rows).to_pylist()
        out += [x for x in c if x.strip() and not held_out(x)]
    return out


if __name__ == "__main__":
    a = argparse.ArgumentParser()
    a.add_argument("sf_dir")
    a.add_argument("out")
    a.add_argument("--hidden", type=int, default=20)
    a.add_argument("--epochs", type=int, default=40)
    a.add_argument("--rows", type=int, default=40_000)
    a.add_argument("--seconds", type=float, default=1e9)
    a.add_argument("--workers", type=int, default=8)
    o = a.parse_args()
    x, y = windows(texts_of(o.sf_dir, o.rows))
    print(len(x), "windows", flush=True)
    np.savez_compressed(o.out, **train(x, y, o.hidden, o.epochs, seconds=o.seconds, workers=o.workers))
