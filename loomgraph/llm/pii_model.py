"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Characters are mapped to classes (accented letters to their base letter), each direction
is one LSTM layer, and the tags of a window are decoded by Viterbi over the sum of
emission and transition scores. ``train`` fits all parameters by Adam on the exact
gradient of the CRF likelihood, computed here; ``python -m loomgraph.llm.pii_train``
makes the parameter file that the operator loads.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

TAGS = ("O", "person", "email", "phone", "idnum", "address")
CLASSES = 102  # 0 padding, 1-95 printable ASCII, then line break, tab, degree, other upper, other lower, other


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point below 0x3000; all above are ``other``."""
    t = np.full(0x3000, 101, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        base = unicodedata.normalize("NFD", ch)[0]
        base = {"ø": "o", "Ø": "O", "ß": "s", " ": " "}.get(base, base)
        if " " <= base <= "~":
            t[c] = ord(base) - 31
        elif ch in "\n\r":
            t[c] = 96
        elif ch == "\t":
            t[c] = 97
        elif ch in "°ºª":
            t[c] = 98
        elif ch.isupper():
            t[c] = 99
        elif ch.isalpha():
            t[c] = 100
    return t


def classes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    t = class_table()
    return np.where(c < len(t), t[np.minimum(c, len(t) - 1)], np.uint8(101)).astype(np.uint8)


def fresh(hidden: int, seed: int = 0) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    k = len(TAGS)
    p = {}
    for d in "fb":
        p[f"w{d}"] = r.normal(0, 0.3, (CLASSES, 4 * hidden))
        p[f"u{d}"] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        p[f"b{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
    p["wo"], p["bo"] = r.normal(0, 0.3, (2 * hidden, k)), np.zeros(k)
    p["trans"], p["start"] = np.zeros((k, k)), np.zeros(k)
    return {n: x.astype(np.float32) for n, x in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(x, mask, w, u, b):
    """x (T, B) classes in the order of the walk -> h (T, B, H) and what the gradient needs."""
    n, m = x.shape
    hid = u.shape[0]
    h, c = np.zeros((m, hid), np.float32), np.zeros((m, hid), np.float32)
    hs, cs, gates, tcs = (np.empty((n, m, k), np.float32) for k in (hid, hid, 4 * hid, hid))
    for t in range(n):
        z = w[x[t]] + h @ u + b
        z[:, : 3 * hid] = _sigmoid(z[:, : 3 * hid])
        z[:, 3 * hid :] = np.tanh(z[:, 3 * hid :])
        c = (z[:, hid : 2 * hid] * c + z[:, :hid] * z[:, 3 * hid :]) * mask[t][:, None]
        tc = np.tanh(c)
        h = z[:, 2 * hid : 3 * hid] * tc
        gates[t], cs[t], tcs[t], hs[t] = z, c, tc, h
    return hs, (gates, cs, tcs)


def _lstm_back(x, mask, u, hs, kept, dh_out, v):
    gates, cs, tcs = kept
    n, m, hid = hs.shape
    dh, dc = np.zeros((m, hid), np.float32), np.zeros((m, hid), np.float32)
    dzs = np.empty((n, m, 4 * hid), np.float32)
    for t in range(n - 1, -1, -1):
        i, f, o, g = (gates[t][:, k * hid : (k + 1) * hid] for k in range(4))
        dh = dh + dh_out[t]
        dc = (dc + dh * o * (1 - tcs[t] ** 2)) * mask[t][:, None]
        before = cs[t - 1] if t else 0
        dz = dzs[t]
        dz[:, :hid], dz[:, hid : 2 * hid] = dc * g * i * (1 - i), dc * before * f * (1 - f)
        dz[:, 2 * hid : 3 * hid], dz[:, 3 * hid :] = dh * tcs[t] * o * (1 - o), dc * i * (1 - g * g)
        dc = dc * f
        dh = dz @ u.T
    flat = dzs.reshape(-1, 4 * hid)
    prev = np.concatenate([np.zeros((1, m, hid), np.float32), hs[:-1]]).reshape(-1, hid)
    dw = np.zeros((v, 4 * hid), np.float32)
    xf = x.ravel()
    order = np.argsort(xf, kind="stable")
    names, first = np.unique(xf[order], return_index=True)
    dw[names] = np.add.reduceat(flat[order], first, axis=0)
    return dw, prev.T @ flat, flat.sum(0)


def _lse(x, axis):
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss (mean negative log-likelihood a window) and its gradient; x, y, mask are (T, B)."""
    n, m = x.shape
    rev = slice(None, None, -1)
    hf, kf = _lstm(x, mask, p["wf"], p["uf"], p["bf"])
    hb, kb = _lstm(x[rev], mask[rev], p["wb"], p["ub"], p["bb"])
    h = np.concatenate([hf, hb[rev]], 2)
    e = h @ p["wo"] + p["bo"]
    k = e.shape[2]
    tr = p["trans"]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + p["start"]
    for t in range(1, n):
        a = _lse(alpha[t - 1][:, :, None] + tr, 1) + e[t]
        alpha[t] = np.where(mask[t][:, None] > 0, a, alpha[t - 1])
    z = _lse(alpha[-1], 1)
    for t in range(n - 2, -1, -1):
        b = _lse(tr[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where(mask[t + 1][:, None] > 0, b, 0)
    marg = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
    hot = np.eye(k, dtype=np.float32)[y] * mask[:, :, None]
    both = mask[1:] * mask[:-1]
    pair = np.exp(alpha[:-1][:, :, :, None] + tr + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None])
    dtr = (pair * both[:, :, None, None]).sum((0, 1)) - np.einsum("tbi,tbj->ij", hot[:-1] * both[:, :, None], hot[1:])
    gold = (e * hot).sum() + p["start"][y[0]].sum() + (tr[y[:-1], y[1:]] * both).sum()
    de = (marg - hot) / m
    dh = de @ p["wo"].T
    hid = hf.shape[2]
    g = {"wo": h.reshape(-1, 2 * hid).T @ de.reshape(-1, k), "bo": de.sum((0, 1)), "trans": dtr / m, "start": de[0].sum(0)}
    g["wf"], g["uf"], g["bf"] = _lstm_back(x, mask, p["uf"], hf, kf, dh[:, :, :hid], CLASSES)
    g["wb"], g["ub"], g["bb"] = _lstm_back(x[rev], mask[rev], p["ub"], hb, kb, dh[rev][:, :, hid:], CLASSES)
    return float((z.sum() - gold) / m), g


class Adam:
    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float, clip: float = 5.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k in p:
            d = g[k] * min(1.0, clip / (norm + 1e-9))
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.v[k] = 0.999 * self.v[k] + 0.001 * d * d
            p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


class Tagger:
    """Parameters arranged for decoding.

    All gates are read off one exponential, 1 / (1 + exp(z)), so the signs of their inputs are turned and
    the input of the fourth, a tanh, is doubled. The state and the outputs are kept halved; the doubling
    is in the weights that read the outputs.
    """

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        hid = p["uf"].shape[0]
        turned = np.repeat(np.array([-1, -1, -1, -2], np.float32), hid)
        self.hid, self.wo, self.bo, self.trans, self.start = hid, p["wo"] * 2, p["bo"], p["trans"], p["start"]
        self.way = [((p[f"w{d}"] + p[f"b{d}"]) * turned, p[f"u{d}"] * 2 * turned) for d in "fb"]
        # What at most is gained over tag 0 by the transition into a place, inside it, out of it, and by beginning in one.
        t, stay = p["trans"], p["trans"][0, 0]
        self.enter, self.inside, self.leave = (float(x.max() - stay) for x in (t[0, 1:], t[1:, 1:], t[1:, 0]))
        self.begin = float((p["start"][1:] - p["start"][0]).max())

    def _walk(self, x: np.ndarray, w: np.ndarray, u: np.ndarray, wo: np.ndarray, out: np.ndarray) -> None:
        """Adds the emissions of one direction to ``out`` (T, K, B). Padding (class 0) ahead of a row keeps its state at zero.

        Rows of padding at the front of a step are left out of it: with rows sorted by length that is all padding.
        """
        n, m = x.shape
        hid = self.hid
        h, c = np.zeros((m, hid), np.float32), np.zeros((m, hid), np.float32)
        z, r, gates, e = np.empty((m, 4 * hid), np.float32), np.empty((m, 4 * hid), np.float32), np.empty((4, m, hid), np.float32), np.empty((wo.shape[1], m), np.float32)
        wo = np.ascontiguousarray(wo.T)
        held = x != 0
        lead, padded = np.where(held.any(1), held.argmax(1), m), ~held.all(1)
        one, half = np.float32(1), np.float32(0.5)
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is the 0 that is meant
            for t in range(n):
                k = lead[t]
                if k:
                    h[:k], c[:k] = 0, 0
                hs, cs, zs, rs, (i, f, o, g) = h[k:], c[k:], z[k:], r[k:], gates[:, k:]
                np.take(w, x[t, k:], 0, out=zs, mode="clip")
                np.matmul(hs, u, out=rs)
                rs += zs
                np.exp(rs, out=rs)
                rs += one
                np.divide(one, rs.reshape(-1, 4, hid).transpose(1, 0, 2), out=gates[:, k:])  # each gate one block of memory
                g -= half
                i *= g
                cs *= f
                cs += i
                if padded[t]:
                    cs[x[t, k:] == 0] = 0
                np.multiply(cs, np.float32(-4), out=hs)
                np.exp(hs, out=hs)
                hs += one
                np.divide(one, hs, out=hs)
                hs -= half
                hs *= o
                np.matmul(wo, hs.T, out=e[:, k:])
                out[t, :, k:] += e[:, k:]

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x (T, B) classes, rows padded with 0 at the end -> (T, tags, B)."""
        n, m = x.shape
        out = np.empty((n, len(TAGS), m), np.float32)
        out[:] = self.bo[:, None]
        self._walk(x, *self.way[0], self.wo[: self.hid], out)
        self._walk(x[::-1], *self.way[1], self.wo[self.hid :], out[::-1])
        return out

    def _open(self, e: np.ndarray) -> np.ndarray:
        """The rows of the batch whose best path may leave tag 0: some run of steps might gain by it, with the best transitions there are."""
        gain = e[:, 1:].max(1) - e[:, 0]
        run = self.begin + gain[0]
        most = run.copy()
        for g in gain[1:]:
            run += self.inside
            np.maximum(run, self.enter, out=run)
            run += g
            np.maximum(most, run, out=most)
        return np.flatnonzero((most + self.leave > -1e-3) | (run > -1e-3))

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best tags (T, B) by Viterbi; rows whose best path can only be tag 0 throughout aren't walked."""
        n, _, m = e.shape
        tags, rows = np.zeros((n, m), np.int8), self._open(e)
        if len(rows):
            tags[:, rows] = self._viterbi(e[:, :, rows])
        return tags

    def _viterbi(self, e: np.ndarray) -> np.ndarray:
        """Tags are kept apart, so that every step is over whole rows of the batch."""
        n, k, m = e.shape
        best, back = e[0] + self.start[:, None], np.zeros((n, k, m), np.int8)
        most, s, more = np.empty((k, m), np.float32), np.empty((k, m), np.float32), np.empty((k, m), bool)
        for t in range(1, n):
            np.add(best[0], self.trans[0][:, None], out=most)
            for i in range(1, k):
                np.add(best[i], self.trans[i][:, None], out=s)
                np.greater(s, most, out=more)
                np.maximum(s, most, out=most)
                np.copyto(back[t], i, where=more)
            np.add(most, e[t], out=best)
        tags = np.empty((n, m), np.int8)
        tags[-1] = best.argmax(0)
        cols = np.arange(m)
        for t in range(n - 1, 0, -1):
            tags[t - 1] = back[t][tags[t], cols]
        return tags
