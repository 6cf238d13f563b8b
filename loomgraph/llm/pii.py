"""Personal information in free text: found by a trained tagger, replaced by typed placeholders.

The tagger of ``pii_model`` (character-level bidirectional LSTM with CRF transitions)
decodes overlapping windows of every text. Windows are reconciled over the whole text:
in an overlap each character takes the tag of the window in which it lies deeper. The
places so found are then settled by an exact check that fits start and end to the form
of the kind, or drops what can't be one; it looks at found places only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.pii_model import TAGS, Tagger, class_table

WEIGHTS = str(Path(__file__).with_name("pii_weights.npz"))
WINDOW, OVERLAP, BATCH, CHUNK_CHARS = 288, 48, 1024, 2_000_000

# Forms of mail addresses, phone and identity numbers, and titles before a name.
EMAIL = re.compile(
    r"[A-Za-z0-9][\w.+-]*(?:(?:@|\s?\[at\]\s?|\s?\(at\)\s?)[\w-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z][\w-]*)+|\sat\s[\w-]+(?:\sdot\s[A-Za-z][\w-]*)+)",
    re.ASCII,
)
PHONE = re.compile(r"(?<![\w.+-])(?:\+\d(?:[ .-]?\(?\d+\)?){2,6}|\(\d{3}\)\s?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|0\d(?: \d\d){4}|0\d{4} \d{3} ?\d{3})(?:\s+(?:ext\.?|x)\s*\d+)?(?![\w])")
IDNUM = re.compile(r"(?<![\w-])(?:\d{3}-\d\d-\d{4}|[A-Z]{2}\d{7}[A-Z]?|[A-Z]-\d{4}-\d{4}-[A-Z]|\d\d \d\d \d\d \d{3} \d\d)(?![\w-])")
TITLE = re.compile(r"(?:(?:dr|prof|mr|ms|mrs|herr|frau|sir|madam)\b\.?\s*)+", re.I)
FORMS = {"email": EMAIL, "phone": PHONE, "idnum": IDNUM}
LEAD = re.compile(r"(?:\d+[a-z]?\s+(?:rue\s+de\s+)?|calle\s+|rue\s+de\s+|p\.?\s?o\.?\s+(?:box\s+)?)$", re.I)


def settled(text: str, kind: str, a: int, b: int) -> list[tuple[int, int]]:
    """The spans that the tagged run [a, b) stands for: none if there is none of its kind, several where numbers follow each other."""
    if kind in FORMS:
        near = FORMS[kind].finditer(text, max(0, a - 80), min(len(text), b + 80))
        return [m.span() for m in near if m.start() < b and m.end() > a]
    span = _trimmed(text, kind, a, b)
    return [span] if span else []


def _trimmed(text: str, kind: str, a: int, b: int) -> tuple[int, int] | None:
    """The span of an address or a name at the tagged run [a, b), or None."""
    while a < b and not (text[a].isalnum()):
        a += 1
    while b > a and not (text[b - 1].isalnum()):
        b -= 1
    if a >= b:
        return None
    while a and text[a - 1].isalnum():
        a -= 1
    while b < len(text) and text[b].isalnum():
        b += 1
    if kind == "address":
        m = LEAD.search(text, max(0, a - 16), a)
        if m:
            a = m.start() + (len(m.group()) - len(m.group().lstrip()))
        return (a, b) if b - a > 4 and any(c.isdigit() for c in text[a:b]) else None
    m = TITLE.match(text, a, b)
    a = m.end() if m else a
    m = re.compile(r"(?<!\w)[^\W\d_]\.\s+$").search(text, max(0, a - 5), a)
    if m and text[m.start()].isupper():
        a = m.start()
    if b < len(text) and text[b] == "." and re.match(r"(?:.*\W)?[A-ZÀ-Þ]$", text[a:b], re.S):
        b += 1
    part = text[a:b]
    if any(c.isdigit() for c in part) or "@" in part or not re.search(r"[^\W\d_]{3}", part):
        return None
    return (a, b) if re.search(r"[\s,]", part) else None


def _tags(tagger: Tagger, texts: list[str]) -> list[np.ndarray]:
    """The tags of each text's characters."""
    table = class_table()
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(size)])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], np.uint8(101)).astype(np.uint8)
    step = WINDOW - OVERLAP
    count = np.where(size > WINDOW, -(-(size - OVERLAP) // step), np.minimum(size, 1))
    owner = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = nth * step
    length = np.minimum(WINDOW, size[owner] - start)
    at = begin[owner] + start
    tags = np.zeros(len(cls), np.int8)
    order = np.argsort(length, kind="stable")
    keep_from = np.where(nth > 0, OVERLAP // 2, 0)
    keep_to = np.where(nth < count[owner] - 1, WINDOW - OVERLAP // 2, length)
    for lo in range(0, len(order), BATCH):
        w = order[lo : lo + BATCH]
        t = np.arange(int(length[w].max()))[:, None]
        inside = t < length[w]
        x = np.where(inside, cls[np.minimum(at[w] + t, len(cls) - 1)], 0)
        got = tagger.decode(tagger.emissions(x))
        use = inside & (t >= keep_from[w]) & (t < keep_to[w]) & (got > 0)
        tags[(at[w] + t)[use]] = got[use]
    return [tags[begin[i] : begin[i + 1]] for i in range(len(texts))]


def places(tagger: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of the places in each text, by start; of overlapping ones the longest."""
    out = []
    for text, tags in zip(texts, _tags(tagger, texts), strict=True):
        found: list[tuple[str, int, int]] = []
        if tags.any():
            cuts = np.flatnonzero(np.diff(tags)) + 1
            edges = [0, *cuts.tolist(), len(tags)]
            for a, b in zip(edges, edges[1:], strict=False):
                if tags[a]:
                    found += [(TAGS[tags[a]], *span) for span in settled(text, TAGS[tags[a]], a, b)]
            taken: list[tuple[str, int, int]] = []
            for f in sorted(set(found), key=lambda f: (f[1] - f[2], f[1])):
                if all(f[2] <= g[1] or f[1] >= g[2] for g in taken):
                    taken.append(f)
            found = sorted(taken, key=lambda f: f[1])
        out.append(found)
    return out


def _runs(lengths: list[int]) -> Iterator[slice]:
    lo = total = 0
    for i, n in enumerate(lengths):
        if total + n > CHUNK_CHARS and i > lo:
            yield slice(lo, i)
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield slice(lo, len(lengths))


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for b in batches:
            src, ids, texts = (c.to_pylist() for c in b.columns)
            rows = []
            for part in _runs([len(t) for t in texts]):
                for s, i, found in zip(src[part], ids[part], places(tagger, texts[part]), strict=True):
                    rows += [(s, i, *f) for f in found]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["src", "record_id", "kind", "start_at", "end_at"])

    return run


def _redactor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for b in batches:
            texts = b.column(2).to_pylist()
            out: list[str | None] = []
            for part in _runs([len(t or "") for t in texts]):
                for text, found in zip(texts[part], places(tagger, [t or "" for t in texts[part]]), strict=True):
                    for kind, lo, hi in reversed(found):
                        text = f"{text[:lo]}[{kind.upper()}]{text[hi:]}"
                    out.append(text)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["src", "record_id", "text"])

    return run


def _weights(df: DataFrame, weights: str):
    with np.load(weights) as z:
        return df.sparkSession.sparkContext.broadcast({k: z[k] for k in z.files})


def found_places(df: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """``src, record_id, kind, start_at, end_at`` for a table with columns ``src, record_id, text``; offsets in code points.

    Null and empty texts give no rows. Rows are treated one by one and nothing is shuffled;
    a row that is there twice gives its places twice. ``weights`` (tens of kB) is read by the driver.
    """
    rows = df.select("src", F.col("record_id").cast("bigint"), "text").filter(F.length("text") > 0)
    return rows.mapInArrow(_finder(_weights(df, weights)), "src string, record_id bigint, kind string, start_at bigint, end_at bigint")


def redacted_texts(df: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """``src, record_id, text`` with each place replaced by [PERSON], [EMAIL], [PHONE], [IDNUM] or [ADDRESS]; null stays null."""
    rows = df.select("src", F.col("record_id").cast("bigint"), "text")
    return rows.mapInArrow(_redactor(_weights(df, weights)), "src string, record_id bigint, text string")
