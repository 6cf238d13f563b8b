"""Functions that no JVM expression can say, in Arrow batches, and a few shared forms."""

from __future__ import annotations

import json
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType

KINDS = {"string": StringType(), "bigint": LongType(), "int": IntegerType(), "double": DoubleType()}


def to_json(x: Column) -> Column:
    return F.get_json_object(F.to_json(F.struct(x.alias("v"))), "$.v")


def text_udf(f, kind: str = "string"):
    """A function of one text a row as a vectorised UDF; nulls stay null."""

    @F.pandas_udf(KINDS[kind])
    def g(x: pd.Series) -> pd.Series:
        return x.map(f, na_action="ignore")

    return lambda x: g(x.cast("string"))


normalize_nfc = text_udf(lambda s: unicodedata.normalize("NFC", s))
compress = text_udf(lambda s: zlib.compress(s.encode()).hex())
decompress = text_udf(lambda s: zlib.decompress(bytes.fromhex(s)).decode())
json_pretty = text_udf(lambda s: json.dumps(json.loads(s), indent=2, ensure_ascii=False))


def _flat(s: str) -> str:
    out: dict = {}

    def walk(v, path: str) -> None:
        if isinstance(v, dict):
            for k, w in v.items():
                walk(w, f"{path}.{k}" if path else k)
        else:
            out[path] = v

    walk(json.loads(s), "")
    return json.dumps(out, ensure_ascii=False)


def _deep(s: str) -> str:
    out: dict = {}
    for k, v in json.loads(s).items():
        at = out
        *path, last = k.split(".")
        for p in path:
            at = at.setdefault(p, {})
        at[last] = v
    return json.dumps(out, ensure_ascii=False)


json_flatten, json_unflatten = text_udf(_flat), text_udf(_deep)


def xml_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def xml_unescape(x: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _utf8(x: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts of a batch as one run of bytes (with eight more behind it), where each begins, its length, and which aren't null."""
    arr = pa.array(x, pa.string(), from_pandas=True)
    offsets = np.frombuffer(arr.buffers()[1], np.int32)[: len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] else np.empty(0, np.uint8)
    return np.concatenate([data, np.zeros(8, np.uint8)]), offsets[:-1], np.diff(offsets), ~np.asarray(arr.is_null())


def _steps(length: np.ndarray, width: int = 1):
    """For each position the rows that reach it: all rows of a batch take a step together."""
    order = np.argsort(-length, kind="stable")
    rest = np.sort(length)
    for at in range(0, int(length.max(initial=0)) - width + 1, width):
        yield at, order[: len(rest) - np.searchsorted(rest, at + width)]


def _numbers(values: np.ndarray, ok: np.ndarray) -> pd.Series:
    return pd.Series(values.astype(np.uint64).view(np.int64)).astype("Int64").where(ok)


def bytes_hash(prime: int, start: int, bits: int, first_xor: bool):
    mask = np.uint64((1 << bits) - 1)

    @F.pandas_udf(KINDS["bigint"])
    def g(x: pd.Series) -> pd.Series:
        data, begin, length, ok = _utf8(x)
        v = np.full(len(x), start, np.uint64)
        with np.errstate(over="ignore"):
            for at, rows in _steps(length):
                byte = data[begin[rows] + at].astype(np.uint64)
                v[rows] = ((v[rows] ^ byte) * np.uint64(prime)) & mask if first_xor else ((v[rows] * np.uint64(prime)) & mask) ^ byte
        return _numbers(v, ok)

    return lambda x: g(x.cast("string"))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


@F.pandas_udf(KINDS["bigint"])
def _murmur(x: pd.Series) -> pd.Series:
    data, begin, length, ok = _utf8(x)
    h, byte = np.zeros(len(x), np.uint32), np.arange(4)
    mix = lambda k: _rot(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    with np.errstate(over="ignore"):
        for at, rows in _steps(length, 4):
            k = np.ascontiguousarray(data[(begin[rows] + at)[:, None] + byte]).view("<u4")[:, 0]
            h[rows] = _rot(h[rows] ^ mix(k), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        tail = length % 4
        last = data[(begin + length - tail)[:, None] + byte] * (byte < tail[:, None]).astype(np.uint8)
        h ^= np.where(tail > 0, mix(np.ascontiguousarray(last).view("<u4")[:, 0]), np.uint32(0))
        h ^= length.astype(np.uint32)
        for shift, mul in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(mul)
        h ^= h >> np.uint32(16)
    return _numbers(h, ok)


def murmur3_32(x: Column) -> Column:
    return _murmur(x.cast("string"))


def _xx(bits: int):
    def h(s: str) -> int:
        import xxhash

        v = (xxhash.xxh32 if bits == 32 else xxhash.xxh64)(s.encode(), seed=0).intdigest()
        return v - (1 << 64) if v >= 1 << 63 else v

    return text_udf(h, "bigint")


xxh32, xxh64 = _xx(32), _xx(64)


def jump_hash(key: Column, buckets: Column) -> Column:
    @F.pandas_udf(KINDS["int"])
    def g(k: pd.Series, n: pd.Series) -> pd.Series:
        ok = (k.notna() & n.notna()).to_numpy()
        x = k.fillna(0).to_numpy(np.int64).view(np.uint64).copy()
        m = np.where(ok, n.fillna(0), 0).astype(np.int64)
        b, j = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
        with np.errstate(over="ignore"):
            while len(rows := np.flatnonzero(j < m)):
                b[rows] = j[rows]
                x[rows] = x[rows] * np.uint64(2862933555777941757) + np.uint64(1)
                j[rows] = ((b[rows] + 1) * (2.0**31 / ((x[rows] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        return pd.Series(b).astype("Int64").where(ok)

    return g(key, buckets)


def _jw(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    hit_a, hit_b = [False] * len(a), [False] * len(b)
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not hit_b[j] and b[j] == x:
                hit_a[i] = hit_b[j] = True
                break
    m = sum(hit_a)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip([x for x, h in zip(a, hit_a, strict=True) if h], [y for y, h in zip(b, hit_b, strict=True) if h], strict=True)) / 2
    j = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return j + same * 0.1 * (1 - j)


def jaro_winkler(a: Column, b: Column) -> Column:
    @F.pandas_udf(KINDS["double"])
    def g(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else _jw(u, v) for u, v in zip(x, y, strict=True)], dtype="float64")

    return g(a, b)
