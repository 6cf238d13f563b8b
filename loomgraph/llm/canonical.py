"""One stored form for texts that look the same.

A table from grapheme cluster to its one form is built once a process, checked for
conflicts on the driver, and applied by a compiled longest-match pattern in a single pass:

* full-width and half-width forms take their usual width,
* every kind of space becomes U+0020,
* invisible characters go (a joiner between two pictographs stays: it shows),
* a letter and its accents become one character where there is one,
* letters of Greek, Cyrillic, Coptic, Armenian, Cherokee and Lisu that look like a Latin letter
  become that letter.

Case, punctuation, line breaks, tabs and visible accents are left alone, and so are ligatures,
numerals as one character and lettering styles, which show. The table holds every base with
its accents that has a character of its own, and the look-alikes of such bases; a cluster it
doesn't hold (several accents in a row, invisible characters between) is made by the rule that
made the table.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut

# Kinds of space, invisible characters, letters that look like a Latin letter.
SPACES = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
INVISIBLE = "".join(map(chr, [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), *range(0xFE00, 0xFE10), 0xFEFF]))
ALIKE = {
    "АВЕКМНОРСТУХЅІЈԌԚԜҮ": "ABEKMHOPCTYXSIJGQWY",
    "аеорсухѕіјһԁԛԝӏү": "aeopcyxsijhdqwly",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "ονϲϳ": "ovcj",
    "ⲞⲢⲤⲎⲔⲘⲚⲦⲬⲟⲣⲥ": "OPCHKMNTXopc",
    "ՕօսհոցյՍ": "OouhngjU",
    "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ": "ABCDEGHJKLMPRSTVWZ",
    "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ": "ABCDEFGHIJKLMNOPRSTUVWXYZ",
    "Ѵѵ": "Vv",
}

LATIN = {a: b for k, v in ALIKE.items() for a, b in zip(k, v, strict=True)}


def _width(ch: str) -> str:
    o = ord(ch)
    if o == 0xFF9E or o == 0xFF9F:
        return chr(0x3099) if o == 0xFF9E else chr(0x309A)
    return unicodedata.normalize("NFKC", ch) if 0xFF01 <= o <= 0xFFEE else ch


def _cluster(s: str) -> str:
    """The form of one cluster: a base and what follows it, or a run of lone mapped characters."""
    out = []
    for ch in s:
        if ch in _INVISIBLE:
            continue
        ch = " " if ch in _SPACES else _width(ch)
        for d in unicodedata.normalize("NFD", ch):
            out.append(LATIN.get(d, d))
    return unicodedata.normalize("NFC", "".join(out))


_SPACES, _INVISIBLE = frozenset(SPACES), frozenset(INVISIBLE)


def _ranges(chars: list[int]) -> str:
    runs: list[list[int]] = []
    for c in chars:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def _composed() -> list[int]:
    """Characters that are a base with accents, by their canonical decomposition."""
    return [c for c in range(0xC0, 0x30000) if not 0xAC00 <= c <= 0xD7A3 and (d := unicodedata.decomposition(chr(c))) and d[0] != "<"]


@lru_cache(1)
def mapping() -> tuple[dict[str, str], dict[int, str]]:
    """Form by cluster, for clusters of several characters; and by character, for single ones that change."""
    alike: dict[str, list[str]] = {}
    for a, b in LATIN.items():
        alike.setdefault(b, [b]).append(a)
    clusters: dict[str, str] = {}
    singles = {c: _cluster(chr(c)) for c in [*map(ord, SPACES + INVISIBLE + "".join(LATIN)), *range(0xFF01, 0xFFEF)]}
    for c in _composed():
        parts, form = unicodedata.normalize("NFD", chr(c)), _cluster(chr(c))
        singles[c] = form
        for base in alike.get(parts[0], [parts[0]]):
            source = base + parts[1:]
            if len(source) > 1 and clusters.setdefault(source, _cluster(source)) != _cluster(source):
                raise ValueError(f"two forms of {source!r}")
    return clusters, {c: f for c, f in singles.items() if f != chr(c)}


@lru_cache(1)
def checked() -> int:
    """The number of entries of the table; raises if it has a conflict.

    A form must be its own form, a cluster and the character that composes it must have one form, and
    an accent put on a character must give the same as put on the character's form.
    """
    clusters, singles = mapping()
    marks = sorted({m for s in clusters for m in s[1:] if unicodedata.combining(m)})
    for source, form in [*clusters.items(), *((chr(c), f) for c, f in singles.items())]:
        if _cluster(form) != form:
            raise ValueError(f"the form of {source!r} would itself be mapped")
        if canonical(unicodedata.normalize("NFC", source)) != form or canonical(unicodedata.normalize("NFD", source)) != form:
            raise ValueError(f"{source!r} has another form when composed or taken apart")
        if form and form != " " and len(source) == 1:
            for m in marks:
                if _cluster(source + m) != _cluster(form + m):
                    raise ValueError(f"U+{ord(m):04X} on {source!r} and on its form differ")
    return len(clusters) + len(singles)


@lru_cache(1)
def transducer() -> re.Pattern[str]:
    """The compiled pattern; group 1 is a run of single characters that change each by itself."""
    # Accents, and vowel signs that aren't combining by class but compose with what they follow.
    follow = {ord(x) for s in mapping()[0] for x in s[1:]}
    marks = sorted({c for c in range(0x300, 0x1E8E0) if unicodedata.combining(chr(c))} | follow | {0xFF9E, 0xFF9F})
    m, inv, lone = _ranges(marks), _ranges(sorted(map(ord, INVISIBLE))), _ranges(sorted(c for c in mapping()[1] if c != 0x200D and not unicodedata.combining(chr(c)) and not 0xFF9E <= c <= 0xFFDC))
    pictograph = r"\U0001f000-\U0001faff\u2600-\u27bf"
    joiner = rf"\u200d(?![{pictograph}])"
    lead, vowel, final = r"[\u1100-\u1112\uffa1-\uffbe]", r"[\u1161-\u1175\uffc2-\uffdc]", r"[\u11a8-\u11c2]"
    jamo = f"{lead}[{inv}]*{vowel}(?:[{inv}]*{final})?|[\uac00-\ud7a3][{inv}]*{final}|[\uffa0-\uffdc]+"
    return re.compile(f"(?:\\A|[^{m}{inv}])(?:[{inv}]*[{m}])+|(?:{jamo})(?:[{inv}]*[{m}])*|((?:[{lone}](?![{inv}]*[{m}])|{joiner})+)", re.DOTALL)


@lru_cache(50_000)
def _made(s: str) -> str:
    return _cluster(s)


def canonical(text: str) -> str:
    """The one form of a text. Text of ASCII characters only is its own form."""
    if text.isascii():
        return text
    clusters, singles = mapping()

    def form(m: re.Match[str]) -> str:
        if m.lastindex:
            return m.group().translate(singles)
        s = m.group()
        f = clusters.get(s)
        return _made(s) if f is None else f

    return transducer().sub(form, text)


def _canonical_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        new = [None if x is None else canonical(x) for x in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(new, pa.string())], names=b.schema.names)


def canonical_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key`` and ``text``: each text in its one form; null stays null, empty stays empty."""
    checked()
    kind = dict(df.dtypes)[key]
    return df.select(F.col(key), F.col(text)).mapInArrow(_canonical_batches, f"`{key}` {kind}, `{text}` string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> key, digest of the text as stored, digest of its form; texts without a visible character go."""
    for b in batches:
        keep, raw, form = [], [], []
        for i, x in enumerate(b.column(1).to_pylist()):
            y = canonical(x)
            if not y or y.isspace():
                continue
            keep.append(i)
            z = x.encode("utf-8", "surrogatepass")
            raw.append(hashlib.blake2b(z, digest_size=16).digest())
            form.append(raw[-1] if x == y else hashlib.blake2b(y.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([pc.take(b.column(0), pa.array(keep, pa.int64())), pa.array(raw, pa.binary()), pa.array(form, pa.binary())], names=["id", "raw", "form"])


def _digests(df: DataFrame, key: str, text: str) -> DataFrame:
    checked()
    return df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).filter("id is not null and t is not null").mapInArrow(_digest, "id bigint, raw binary, form binary").distinct()


def look_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, class_id, members, ways``: one row for each text with a visible character.

    ``class_id`` is the least id of those that look the same, copies included, ``members`` their number and
    ``ways`` the number of different stored texts among them. Nothing is expanded into pairs. An id that is
    there twice with different texts has a row for each class it is in.
    """
    d = cut(_digests(df, key, text))
    ways = d.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    classes = ways.groupBy("form").agg(F.min("least").alias("class_id"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("ways"))
    return d.join(classes, "form").select("id", "class_id", "members", "ways").distinct()


def look_alikes(df: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """Pairs ``a`` < ``b`` of ids whose texts are stored differently but have one form.

    Only forms that are stored in two or more ways are kept before anything is joined,
    so standard texts that recur unchanged cost one grouped row each. Pairs are made
    between the stored ways of a form, then given to the ids on both sides; the ids of
    a way are salted, so that a way that a third of all rows share is spread over tasks.
    Null texts, and texts without a visible character, make no pair; an empty table gives none.
    """
    d = cut(_digests(df, key, text))  # two digests a text, read three times below
    ways = d.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n"))
    shown = ways.groupBy("form").agg(F.count(F.lit(1)).alias("ways")).filter("ways > 1").select("form")
    d = d.join(shown, "form", "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    left = d.select("form", "salt", F.col("id").alias("x"), F.col("raw").alias("rx"))
    right = d.select("form", F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("salt"), F.col("id").alias("y"), F.col("raw").alias("ry"))
    return left.join(right, ["form", "salt"]).filter("rx <> ry and x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
