"""Library functions by name, each against its value."""

import math

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import registry

CASES = [
    ("apoc.coll.avg", ([1, 2, 3],), 2.0), ("apoc.coll.subtract", ([1, 2, 3], [2]), [1, 3]), ("apoc.coll.disjunction", ([1, 2], [2, 3]), [1, 3]), ("apoc.coll.duplicates", ([1, 1, 2],), [1]),
    ("apoc.coll.partition", ([1, 2, 3], 2), [[1, 2], [3]]), ("apoc.coll.dropduplicateneighbors", ([1, 1, 2, 1],), [1, 2, 1]), ("apoc.coll.insertall", ([1, 4], 1, [2, 3]), [1, 2, 3, 4]), ("apoc.coll.different", ([1, 2],), True),
    ("apoc.text.capitalizeall", ("ab cd",), "Ab Cd"), ("apoc.text.swapcase", ("aB",), "Ab"), ("apoc.text.hammingdistance", ("karolin", "kathrin"), 3), ("apoc.text.indexesof", ("abcabc", "bc"), [1, 4]), ("apoc.text.base64encode", ("hi",), "aGk="),
    ("apoc.text.jarowinklerdistance", ("MARTHA", "MARHTA"), pytest.approx(0.9611, abs=1e-4)), ("apoc.text.sorensendicesimilarity", ("night", "nacht"), 0.25), ("apoc.text.repeat", ("ab", 2), "abab"), ("apoc.text.urlencode", ("a b",), "a+b"),
    ("apoc.math.sigmoid", (0.0,), 0.5), ("apoc.math.factorial", (5,), 120), ("apoc.math.nextprime", (13,), 17), ("apoc.math.lerp", (0.0, 10.0, 0.5), 5.0), ("apoc.math.isprime", (91,), False), ("apoc.math.gcd", (0, 5), 5),
    ("apoc.number.tobase", (255, 16), "ff"), ("apoc.number.frombinary", ("101",), 5), ("apoc.number.iseven", (4,), True), ("apoc.number.map", (5.0, 0.0, 10.0, 0.0, 100.0), 50.0),
    ("apoc.bitwise.op", (6, "&", 3), 2), ("apoc.bitwise.setbit", (1, 2), 5), ("apoc.bitwise.testbit", (5, 1), False), ("apoc.bitwise.rotateleft", (1, 1), 2), ("apoc.bitwise.countbits", (7,), 3),
    ("apoc.hashing.fnv1a", ("a",), 3826002220), ("apoc.hashing.murmurhash3", ("hello",), 613153351), ("apoc.hashing.sha1", ("a",), "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"), ("apoc.hashing.xxhash32", ("",), 46947589),
    ("apoc.json.path", ('{"a": {"b": 1}}', "$.a.b"), "1"), ("apoc.json.size", ("[1, 2]",), 2), ("apoc.json.type", ('{"a": 1}',), "object"), ("apoc.json.flatten", ('{"a": {"b": 1}}',), '{"a.b": 1}'), ("apoc.convert.toboolean", ("TRUE",), True),
    ("apoc.scoring.jaccard", ([1, 2], [2, 3]), pytest.approx(1 / 3)), ("apoc.scoring.manhattan", ([1.0, 2.0], [2.0, 4.0]), 3.0), ("apoc.scoring.pearson", ([1.0, 2.0, 3.0], [2.0, 4.0, 6.0]), pytest.approx(1.0)), ("apoc.stats.iqr", ([1.0, 2.0, 3.0, 4.0],), 1.5),
    ("apoc.temporal.isleapyear", ("2024-05-01",), True), ("apoc.temporal.daysinmonth", ("2024-02-01",), 29), ("apoc.temporal.isweekend", ("2024-06-01",), True), ("apoc.temporal.difference", ("2024-01-01", "2024-01-03", "days"), 2), ("date.week", ("2024-01-01",), 1),
    ("apoc.util.md5", ("a",), "0cc175b9c0f1b6a831c399e269772661"), ("apoc.xml.escape", ("<a>",), "&lt;a&gt;"), ("vector.similarity.cosine", ([1.0, 0.0], [1.0, 1.0]), pytest.approx(math.sqrt(0.5))), ("vector.similarity.euclidean", ([0.0, 0.0], [3.0, 4.0]), pytest.approx(1 / 6)),
    ("head", ([],), None), ("tail", ([1, 2],), [2]), ("lpad", ("a", 3, "x"), "xxa"), ("haversin", (0.0,), 0.0), ("normalize", ("é",), "é"), ("nullif", (1, 1), None), ("split", ("a.b", "."), ["a", "b"]),
]


@pytest.fixture(scope="module")
def values(spark):
    """All cases in one query."""
    lit = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) and v else F.expr("cast(array() as array<int>)") if v == [] else F.lit(v)
    cols = [registry.lookup(n)(*[lit(a) for a in args]).alias(f"c{i}") for i, (n, args, _) in enumerate(CASES)]
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0] for c in CASES])
def test_value(values, i):
    assert values[i] == CASES[i][2]


def test_nulls_stay_null(spark):
    for n in ("toupper", "apoc.text.capitalize", "apoc.math.sigmoid", "tointeger", "apoc.text.clean", "normalize"):
        assert spark.range(1).select(registry.lookup(n)(F.lit(None).cast("string" if "math" not in n else "double")).alias("x")).first().x is None


def test_durations_and_points(spark):
    d = registry.lookup("duration")(F.lit("P1Y2M3DT4H5M6.5S"))
    r = spark.range(1).select(d.alias("d"), registry.lookup("duration.inseconds")(d).alias("s")).first()
    assert (r.d.months, r.d.days, r.d.seconds, r.d.nanos) == (14, 3, 14706, 500_000_000) and r.s == (14 * 30 + 3) * 86400 + 14706.5
    p = lambda a, b: F.struct(F.lit(a).alias("latitude"), F.lit(b).alias("longitude"))
    x = spark.range(1).select(registry.lookup("apoc.spatial.distance")(p(0.0, 0.0), p(0.0, 1.0)).alias("m")).first().m * 1000
    assert x == pytest.approx(111194.9, abs=1)


def test_register_own(spark):
    registry.register("my.twice", lambda x: x * 2)
    assert spark.range(1).select(registry.lookup("MY.twice")(F.lit(4)).alias("x")).first().x == 8


def test_hashes_of_batches(spark):
    """Hashes worked out for whole batches against the same byte by byte."""
    import random

    from loomgraph.functions import arrow_functions as arrow

    def fnv(s, prime, start, bits, first_xor):
        v, mask = start, (1 << bits) - 1
        for b in s.encode():
            v = ((v ^ b) * prime) & mask if first_xor else ((v * prime) & mask) ^ b
        return v - (1 << 64) if v >= 1 << 63 else v

    def jump(x, n):
        x, b, j = x & (2**64 - 1), -1, 0
        while j < n:
            x, b = (x * 2862933555777941757 + 1) & (2**64 - 1), j
            j = int((b + 1) * (2**31 / ((x >> 33) + 1)))
        return b

    r = random.Random(1)
    texts = [None, "", "a", "abcd", "日本語", *["".join(r.choice("abcé日x ") for _ in range(r.randrange(60))) for _ in range(100)]]
    kinds = [(1099511628211, 14695981039346656037, 64, True), (1099511628211, 14695981039346656037, 64, False), (16777619, 2166136261, 32, True)]
    df = spark.createDataFrame([(t, r.randrange(-(2**62), 2**62), r.randrange(1, 50)) for t in texts], "t string, k bigint, n int").repartition(3)
    got = df.select("*", *[arrow.bytes_hash(*x)(F.col("t")).alias(f"h{i}") for i, x in enumerate(kinds)], arrow.jump_hash(F.col("k"), F.col("n")).alias("j"), arrow.murmur3_32(F.col("t")).alias("m")).collect()
    for g in got:
        assert [g[f"h{i}"] for i in range(3)] == [None if g.t is None else fnv(g.t, *x) for i, x in enumerate(kinds)] and g.j == jump(g.k, g.n)
    assert {g.t: g.m for g in got if g.t in ("", "a")} == {"": 0, "a": 0x3C2569B2}
    assert df.limit(0).select(arrow.murmur3_32(F.col("t"))).collect() == []
