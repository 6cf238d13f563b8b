"""Functions of the query language by name: each is built from JVM-side expressions.

Names are matched without regard to case. Python is used only where no expression can
say it, and then in Arrow batches (``arrow_functions``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions import arrow_functions as A
from loomgraph.functions import spatial as S
from loomgraph.functions import temporal as T

Fn = Callable[..., Column]
L = F.lit


def sql(name: str) -> Fn:
    return lambda *a: F.call_function(name, *a)


def _fold(x: Column, start, f) -> Column:
    return F.aggregate(x, start, f)


def dotted(e) -> str | None:
    if e[0] == "var":
        return e[1]
    if e[0] == "prop" and (d := dotted(e[1])):
        return f"{d}.{e[2]}"
    return None


# ---------- aggregates: (distinct, columns...) -> column
def _collect(d: bool, x: Column) -> Column:
    return F.array_distinct(F.collect_list(x)) if d else F.collect_list(x)


AGGREGATES: dict[str, Callable[..., Column]] = {
    "count": lambda d, x: F.count_distinct(x) if d else F.count(x),
    "sum": lambda d, x: F.coalesce(F.sum_distinct(x) if d else F.sum(x), L(0)),
    "avg": lambda d, x: _fold(F.array_distinct(F.collect_list(x)), L(0.0), lambda a, y: a + y) / F.count_distinct(x) if d else F.avg(x),
    "min": lambda d, x: F.min(x),
    "max": lambda d, x: F.max(x),
    "collect": _collect,
    "stdev": lambda d, x: F.coalesce(F.stddev_samp(x), L(0.0)),
    "stdevp": lambda d, x: F.coalesce(F.stddev_pop(x), L(0.0)),
    "percentilecont": lambda d, x, p: F.percentile(x, p),
    "percentiledisc": lambda d, x, p: F.element_at(F.array_sort(F.collect_list(x)), F.greatest(F.ceil(p * F.count(x)), L(1)).cast("int")),
    "apoc.agg.first": lambda d, x: F.first(x, ignorenulls=True),
    "apoc.agg.last": lambda d, x: F.last(x, ignorenulls=True),
    "apoc.agg.nth": lambda d, x, n: F.get(F.collect_list(x), n.cast("int")),
    "apoc.agg.slice": lambda d, x, a, n: F.slice(F.collect_list(x), (a + 1).cast("int"), n.cast("int")),
    "apoc.agg.product": lambda d, x: F.product(x),
    "apoc.agg.median": lambda d, x: F.median(x),
    "apoc.agg.percentile": lambda d, x, p: F.percentile(x, p),
    "apoc.agg.percentiles": lambda d, x, p: F.percentile(x, p),
    "apoc.agg.stdev": lambda d, x: F.stddev_pop(x),
    "apoc.agg.mode": lambda d, x: F.mode(x),
    "apoc.agg.statistics": lambda d, x: F.struct(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.sum(x).alias("sum"), F.stddev_pop(x).alias("stdev"), F.median(x).alias("median")),
    "apoc.agg.minitems": lambda d, x, n: F.slice(F.array_sort(F.collect_list(x.cast("double"))), L(1), n.cast("int")),
    "apoc.agg.maxitems": lambda d, x, n: F.slice(F.reverse(F.array_sort(F.collect_list(x.cast("double")))), L(1), n.cast("int")),
    "apoc.agg.frequencies": lambda d, x: frequencies(F.collect_list(x)),
    "apoc.agg.histogram": lambda d, x, w: frequencies(F.transform(F.collect_list(x), lambda v: F.floor(v / w))),
    "apoc.agg.graph": lambda d, p: F.struct(F.array_distinct(F.flatten(F.collect_list(p.getField("nodes")))).alias("nodes"), F.array_distinct(F.flatten(F.collect_list(p.getField("rels")))).alias("relationships")),
    "apoc.stats.skewness": lambda d, x: F.skewness(x),
    "apoc.stats.kurtosis": lambda d, x: F.kurtosis(x),
    "apoc.stats.correlation": lambda d, x, y: F.corr(x, y),
    "apoc.stats.covariance": lambda d, x, y: F.covar_pop(x, y),
}


# ---------- lists
def _num(x: Column) -> Column:
    return x.cast("array<double>")


def list_sum(x: Column) -> Column:
    return _fold(_num(x), L(0.0), lambda a, y: a + y)


def list_mean(x: Column) -> Column:
    return F.try_divide(list_sum(x), F.size(x))


def list_var(x: Column) -> Column:
    m = list_mean(x)
    return F.try_divide(_fold(_num(x), L(0.0), lambda a, y: a + (y - m) * (y - m)), F.size(x))


def list_pct(x: Column, p: Column) -> Column:
    """Linear between the two nearest ranks."""
    s = F.array_sort(_num(x))
    at = p * (F.size(s) - 1)
    lo = F.floor(at).cast("int")
    return F.get(s, lo) + (at - lo) * (F.coalesce(F.get(s, lo + 1), F.get(s, lo)) - F.get(s, lo))


def list_mode(x: Column) -> Column:
    n = lambda v: F.size(F.filter(x, lambda y: y == v))
    return F.array_max(F.transform(F.array_distinct(x), lambda v: F.struct(n(v).alias("n"), v.alias("v")))).getField("v")


def frequencies(x: Column) -> Column:
    return F.transform(F.array_distinct(x), lambda v: F.struct(v.alias("item"), F.size(F.filter(x, lambda y: y.eqNullSafe(v))).alias("count")))


def duplicates(x: Column) -> Column:
    return F.filter(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda y: y == v)) > 1)


def partition(x: Column, n: Column) -> Column:
    n = n.cast("int")
    starts = F.filter(F.sequence(L(1), F.greatest(F.size(x), L(1)), n), lambda i: i <= F.size(x))
    return F.transform(starts, lambda i: F.slice(x, i, n))


def tail(x: Column) -> Column:
    return F.slice(x, 2, F.greatest(F.size(x) - 1, L(0)))


def pairs(x: Column) -> Column:
    return F.transform(x, lambda v, i: F.array(v, F.get(x, i + 1)))


def insert_all(x: Column, i: Column, ys: Column) -> Column:
    i = i.cast("int")
    return F.concat(F.slice(x, L(1), i), ys, F.slice(x, i + 1, F.greatest(F.size(x) - i, L(0))))


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(_num(a), _num(b), lambda x, y: x * y), L(0.0), lambda s, z: s + z)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def distance2(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(F.zip_with(_num(a), _num(b), lambda x, y: (x - y) * (x - y)), L(0.0), lambda s, z: s + z))


# ---------- text
def words(x: Column) -> Column:
    """The parts of an identifier or phrase: at separators and at changes from lower to upper case."""
    return F.filter(F.split(F.regexp_replace(x, r"(\p{Ll}|\d)(\p{Lu})", "$1 $2"), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def cap(w: Column) -> Column:
    return F.concat(F.upper(F.left(w, L(1))), F.substr(w, L(2)))


def lower_first(w: Column) -> Column:
    return F.concat(F.lower(F.left(w, L(1))), F.substr(w, L(2)))


def upper_camel(x: Column) -> Column:
    return F.array_join(F.transform(words(x), lambda w: cap(F.lower(w))), "")


def clean(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))


def bigrams(x: Column) -> Column:
    s = F.lower(x)
    return F.transform(F.filter(F.sequence(L(1), F.greatest(F.length(s) - 1, L(1))), lambda i: i < F.length(s)), lambda i: F.substr(s, i, L(2)))


def dice(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(bigrams(a)), F.array_distinct(bigrams(b))
    return F.try_divide(2.0 * F.size(F.array_intersect(x, y)), F.size(x) + F.size(y))


def quoted_split(x: Column, d: Column) -> Column:
    return F.split(x, F.concat(L("\\Q"), d, L("\\E")))


def index_of(x: Column, y: Column) -> Column:
    return F.call_function("locate", y, x) - 1


def indexes_of(x: Column, y: Column) -> Column:
    at = F.filter(F.sequence(L(1), F.greatest(F.length(x), L(1))), lambda i: F.substr(x, i, F.length(y)) == y)
    return F.transform(at, lambda i: i - 1)


def hamming(a: Column, b: Column) -> Column:
    d = _fold(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), L(0), lambda s, z: s + F.coalesce(z, L(0)))
    return F.when(F.length(a) == F.length(b), d)


def swap_case(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, ""), lambda c: F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c))), "")


# ---------- maps
def map_set(m: Column, k: Column, v: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda a, _: a != k), F.create_map(k, v))


def map_merge(a: Column, b: Column) -> Column:
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def json_map(x: Column) -> Column:
    return F.from_json(x, "map<string,string>")


def json_list(x: Column) -> Column:
    return F.from_json(x, "array<string>")


# ---------- numbers
def half_away(x: Column, digits: Column | None = None) -> Column:
    return F.round(x) if digits is None else F.round(x, digits)


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(x, lo), hi)


def is_prime(n: Column) -> Column:
    root = F.greatest(F.floor(F.sqrt(n)).cast("bigint"), L(2).cast("bigint"))
    return (n > 1) & ~F.exists(F.sequence(L(2).cast("bigint"), root), lambda d: (n % d == 0) & (d < n))


def gcd(a: Column, b: Column) -> Column:
    """Euclid in at most 92 steps, which suffices for any two 64-bit numbers."""
    step = lambda s, _: F.when(s.getField("y") == 0, s).otherwise(F.struct(s.getField("y").alias("x"), (F.try_mod(s.getField("x"), s.getField("y"))).alias("y")))
    start = F.struct(F.abs(a.cast("bigint")).alias("x"), F.abs(b.cast("bigint")).alias("y"))
    return F.aggregate(F.sequence(L(1), L(92)), start, step).getField("x")


def lcm(a: Column, b: Column) -> Column:
    return F.try_divide(F.abs(a * b), gcd(a, b)).cast("bigint")


def fibonacci(n: Column) -> Column:
    pair = F.struct(L(0).cast("bigint").alias("a"), L(1).cast("bigint").alias("b"))
    run = F.aggregate(F.sequence(L(1), F.greatest(n.cast("int"), L(1))), pair, lambda s, _: F.struct(s.getField("b").alias("a"), (s.getField("a") + s.getField("b")).alias("b")))
    return F.when(n <= 0, L(0).cast("bigint")).otherwise(run.getField("a"))


def rotate(left: bool) -> Fn:
    def f(x: Column, n: Column) -> Column:
        x, n = x.cast("bigint"), n.cast("int")
        up, down = F.call_function("shiftleft", x, n), F.call_function("shiftrightunsigned", x, 64 - n)
        if not left:
            up, down = F.call_function("shiftleft", x, 64 - n), F.call_function("shiftrightunsigned", x, n)
        return up.bitwiseOR(down)

    return f


def bit(n: Column) -> Column:
    return F.call_function("shiftleft", L(1).cast("bigint"), n.cast("int"))


def bit_op(a: Column, op: Column, b: Column) -> Column:
    c = F.when(op == "&", a.bitwiseAND(b)).when(op == "|", a.bitwiseOR(b)).when(op == "^", a.bitwiseXOR(b))
    return c.when(op == "<<", F.call_function("shiftleft", a, b.cast("int"))).when(op == ">>", F.call_function("shiftright", a, b.cast("int")))


ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def romanize(n: Column) -> Column:
    out, rest = L(""), n.cast("int")
    for v, s in ROMAN:
        k = F.floor(rest / v).cast("int")
        out, rest = F.concat(out, F.repeat(L(s), k)), rest - k * v
    return out


def arabize(s: Column) -> Column:
    value = F.create_map(*[x for v, k in ROMAN if len(k) == 1 for x in (L(k), L(v))])
    each = F.transform(F.split(F.upper(s), ""), lambda c: value[c])
    return _fold(F.transform(each, lambda v, i: F.when(v < F.coalesce(F.get(each, i + 1), L(0)), -v).otherwise(v)), L(0), lambda a, v: a + v)


def base(n: Column, b: Column) -> Column:
    return F.call_function("conv", n.cast("string"), L(10), b.cast("int"))


def from_base(s: Column, b: Column) -> Column:
    return F.call_function("conv", s, b.cast("int"), L(10)).cast("bigint")


def fnv(prime: int, start: int, bits: int, first_xor: bool) -> Fn:
    return A.bytes_hash(prime, start, bits, first_xor)


def value_type(x: Column) -> Column:
    t = F.call_function("typeof", x)
    c = F.when(x.isNull(), "NULL").when(t.isin("bigint", "int", "smallint", "tinyint"), "INTEGER").when(t.isin("double", "float"), "FLOAT").when(t == "string", "STRING")
    return c.when(t == "boolean", "BOOLEAN").when(t.startswith("array"), "LIST").when(t.startswith("map") | t.startswith("struct"), "MAP").otherwise(F.upper(t))


def kind_of(x: Column) -> Column:
    return value_type(x)


def same_kind(x: Column, t: Column) -> Column:
    return kind_of(x) == F.upper(t)


def to_int(x: Column) -> Column:
    return F.coalesce(x.try_cast("bigint"), x.try_cast("double").try_cast("bigint"))


def to_bool(x: Column) -> Column:
    s = F.lower(x.cast("string"))
    return F.when(s == "true", True).when(s == "false", False)


def each(f: Fn) -> Fn:
    return lambda x: F.transform(x, f)


def softmax(x: Column) -> Column:
    top = F.array_max(_num(x))
    ex = F.transform(_num(x), lambda v: F.exp(v - top))
    return F.transform(ex, lambda v: v / _fold(ex, L(0.0), lambda a, y: a + y))


def substring0(x: Column, at: Column, n: Column | None = None) -> Column:
    return F.substr(x, (at + 1).cast("int")) if n is None else F.substr(x, (at + 1).cast("int"), n.cast("int"))


def pad(f: str) -> Fn:
    return lambda x, n, p=None: F.call_function(f, x.cast("string"), n.cast("int"), p if p is not None else L(" "))


FUNCTIONS: dict[str, Fn] = {
    # core scalar, list and conversion functions
    "coalesce": F.coalesce,
    "exists": lambda x: x.isNotNull(),
    "head": lambda x: F.get(x, L(0)),
    "last": lambda x: F.try_element_at(x, L(-1)),
    "tail": tail,
    "reverse": F.reverse,
    "range": lambda a, b, s=None: F.filter(F.sequence(a, F.when(F.sign(b - a) * F.sign(s if s is not None else L(1)) >= 0, b).otherwise(a), s if s is not None else L(1)), lambda x: F.sign(b - a) * F.sign(s if s is not None else L(1)) >= 0),
    "slice": lambda x, a, b=None: F.slice(x, (a + 1).cast("int"), ((b if b is not None else F.size(x)) - a).cast("int")),
    "indexof": lambda x, v: F.array_position(x, v) - 1,
    # size, length and isempty depend on the type and are settled by the lowering; here for lists
    "size": F.size,
    "length": F.size,
    "isempty": lambda x: F.size(x) == 0,
    "isnan": F.isnan,
    "nullif": F.nullif,
    "tostring": lambda x: x.cast("string"),
    "tostringornull": lambda x: x.cast("string"),
    "tointeger": to_int,
    "toint": to_int,
    "tointegerornull": to_int,
    "tofloat": lambda x: x.try_cast("double"),
    "tofloatornull": lambda x: x.try_cast("double"),
    "toboolean": to_bool,
    "tobooleanornull": to_bool,
    "tointegerlist": each(to_int),
    "tofloatlist": each(lambda x: x.try_cast("double")),
    "tobooleanlist": each(to_bool),
    "tostringlist": each(lambda x: x.cast("string")),
    "valuetype": value_type,
    "keys": F.map_keys,
    "tolower": F.lower,
    "lower": F.lower,
    "toupper": F.upper,
    "upper": F.upper,
    "trim": F.trim,
    "ltrim": F.ltrim,
    "rtrim": F.rtrim,
    "btrim": F.btrim,
    "replace": F.replace,
    "split": quoted_split,
    "substring": substring0,
    "left": F.left,
    "right": F.right,
    "lpad": pad("lpad"),
    "rpad": pad("rpad"),
    "format": sql("format_string"),
    "char_length": F.char_length,
    "character_length": F.char_length,
    "normalize": A.normalize_nfc,
    "abs": F.abs,
    "ceil": F.ceil,
    "floor": F.floor,
    "round": half_away,
    "sign": lambda x: F.sign(x).cast("int"),
    "randomuuid": lambda: F.uuid(),
    "rand": lambda: F.rand(),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "cot": F.cot, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2,
    "exp": F.exp, "log": F.ln, "log10": F.log10, "sqrt": F.sqrt, "radians": F.radians, "degrees": F.degrees,
    "haversin": lambda x: (1 - F.cos(x)) / 2,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "coth": lambda x: F.try_divide(L(1.0), F.tanh(x)), "power": F.pow,
    "pi": F.pi, "e": F.e,
    "vector.similarity.cosine": cosine,
    "vector.similarity.euclidean": lambda a, b: 1 / (1 + distance2(a, b)),
    # kalman states are JSON texts
    "kalman.init": T.kalman_init, "kalman.process": T.kalman_process, "kalman.predict": T.kalman_predict, "kalman.state": T.kalman_state, "kalman.reset": T.kalman_reset,
    "kalman.velocity.init": T.velocity_init, "kalman.velocity.process": T.velocity_process, "kalman.velocity.predict": T.velocity_predict,
    "kalman.adaptive.init": T.adaptive_init, "kalman.adaptive.process": T.adaptive_process,
    **T.FUNCTIONS,
    **S.FUNCTIONS,
}


def _space(name: str, **fs: Fn) -> None:
    for k, f in fs.items():
        FUNCTIONS[f"apoc.{name}.{k.strip('_').lower()}"] = f


_space(
    "coll",
    sum=list_sum, avg=list_mean, min=F.array_min, max=F.array_max, sort=F.array_sort, reverse=F.reverse, contains=F.array_contains,
    containsAll=lambda a, b: F.size(F.array_except(b, a)) == 0, containsAny=F.arrays_overlap, containsSorted=F.array_contains,
    containsDuplicates=lambda x: F.size(F.array_distinct(x)) < F.size(x), union=F.array_union, unionAll=F.concat, intersection=F.array_intersect, subtract=F.array_except,
    disjunction=lambda a, b: F.concat(F.array_except(a, b), F.array_except(b, a)), flatten=F.flatten, toSet=F.array_distinct, indexOf=lambda x, v: F.array_position(x, v) - 1,
    pairs=pairs, pairsMin=lambda x: F.slice(pairs(x), 1, F.greatest(F.size(x) - 1, L(0))), zip=F.arrays_zip, frequencies=frequencies,
    frequenciesAsMap=lambda x: F.map_from_entries(frequencies(x)), occurrences=lambda x, v: F.size(F.filter(x, lambda y: y == v)), duplicates=duplicates,
    duplicatesWithCount=lambda x: F.filter(frequencies(x), lambda s: s.getField("count") > 1), dropDuplicateNeighbors=lambda x: F.filter(x, lambda v, i: (i == 0) | (v != F.coalesce(F.get(x, i - 1), v))),
    fill=lambda v, n: F.array_repeat(v, n.cast("int")), insert=lambda x, i, v: F.array_insert(x, (i + 1).cast("int"), v), insertAll=insert_all,
    remove=lambda x, i, n=None: F.filter(x, lambda _, k: (k < i) | (k >= i + (n if n is not None else L(1)))), removeAll=lambda x, y: F.filter(x, lambda v: ~F.array_contains(y, v)),
    set=lambda x, i, v: F.transform(x, lambda y, k: F.when(k == i, v).otherwise(y)), slice=lambda x, a, n: F.slice(x, (a + 1).cast("int"), n.cast("int")), shuffle=F.shuffle,
    randomItem=lambda x: F.get(F.shuffle(x), L(0)), randomItems=lambda x, n: F.slice(F.shuffle(x), L(1), n.cast("int")), isEmpty=lambda x: F.size(x) == 0, isNotEmpty=lambda x: F.size(x) > 0,
    different=lambda x: F.size(F.array_distinct(x)) == F.size(x), sumLongs=lambda x: _fold(x.cast("array<bigint>"), L(0).cast("bigint"), lambda a, y: a + y), partition=partition, stdev=lambda x: F.sqrt(list_var(x)),
    sortMaps=lambda x, k: F.array_sort(x), split=lambda x, v: F.transform(F.filter(F.split(F.array_join(x.cast("array<string>"), "\x1f"), F.concat(L("\x1f?\\Q"), v.cast("string"), L("\\E\x1f?"))), lambda s: s != ""), lambda s: F.split(s, "\x1f")),
)
_space(
    "text",
    join=lambda x, d: F.call_function("array_join", x, d), split=F.split, replace=lambda x, r, y: F.regexp_replace(x, r, y), regexGroups=lambda x, r: F.regexp_extract_all(x, r, L(0)), capitalize=cap,
    capitalizeAll=lambda x: F.array_join(F.transform(F.split(x, " "), cap), " "), decapitalize=lower_first, decapitalizeAll=lambda x: F.array_join(F.transform(F.split(x, " "), lower_first), " "), swapCase=swap_case,
    camelCase=lambda x: lower_first(upper_camel(x)), upperCamelCase=upper_camel, snakeCase=lambda x: F.array_join(F.transform(words(x), F.lower), "_"), clean=clean, compareCleaned=lambda a, b: clean(a) == clean(b),
    distance=F.levenshtein, levenshteinDistance=F.levenshtein, levenshteinSimilarity=lambda a, b: 1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))),
    fuzzyMatch=lambda a, b: 1 - F.try_divide(F.levenshtein(F.lower(a), F.lower(b)), F.greatest(F.length(a), F.length(b))), hammingDistance=hamming, jaroWinklerDistance=A.jaro_winkler, lpad=pad("lpad"), rpad=pad("rpad"),
    format=sql("format_string"), repeat=lambda x, n: F.repeat(x, n.cast("int")), reverse=F.reverse, slug=lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", ""),
    sorensenDiceSimilarity=dice, trim=F.trim, ltrim=F.ltrim, rtrim=F.rtrim, urlencode=F.url_encode, urldecode=F.url_decode, base64Encode=lambda x: F.base64(F.encode(x, "UTF-8")), base64Decode=lambda x: F.decode(F.unbase64(x), "UTF-8"),
    indexOf=index_of, indexesOf=indexes_of, code=F.ascii, charAt=lambda x, i: F.ascii(F.substr(x, (i + 1).cast("int"), L(1))), fromCodePoint=sql("char"), bytes=lambda x: F.transform(F.sequence(L(1), F.octet_length(x)), lambda i: F.call_function("conv", F.substr(F.hex(F.encode(x, "UTF-8")), 2 * i - 1, L(2)), L(16), L(10)).cast("int")),
    bytesToString=lambda x: F.decode(F.unhex(F.array_join(F.transform(x, lambda b: F.lpad(F.hex(b), 2, "0")), "")), "UTF-8"), phonetic=F.soundex, phoneticDelta=lambda a, b: 4 - F.levenshtein(F.soundex(a), F.soundex(b)), doubleMetaphone=lambda x: F.array(F.soundex(x)),
    random=lambda n: F.substr(F.replace(F.uuid(), L("-"), L("")), L(1), n.cast("int")), toUpperCase=F.upper, toLowerCase=F.lower,
)
_space(
    "map",
    fromPairs=lambda x: F.map_from_entries(F.transform(x, lambda p: F.struct(p[0].alias("key"), p[1].alias("value")))), fromLists=F.map_from_arrays,
    fromValues=lambda x: F.map_from_entries(F.transform(partition(x, L(2)), lambda p: F.struct(F.get(p, L(0)).alias("key"), F.get(p, L(1)).alias("value")))), merge=map_merge,
    mergeList=lambda x: F.aggregate(tail(x), F.get(x, L(0)), map_merge), setKey=map_set, setEntry=map_set, setPairs=lambda m, x: map_merge(m, F.map_from_entries(F.transform(x, lambda p: F.struct(p[0].alias("key"), p[1].alias("value"))))),
    setLists=lambda m, k, v: map_merge(m, F.map_from_arrays(k, v)), removeKey=lambda m, k: F.map_filter(m, lambda a, _: a != k), removeKeys=lambda m, ks: F.map_filter(m, lambda a, _: ~F.array_contains(ks, a)),
    clean=lambda m, ks, vs: F.map_filter(m, lambda a, v: ~F.array_contains(ks, a) & v.isNotNull() & ~F.array_contains(vs, v)), get=lambda m, k, d=None: F.coalesce(F.try_element_at(m, k), d) if d is not None else F.try_element_at(m, k),
    mget=lambda m, ks: F.transform(ks, lambda k: F.try_element_at(m, k)), submap=lambda m, ks: F.map_filter(m, lambda a, _: F.array_contains(ks, a)), keys=lambda m: F.array_sort(F.map_keys(m)), values=F.map_values,
    sortedProperties=lambda m: F.array_sort(F.map_entries(m)), dropNullValues=lambda m: F.map_filter(m, lambda _, v: v.isNotNull()),
    groupBy=lambda x, k: F.map_from_entries(F.transform(x, lambda s: F.struct(s.getItem("k").alias("key"), s.alias("value")))),
)
_space(
    "math",
    maxLong=lambda: L(2**63 - 1), minLong=lambda: L(-(2**63)), maxDouble=lambda: L(1.7976931348623157e308), minDouble=lambda: L(4.9e-324), round=half_away, ceil=F.ceil, floor=F.floor, abs=F.abs, pow=F.pow, sqrt=F.sqrt, log=F.ln, log10=F.log10,
    exp=F.exp, sin=F.sin, cos=F.cos, tan=F.tan, asin=F.asin, acos=F.acos, atan=F.atan, atan2=F.atan2, sinh=F.sinh, cosh=F.cosh, tanh=F.tanh, sigmoid=lambda x: 1 / (1 + F.exp(-x)), logit=lambda p: F.ln(p / (1 - p)), clamp=clamp,
    lerp=lambda a, b, t: a + (b - a) * t, normalize=lambda x, lo, hi: F.try_divide(x - lo, hi - lo), gcd=gcd, lcm=lcm, factorial=lambda n: F.factorial(n.cast("int")), fibonacci=fibonacci, isPrime=is_prime,
    nextPrime=lambda n: F.array_min(F.filter(F.sequence(n + 1, n + 1600), is_prime)), random=lambda: F.rand(), randomInt=lambda a, b: a + F.floor(F.rand() * (b - a)), percentile=list_pct, median=lambda x: list_pct(x, L(0.5)), mean=list_mean,
    stdev=lambda x: F.sqrt(list_var(x)), variance=list_var, mode=list_mode, range=lambda x: F.array_max(x) - F.array_min(x), sum=list_sum, product=lambda x: _fold(_num(x), L(1.0), lambda a, y: a * y),
)
for _k in ("round", "ceil", "floor", "abs", "clamp", "lerp", "normalize", "isPrime", "gcd", "lcm", "factorial", "fibonacci", "sqrt", "log", "log10", "exp", "random", "randomInt"):
    FUNCTIONS[f"apoc.number.{_k.lower()}"] = FUNCTIONS[f"apoc.math.{_k.lower()}"]
_space(
    "number",
    format=lambda x, f=None: F.format_number(x, 2), parse=lambda x: F.replace(x, L(","), L("")).try_cast("double"), parseInt=lambda x: F.replace(x, L(","), L("")).try_cast("bigint"), parseFloat=lambda x: F.replace(x, L(","), L("")).try_cast("double"),
    exact=lambda x: x.cast("decimal(38,18)"), romanize=romanize, arabize=arabize, toHex=lambda n: F.lower(F.hex(n)), fromHex=lambda s: from_base(s, L(16)), toOctal=lambda n: base(n, L(8)), fromOctal=lambda s: from_base(s, L(8)),
    toBinary=F.bin, fromBinary=lambda s: from_base(s, L(2)), toBase=lambda n, b: F.lower(base(n, b)), fromBase=from_base, sign=lambda x: F.sign(x).cast("int"), map=lambda x, a, b, c, d: c + (x - a) * F.try_divide(d - c, b - a),
    isEven=lambda n: F.pmod(n, L(2)) == 0, isOdd=lambda n: F.pmod(n, L(2)) == 1, power=F.pow,
)
_space(
    "bitwise",
    op=bit_op, and_=lambda a, b: a.bitwiseAND(b), or_=lambda a, b: a.bitwiseOR(b), xor=lambda a, b: a.bitwiseXOR(b), not_=F.bitwise_not, leftShift=lambda a, n: F.call_function("shiftleft", a.cast("bigint"), n.cast("int")),
    rightShift=lambda a, n: F.call_function("shiftright", a.cast("bigint"), n.cast("int")), setBit=lambda a, n: a.bitwiseOR(bit(n)), clearBit=lambda a, n: a.bitwiseAND(F.bitwise_not(bit(n))), toggleBit=lambda a, n: a.bitwiseXOR(bit(n)),
    testBit=lambda a, n: a.bitwiseAND(bit(n)) != 0, countBits=F.bit_count, rotateLeft=rotate(True), rotateRight=rotate(False), reverseBits=lambda a: F.call_function("conv", F.reverse(F.lpad(F.bin(a), 64, "0")), L(2), L(-10)).cast("bigint"),
)
_space(
    "convert",
    toBoolean=to_bool, toInteger=to_int, toFloat=lambda x: x.try_cast("double"), toString=lambda x: x.cast("string"), toJson=A.to_json, fromJsonMap=json_map, fromJsonList=json_list, toSet=F.array_distinct, toList=lambda x: F.array(x),
    toMap=json_map, toSortedJsonMap=lambda m: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))), getJsonProperty=lambda x, p: F.call_function("get_json_object", x, F.concat(L("$."), p)),
    getJsonPropertyMap=lambda x, p: json_map(F.call_function("get_json_object", x, F.concat(L("$."), p))), toIntList=each(to_int), toFloatList=each(lambda x: x.try_cast("double")), toStringList=each(lambda x: x.cast("string")), toBooleanList=each(to_bool),
    setJsonProperty=lambda m, k, v: map_set(m, k, A.to_json(v)), fromJsonNode=json_map, toNode=lambda x: x, toRelationship=lambda x: x, toNodeList=lambda x: x, toRelationshipList=lambda x: x,
)
_space(
    "json",
    path=lambda x, p: F.call_function("get_json_object", x, p), validate=lambda x: F.call_function("try_parse_json", x).isNotNull(), parse=json_map, stringify=A.to_json, compact=lambda x: F.call_function("to_json", F.call_function("parse_json", x)),
    keys=F.json_object_keys, values=lambda x: F.map_values(json_map(x)), type=lambda x: F.when(F.ltrim(x).startswith("{"), "object").when(F.ltrim(x).startswith("["), "array").when(F.ltrim(x).startswith('"'), "string").when(F.trim(x).isin("true", "false"), "boolean").when(F.trim(x) == "null", "null").otherwise("number"),
    size=lambda x: F.coalesce(F.json_array_length(x), F.size(F.json_object_keys(x))), merge=lambda a, b: F.to_json(map_merge(json_map(a), json_map(b))), set=lambda x, k, v: F.to_json(map_set(json_map(x), k, v.cast("string"))),
    delete=lambda x, k: F.to_json(F.map_filter(json_map(x), lambda a, _: a != k)), flatten=A.json_flatten, unflatten=A.json_unflatten, pretty=A.json_pretty,
)
_space(
    "hashing",
    md5=lambda x: F.md5(x.cast("string")), sha1=lambda x: F.sha1(x.cast("string")), sha256=lambda x: F.sha2(x.cast("string"), 256), sha384=lambda x: F.sha2(x.cast("string"), 384), sha512=lambda x: F.sha2(x.cast("string"), 512),
    fnv1=fnv(16777619, 2166136261, 32, False), fnv1a=fnv(16777619, 2166136261, 32, True), fnv164=fnv(1099511628211, 14695981039346656037, 64, False), fnv1a64=fnv(1099511628211, 14695981039346656037, 64, True), murmurHash3=A.murmur3_32, xxHash32=A.xxh32, xxHash64=A.xxh64,
    fingerprint=lambda x: F.sha2(A.to_json(x), 256), consistentHash=lambda x, n: F.pmod(F.xxhash64(x), n), jumpHash=A.jump_hash, rendezvousHash=lambda x, nodes: F.array_max(F.transform(nodes, lambda n: F.struct(F.xxhash64(x, n).alias("h"), n.alias("n")))).getField("n"), cityHash64=lambda x: F.when(F.length(x.cast("string")) == 0, L(0)).otherwise(fnv(1099511628211, 14695981039346656037, 64, True)(x)),
)
_space(
    "util",
    md5=lambda x: F.md5(x.cast("string")), sha1=lambda x: F.sha1(x.cast("string")), sha256=lambda x: F.sha2(x.cast("string"), 256), md5Hex=F.md5, sha1Hex=F.sha1, sha256Hex=lambda x: F.sha2(x, 256), md5Base64=lambda x: F.base64(F.unhex(F.md5(x))),
    sha1Base64=lambda x: F.base64(F.unhex(F.sha1(x))), sha256Base64=lambda x: F.base64(F.unhex(F.sha2(x, 256))), uuid=lambda: F.uuid(), randomUUID=lambda: F.uuid(), merge=map_merge, coalesce=F.coalesce, when=lambda c, a, b: F.when(c, a).otherwise(b),
    case=lambda *a: reduce(lambda s, p: s.when(p[0], p[1]), list(zip(a[::2], a[1::2], strict=False))[1:], F.when(a[0], a[1])).otherwise(a[-1] if len(a) % 2 else L(None)), typeOf=value_type, isNode=lambda x: F.call_function("typeof", x).contains("labels"),
    repeat=lambda x, n: F.repeat(x, n.cast("int")), range=lambda a, b: F.sequence(a, b), partition=partition, encodeBase64=lambda x: F.base64(F.encode(x, "UTF-8")), decodeBase64=lambda x: F.decode(F.unbase64(x), "UTF-8"), encodeURL=F.url_encode,
    decodeURL=F.url_decode, validatePattern=lambda x, p: F.regexp_like(x, p), now=T.now_millis, nowInSeconds=lambda: F.unix_timestamp(), timestamp=T.now_millis, compress=A.compress, decompress=A.decompress, validate=lambda c, m: F.assert_true(c, m),
    parseTimestamp=lambda x, f=None: F.to_timestamp(x) if f is None else F.call_function("to_timestamp", x, f), formatTimestamp=lambda x, f: F.call_function("date_format", x, f),
)
_space(
    "scoring",
    existence=lambda n, yes: F.when(yes, n).otherwise(0), pareto=lambda lo, eighty, top, x: F.when(x < lo, 0.0).otherwise(top * (1 - F.exp(-(F.ln(L(5.0)) / eighty) * x))), cosine=cosine, euclidean=distance2,
    manhattan=lambda a, b: _fold(F.zip_with(_num(a), _num(b), lambda x, y: F.abs(x - y)), L(0.0), lambda s, z: s + z), jaccard=lambda a, b: F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))),
    overlap=lambda a, b: F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))), dice=lambda a, b: F.try_divide(2 * F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))),
    pearson=lambda a, b: cosine(F.transform(_num(a), lambda x: x - list_mean(a)), F.transform(_num(b), lambda x: x - list_mean(b))), tf=lambda t, x: F.try_divide(F.size(F.filter(x, lambda y: y == t)), F.size(x)), idf=lambda n, df: F.ln(F.try_divide(n, df)),
    tfidf=lambda tf, idf: tf * idf, bm25=lambda tf, df, n, dl, avg: F.ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)), normalize=lambda x, lo, hi: F.try_divide(x - lo, hi - lo), minMax=lambda x, lo, hi: F.try_divide(x - lo, hi - lo),
    zScore=lambda x, m, s: F.try_divide(x - m, s), sigmoid=lambda x: 1 / (1 + F.exp(-x)), softmax=softmax, percentile=list_pct, rank=lambda x, v: F.size(F.filter(x, lambda y: y > v)) + 1, topK=lambda x, k: F.slice(F.reverse(F.array_sort(x)), L(1), k.cast("int")),
)
_space(
    "stats",
    mean=list_mean, median=lambda x: list_pct(x, L(0.5)), mode=list_mode, stdDev=lambda x: F.sqrt(list_var(x)), variance=list_var, percentile=list_pct, quartiles=lambda x: F.array(list_pct(x, L(0.25)), list_pct(x, L(0.5)), list_pct(x, L(0.75))),
    iqr=lambda x: list_pct(x, L(0.75)) - list_pct(x, L(0.25)), min=F.array_min, max=F.array_max, range=lambda x: F.array_max(x) - F.array_min(x), sum=list_sum, count=F.size, zScore=lambda x, m, s: F.try_divide(x - m, s),
    normalize=lambda x: F.transform(_num(x), lambda v: F.try_divide(v - F.array_min(_num(x)), F.array_max(_num(x)) - F.array_min(_num(x)))),
    outliers=lambda x: F.filter(_num(x), lambda v: (v < list_pct(x, L(0.25)) - 1.5 * (list_pct(x, L(0.75)) - list_pct(x, L(0.25)))) | (v > list_pct(x, L(0.75)) + 1.5 * (list_pct(x, L(0.75)) - list_pct(x, L(0.25))))),
    summary=lambda x: F.struct(F.size(x).alias("count"), F.array_min(x).alias("min"), F.array_max(x).alias("max"), list_mean(x).alias("mean"), list_pct(x, L(0.5)).alias("median"), F.sqrt(list_var(x)).alias("stdev")),
    histogram=lambda x, n: F.transform(F.sequence(L(0), (n - 1).cast("int")), lambda i: F.size(F.filter(_num(x), lambda v: F.least(F.floor(F.try_divide((v - F.array_min(_num(x))) * n, F.array_max(_num(x)) - F.array_min(_num(x)))), n - 1) == i))),
)
_space(
    "diff",
    maps=lambda a, b: F.struct(F.map_filter(a, lambda k, v: F.array_contains(F.map_keys(b), k) & F.try_element_at(b, k).eqNullSafe(v)).alias("inCommon"), F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)).alias("leftOnly"), F.map_filter(b, lambda k, _: ~F.array_contains(F.map_keys(a), k)).alias("rightOnly"),
        F.map_filter(a, lambda k, v: F.array_contains(F.map_keys(b), k) & ~F.try_element_at(b, k).eqNullSafe(v)).alias("different")),
    lists=lambda a, b: F.struct(F.array_except(a, b).alias("leftOnly"), F.array_except(b, a).alias("rightOnly"), F.array_intersect(a, b).alias("inCommon")), merge=map_merge, patch=map_merge,
    strings=lambda a, b: F.struct((a == b).alias("equal"), F.levenshtein(a, b).alias("distance")),
)
_space("xml", getText=lambda x, p: F.xpath_string(x, p), getAttribute=lambda x, p: F.xpath_string(x, p), query=lambda x, p: F.xpath(x, p), escape=A.xml_escape, unescape=A.xml_unescape, minify=lambda x: F.regexp_replace(x, r">\s+<", "><"))
_space("meta", type=value_type, isType=same_kind)
_space("node", property=lambda m, k: m.getField("props")[k], toMap=lambda x: x, equals=lambda a, b: a.eqNullSafe(b))
_space("rel", equals=lambda a, b: a.eqNullSafe(b), isType=lambda r, t: r.getField("type") == t, isAnyType=lambda r, ts: F.array_contains(ts, r.getField("type")), isLoop=lambda r: r.getField("src") == r.getField("dst"), otherNode=lambda r, x: F.when(r.getField("src") == x, r.getField("dst")).otherwise(r.getField("src")))
for _k, _f in T.NAMED.items():
    FUNCTIONS[f"apoc.{_k}"] = _f
for _k, _f in S.NAMED.items():
    FUNCTIONS[f"apoc.spatial.{_k}"] = _f

_space("meta", typeOf=value_type, cypherType=value_type, isNode=lambda x: L(False), isRelationship=lambda x: L(False), isPath=lambda x: L(False))
_space("util", isRelationship=lambda x: L(False), isPath=lambda x: L(False))

TEXT_VALUED = {"tostring", "tolower", "toupper", "lower", "upper", "trim", "ltrim", "rtrim", "replace", "substring", "left", "right", "lpad", "rpad", "format", "elementid", "type"}
LIST_VALUED = {"range", "tail", "split", "collect", "keys", "labels", "nodes", "relationships", "tostringlist", "tointegerlist"}


def lookup(name: str) -> Fn | None:
    return FUNCTIONS.get(name.lower())


def register(name: str, f: Fn) -> None:
    """Adds a function of the caller's own: columns in, one column out."""
    FUNCTIONS[name.lower()] = f
