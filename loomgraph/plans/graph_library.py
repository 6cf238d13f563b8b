"""Further procedures: looking up, comparing and searching nodes, paths, and descriptions of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import algorithms as alg
from loomgraph.plans.procedures import PROCS, conf, direction_of, one_row, proc, types_of


def _table(g: Graph, label: str | None):
    t = next(n for n in g.nodes if n.generic or label is None or n.label == label)
    return (t.df.filter(F.array_contains("_labels", label)) if t.generic and label else t.df), t


def _prop(g: Graph, label: str | None, name: str) -> Column:
    d, _ = _table(g, label)
    return F.col(name) if name in d.columns else F.col("_props")[name]


def _starts(g: Graph, spark, ids, e):
    kind = dict(e.dtypes)["src"]
    if g.mixed():
        given = spark.createDataFrame([(str(i),) for i in (ids if isinstance(ids, list) else [ids])], "s string")
        named = g.keys(given).select(F.col("k").alias("id"))
        return named if kind == "string" else named.select(F.regexp_replace("id", "^[^:]*:", "").cast(kind).alias("id"))
    return spark.createDataFrame([(str(i),) for i in (ids if isinstance(ids, list) else [ids])], "id string").select(F.col("id").cast(kind).alias("id"))


def _search(test):
    def f(g: Graph, spark, label, prop, value=None, *_):
        d, t = _table(g, label)
        return d.filter(test(_prop(g, label, prop), value)).select(F.col(t.id).alias("node"))

    return f


for _n, _t in {
    "node": lambda c, v: c == v, "match": lambda c, v: c == v, "prefix": lambda c, v: c.cast("string").startswith(v), "suffix": lambda c, v: c.cast("string").endswith(v), "contains": lambda c, v: c.cast("string").contains(v),
    "regex": lambda c, v: c.cast("string").rlike(v), "range": lambda c, v: c.try_cast("double").between(v[0], v[1]), "in": lambda c, v: c.isin(*v), "notin": lambda c, v: ~c.isin(*v), "exists": lambda c, v: c.isNotNull(), "notnull": lambda c, v: c.isNotNull(),
    "missing": lambda c, v: c.isNull(), "null": lambda c, v: c.isNull(), "fuzzy": lambda c, v: F.levenshtein(F.lower(c.cast("string")), F.lit(v.lower())) <= max(1, len(v) // 4), "didyoumean": lambda c, v: F.levenshtein(F.lower(c.cast("string")), F.lit(v.lower())) <= 2,
    "autocomplete": lambda c, v: F.lower(c.cast("string")).startswith(v.lower()), "suggest": lambda c, v: F.lower(c.cast("string")).startswith(v.lower()),
}.items():
    PROCS[f"apoc.search.{_n}"] = _search(_t)


def _multi(join):
    def f(g: Graph, spark, label, conditions, *_):
        d, t = _table(g, label)
        return d.filter(reduce(join, [_prop(g, label, k) == v for k, v in conditions.items()])).select(F.col(t.id).alias("node"))

    return f


PROCS["apoc.search.multisearchall"] = PROCS["apoc.search.nodeall"] = _multi(lambda a, b: a & b)
PROCS["apoc.search.multisearchany"] = PROCS["apoc.search.nodeany"] = _multi(lambda a, b: a | b)


# ---------- nodes by id
def _near(kind: str):
    def f(g: Graph, spark, node, types=None, *_):
        e = g.edges(types_of(types))
        s = _starts(g, spark, node, e)
        out = [e.join(s, F.col("src") == F.col("id")).select(F.col("dst").alias("node"), "type")] if kind != "in" else []
        back = [e.join(s, F.col("dst") == F.col("id")).select(F.col("src").alias("node"), "type")] if kind != "out" else []
        return reduce(lambda a, b: a.union(b), out + back)

    return f


for _n, _k in (("", "both"), ("in", "in"), ("out", "out")):
    PROCS[f"apoc.node.neighbors{_n}"] = lambda g, s, n, t=None, *_, k=_k: _near(k)(g, s, n, t).select("node").distinct()
    PROCS[f"apoc.node.relationships{_n}"] = _near(_k)
    PROCS[f"apoc.node.relationshiptypes{_n}"] = lambda g, s, n, t=None, *_, k=_k: _near(k)(g, s, n, t).select("type").distinct()
    PROCS[f"apoc.node.degree{_n}"] = lambda g, s, n, t=None, *_, k=_k: _near(k)(g, s, n, t).agg(F.count(F.lit(1)).alias("degree"))
    PROCS[f"apoc.node.relationshipexists{_n}"] = lambda g, s, n, t=None, *_, k=_k: _near(k)(g, s, n, t).agg((F.count(F.lit(1)) > 0).alias("exists"))


@proc("apoc.nodes.isdense", "apoc.node.isdense")
def is_dense(g: Graph, spark, node, threshold=50, *_):
    return _near("both")(g, spark, node).agg((F.count(F.lit(1)) > threshold).alias("dense"))


@proc("apoc.nodes.connected", "apoc.node.connected", "apoc.rel.exists")
def connected(g: Graph, spark, a, b, types=None, *_):
    return _near("both")(g, spark, a, types).agg((F.count_if(F.col("node").cast("string") == str(b)) > 0).alias("connected"))


@proc("apoc.nodes.get")
def get_nodes(g: Graph, spark, ids, label=None, *_):
    d, t = _table(g, label)
    return d.filter(F.col(t.id).cast("string").isin(*[str(i) for i in ids])).select(F.struct(*d.columns).alias("node"))


@proc("apoc.nodes.relationships")
def rels_of(g: Graph, spark, ids, types=None, *_):
    e = g.edges(types_of(types))
    s = _starts(g, spark, ids, e)
    return e.join(s, F.col("src") == F.col("id"), "left_semi").union(e.join(s, F.col("dst") == F.col("id"), "left_semi")).distinct()


@proc("apoc.nodes.group")
def group(g: Graph, spark, label, prop, *_):
    d, _t = _table(g, label)
    return d.groupBy(_prop(g, label, prop).alias("value")).agg(F.count(F.lit(1)).alias("count"))


@proc("apoc.nodes.cycles", "apoc.paths.cycles")
def cycles(g: Graph, spark, node, types=None, depth=4, *_):
    e = g.edges(types_of(types))
    p = alg.simple_paths(e, _starts(g, spark, node, e), 1, int(depth) - 1, "out")
    back = e.select("src", "dst").distinct()
    return p.join(back, F.col("id") == F.col("src")).filter(F.col("dst") == F.get("path", F.lit(0))).select(F.array_append("path", F.col("dst")).alias("path"))


# ---------- paths
@proc("apoc.paths.all", "apoc.paths.simple", "apoc.paths.elementary", "apoc.paths.withlength", "apoc.paths.withinlength")
def paths_between(g: Graph, spark, a, b, types=None, most=4, least=1, *_):
    e = g.edges(types_of(types))
    return alg.simple_paths(e, _starts(g, spark, a, e), int(least), int(most), direction_of(types)).filter(F.col("id").cast("string") == str(b)).select("path")


@proc("apoc.paths.count")
def count_paths(g: Graph, spark, *a):
    return paths_between(g, spark, *a).agg(F.count(F.lit(1)).alias("count"))


@proc("apoc.paths.exists")
def path_exists(g: Graph, spark, *a):
    return paths_between(g, spark, *a).agg((F.count(F.lit(1)) > 0).alias("exists"))


@proc("apoc.path.allshortestpaths")
def all_shortest(g: Graph, spark, a, b, types=None, most=None, *_):
    e = g.edges(types_of(types))
    return alg.shortest_paths(e, _starts(g, spark, a, e), str(b), None if most is None else int(most), direction_of(types))


@proc("apoc.path.shortestpath")
def one_shortest(g: Graph, spark, *a):
    return all_shortest(g, spark, *a).orderBy("path").limit(1)


@proc("apoc.paths.kshortest", "apoc.paths.shortest")
def k_shortest(g: Graph, spark, a, b, types=None, k=1, most=6, *_):
    return paths_between(g, spark, a, b, types, most).orderBy(F.size("path"), "path").limit(int(k))


@proc("apoc.paths.longest")
def longest(g: Graph, spark, a, b, types=None, most=6, *_):
    return paths_between(g, spark, a, b, types, most).orderBy(F.desc(F.size("path")), "path").limit(1)


@proc("apoc.paths.distance")
def path_distance(g: Graph, spark, a, b, types=None, most=10, *_):
    e = g.edges(types_of(types))
    return alg.bfs(e, _starts(g, spark, a, e), int(most), direction_of(types)).filter(F.col("id").cast("string") == str(b)).select(F.col("depth").alias("distance"))


@proc("apoc.path.subgraphall", "apoc.graph.subgraph")
def subgraph_all(g: Graph, spark, start, cfg=None, *_):
    c = conf(cfg)
    e = g.edges(types_of(c.get("relationshipFilter")))
    ids = alg.bfs(e, _starts(g, spark, start, e), int(c.get("maxLevel", 3)), direction_of(c.get("relationshipFilter"))).select("id")
    return e.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "type")


@proc("apoc.neighbors.bfs", "apoc.neighbors.dfs")
def reach(g: Graph, spark, start, types=None, depth=3, *_):
    e = g.edges(types_of(types))
    return alg.bfs(e, _starts(g, spark, start, e), int(depth), direction_of(types)).select(F.col("id").alias("node"), "depth")


@proc("apoc.algo.trianglecount", "gds.trianglecount.stream")
def triangle_count(g: Graph, spark, label=None, types=None, *_):
    return alg.triangles(g.edges(types_of(types), label, label)).select(F.col("id").alias("node"), "triangles")


@proc("apoc.algo.kcore", "gds.kcore.stream")
def core(g: Graph, spark, k, label=None, types=None, *_):
    return alg.k_core(g.edges(types_of(types), label, label), int(k)).select(F.col("id").alias("node"))


# ---------- description of the graph
@proc("apoc.meta.nodelabels", "apoc.label.list", "apoc.schema.labels")
def label_list(g: Graph, spark, *_):
    return PROCS["db.labels"](g, spark)


@proc("apoc.label.stats", "apoc.label.count", "apoc.meta.cardinality")
def label_counts(g: Graph, spark, *_):
    if g.generic:
        return g.nodes[0].df.select(F.explode("_labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    return g.all_nodes().groupBy("label").agg(F.count(F.lit(1)).alias("count"))


@proc("apoc.meta.reltypes", "apoc.schema.types")
def type_counts(g: Graph, spark, *_):
    return g.edges().groupBy("type").agg(F.count(F.lit(1)).alias("count"))


@proc("apoc.label.pattern", "apoc.label.search")
def label_search(g: Graph, spark, pattern, *_):
    return PROCS["db.labels"](g, spark).filter(F.col("label").rlike(pattern))


@proc("apoc.label.nodes")
def label_nodes(g: Graph, spark, label, *_):
    d, t = _table(g, label)
    return d.select(F.col(t.id).alias("node"))


@proc("apoc.label.exists")
def label_exists(g: Graph, spark, label, *_):
    return PROCS["db.labels"](g, spark).agg((F.count_if(F.col("label") == label) > 0).alias("exists"))


for _a, _b in {"apoc.meta.schema": "db.schema.nodeproperties", "apoc.meta.nodetypeproperties": "db.schema.nodeproperties", "apoc.meta.data": "db.schema.nodeproperties", "apoc.meta.reltypeproperties": "db.schema.relproperties", "apoc.schema.properties": "db.propertykeys", "apoc.meta.propertykeys": "db.propertykeys",
    "apoc.meta.indexes": "db.indexes", "apoc.schema.nodes": "db.indexes", "apoc.meta.constraints": "db.constraints", "apoc.meta.procedures": "dbms.procedures", "apoc.meta.functions": "dbms.functions", "apoc.meta.version": "db.info", "apoc.schema.info": "db.schema.visualization", "apoc.graph.stats": "engine.stats",
    "apoc.schema.stats": "db.index.stats", "apoc.meta.subgraph": "db.schema.visualization", "apoc.meta.graphsample": "db.schema.visualization"}.items():
    PROCS[_a] = PROCS[_b]


@proc("apoc.schema.propertiesdistinct")
def distinct_values(g: Graph, spark, label, prop, *_):
    d, _t = _table(g, label)
    return d.select(_prop(g, label, prop).alias("value")).filter("value is not null").distinct()


@proc("apoc.schema.validate", "apoc.meta.validate")
def validate(g: Graph, spark, *_):
    """Ends of relationships that name no node, by type."""
    ids = g.all_nodes().select((F.concat("label", F.lit(":"), "id") if g.mixed() else F.col("id")).alias("k"))
    e = g.edges().select("type", F.explode(F.array(F.col("src").cast("string"), F.col("dst").cast("string"))).alias("k"))
    return e.join(ids, "k", "left_anti").groupBy("type").agg(F.count(F.lit(1)).alias("missing"))


@proc("apoc.stats.degrees")
def degrees(g: Graph, spark, types=None, *_):
    e = g.edges(types_of(types))
    d = e.select("src").union(e.select("dst")).groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    return d.agg(F.count(F.lit(1)).alias("total"), F.min("d").alias("min"), F.max("d").alias("max"), F.avg("d").alias("mean"), F.percentile("d", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("p50_p90_p99"))


@proc("apoc.cypher.parse", "apoc.cypher.validate")
def valid(g: Graph, spark, text, *_):
    from loomgraph.cypher.parser import QueryError, parse

    try:
        parse(text)
        return one_row(spark, valid=True, message="")
    except QueryError as e:
        return one_row(spark, valid=False, message=str(e))


@proc("apoc.cypher.explain", "apoc.cypher.profile")
def explained(g: Graph, spark, text, *_):
    from loomgraph.cypher.lower import run

    return run(g, spark, f"EXPLAIN {text}")


def _reader(fmt: str):
    def f(g: Graph, spark, path, cfg=None, *_):
        d = spark.read.format(fmt).options(**{k: str(v) for k, v in conf(cfg).items()}).load(path)
        return d.select(F.struct(*[F.col(f"`{c}`") for c in d.columns]).alias("value"))

    return f


for _f in ("parquet", "orc", "text", "json", "csv", "xml"):
    PROCS.setdefault(f"apoc.load.{_f}stream", _reader(_f))
    PROCS[f"apoc.load.{_f}"] = _reader(_f) if _f in ("parquet", "orc", "text", "xml") else PROCS.get(f"apoc.load.{_f}", _reader(_f))
PROCS["apoc.load.jdbc"] = lambda g, spark, url, query, cfg=None, *_: spark.read.format("jdbc").options(url=url, query=query, **conf(cfg)).load()
PROCS["apoc.load.directory"] = lambda g, spark, path, *_: spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
