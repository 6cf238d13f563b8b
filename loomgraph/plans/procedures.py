"""Procedures of the query language: each returns a DataFrame whose columns have the documented names."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph import __version__
from loomgraph.functions import registry
from loomgraph.graph import Graph
from loomgraph.operators import algorithms as alg
from loomgraph.operators import linkprediction as lp
from loomgraph.operators import search
from loomgraph.session import cut

PROCS: dict[str, Callable[..., DataFrame]] = {}
PROJECTIONS: dict[str, Graph] = {}


def proc(*names: str):
    def put(f):
        for n in names:
            PROCS[n.lower()] = f
        return f

    return put


def call(graph: Graph, spark: SparkSession, name: str, args: list, params: dict[str, Any]) -> DataFrame:
    f = PROCS.get(name.lower())
    if f is None:
        raise ValueError(f"unknown procedure {name}")
    return f(graph, spark, *args)


def one_row(spark: SparkSession, **cols) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


def conf(c: Any) -> dict:
    return c if isinstance(c, dict) else {}


def types_of(x) -> list[str] | None:
    """A relationship filter such as 'KNOWS|LIKES>' or a list of types; empty means all."""
    if not x:
        return None
    if isinstance(x, str):
        return [t.strip("<>:` ") for t in x.split("|") if t.strip("<>:` ")] or None
    return list(x)


def direction_of(x) -> str:
    return "both" if not isinstance(x, str) or not x else "out" if x.endswith(">") or x.startswith(">") else "in" if x.startswith("<") else "both"


# ---------- schema
@proc("db.labels")
def labels(g: Graph, spark, *_):
    if g.generic:
        return g.nodes[0].df.select(F.explode("_labels").alias("label")).distinct()
    return spark.createDataFrame([(n.label,) for n in g.nodes], "label string")


@proc("db.relationshiptypes")
def rel_types(g: Graph, spark, *_):
    return g.edges().select(F.col("type").alias("relationshipType")).distinct() if g.generic else spark.createDataFrame(sorted({(r.type,) for r in g.rels}), "relationshipType string")


@proc("db.propertykeys")
def property_keys(g: Graph, spark, *_):
    if g.generic:
        both = g.nodes[0].df.select(F.explode(F.map_keys("_props")).alias("propertyKey")).union(g.rels[0].df.select(F.explode(F.map_keys("_props"))))
        return both.distinct()
    return spark.createDataFrame(sorted({(p,) for n in g.nodes for p in n.props} | {(p,) for r in g.rels for p in r.props}), "propertyKey string")


@proc("db.schema.nodeproperties", "db.schema.nodetypeproperties")
def node_properties(g: Graph, spark, *_):
    if g.generic:
        return g.nodes[0].df.select(F.explode_outer("_labels").alias("nodeLabel"), F.explode(F.map_keys("_props")).alias("propertyName")).distinct().withColumn("propertyType", F.lit("STRING"))
    return spark.createDataFrame([(n.label, c, t) for n in g.nodes for c, t in n.df.dtypes], "nodeLabel string, propertyName string, propertyType string")


@proc("db.schema.relproperties", "db.schema.reltypeproperties")
def rel_properties(g: Graph, spark, *_):
    if g.generic:
        return g.rels[0].df.select(F.col("_type").alias("relType"), F.explode(F.map_keys("_props")).alias("propertyName")).distinct().withColumn("propertyType", F.lit("STRING"))
    return spark.createDataFrame([(r.type, c, dict(r.df.dtypes)[c]) for r in g.rels for c in r.props], "relType string, propertyName string, propertyType string")


@proc("db.schema.visualization", "apoc.meta.graph")
def visualization(g: Graph, spark, *_):
    if g.generic:
        n = g.nodes[0].df.select("id", F.col("_labels")[0].alias("l"))
        e = g.edges().join(n.select(F.col("id").alias("src"), F.col("l").alias("src_label")), "src").join(n.select(F.col("id").alias("dst"), F.col("l").alias("dst_label")), "dst")
        return e.select(F.col("src_label").alias("from"), F.col("type").alias("relationshipType"), F.col("dst_label").alias("to")).distinct()
    return spark.createDataFrame([(r.src_label, r.type, r.dst_label) for r in g.rels], "from string, relationshipType string, to string")


@proc("db.info", "dbms.info", "db.ping", "dbms.components", "dbms.listconfig", "dbms.clientconfig", "tx.setmetadata", "db.awaitindexes", "db.awaitindex", "db.resampleindex", "db.clearquerycaches", "gds.version", "engine.version", "apoc.version")
def about(g: Graph, spark, *_):
    return one_row(spark, name=g.name, version=__version__, success=True, status="ok")


@proc("engine.stats", "apoc.meta.stats", "db.stats.retrieve", "db.stats.collect", "db.stats.status", "db.stats.clear", "db.stats.stop", "db.stats.retrieveallanthestats")
def stats(g: Graph, spark, *_):
    n, e = g.all_nodes(), g.edges()
    a = n.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("label").alias("labels"))
    return a.crossJoin(e.agg(F.count(F.lit(1)).alias("relationships"), F.count_distinct("type").alias("relationshipTypes")))


@proc("engine.decay.info")
def decay_info(g: Graph, spark, *_):
    return one_row(spark, enabled=True, halfLifeEpisodic="7 days", halfLifeSemantic="69 days", halfLifeProcedural="693 days", archiveThreshold=0.05)


@proc("dbms.procedures", "apoc.help")
def procedures(g: Graph, spark, *_):
    return spark.createDataFrame([(n, (f.__doc__ or "").strip(), "READ") for n, f in sorted(PROCS.items())], "name string, description string, mode string")


@proc("dbms.functions")
def functions(g: Graph, spark, *_):
    return spark.createDataFrame([(n, n.rpartition(".")[0] or "core") for n in sorted({*registry.FUNCTIONS, *registry.AGGREGATES})], "name string, category string")


@proc("dbms.listconnections")
def connections(g: Graph, spark, *_):
    return spark.createDataFrame([], "connectionId string, connectTime string, connector string, username string")


# ---------- catalog of indexes and constraints
@proc("db.indexes")
def indexes(g: Graph, spark, *_):
    return spark.createDataFrame([(n, x["type"], x["labels"], x["properties"], "ONLINE") for n, x in g.indexes.items()], "name string, type string, labelsOrTypes array<string>, properties array<string>, state string")


@proc("db.constraints")
def constraints(g: Graph, spark, *_):
    return spark.createDataFrame([(n, x["type"], x["labels"], x["properties"]) for n, x in g.constraints.items()], "name string, type string, labelsOrTypes array<string>, properties array<string>")


@proc("db.index.stats")
def index_stats(g: Graph, spark, *_):
    out = None
    for name, x in g.indexes.items():
        d = next(n.df for n in g.nodes if n.label in (None, x["labels"][0]))
        p = x["properties"][0]
        c = F.col(p) if p in d.columns else F.col("_props")[p]
        one = d.agg(F.count(c).alias("totalEntries"), F.count_distinct(c).alias("uniqueValues")).select(F.lit(name).alias("name"), F.lit(x["labels"][0]).alias("label"), F.lit(p).alias("property"), "totalEntries", "uniqueValues", F.try_divide("uniqueValues", "totalEntries").alias("selectivity"))
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], "name string, label string, property string, totalEntries bigint, uniqueValues bigint, selectivity double")


def _create(kind: str):
    def f(g: Graph, spark, name, labels_, props, dims=None, metric="cosine"):
        g.indexes[name] = {"type": kind, "labels": labels_ if isinstance(labels_, list) else [labels_], "properties": props if isinstance(props, list) else [props], "dims": dims, "metric": metric}
        return one_row(spark, name=name, created=True)

    return f


for _n, _k in (("vector.createnodeindex", "VECTOR"), ("vector.createrelationshipindex", "VECTOR_REL"), ("fulltext.createnodeindex", "FULLTEXT"), ("fulltext.createrelationshipindex", "FULLTEXT_REL")):
    PROCS[f"db.index.{_n}"] = _create(_k)


@proc("db.index.fulltext.drop", "db.index.vector.drop")
def drop_index(g: Graph, spark, name):
    return one_row(spark, name=name, dropped=g.indexes.pop(name, None) is not None)


@proc("db.index.fulltext.listavailableanalyzers")
def analyzers(g: Graph, spark, *_):
    return spark.createDataFrame([("standard", "words of letters and digits, lower-cased, without stop words")], "analyzer string, description string")


def _indexed(g: Graph, name: str) -> tuple[DataFrame, str, dict]:
    x = g.indexes[name]
    n = next(t for t in g.nodes if t.label in (None, x["labels"][0]))
    d = n.df.filter(F.array_contains("_labels", x["labels"][0])) if n.generic else n.df
    return d, n.id, x


@proc("db.index.fulltext.querynodes")
def fulltext_nodes(g: Graph, spark, name, query, *_):
    d, key, x = _indexed(g, name)
    text = F.concat_ws(" ", *[F.col(p) if p in d.columns else F.col("_props")[p] for p in x["properties"]])
    return search.bm25_fixed(d.select(F.col(key).alias("node"), text.alias("text")), "node", "text", query)


@proc("db.index.vector.querynodes")
def vector_nodes(g: Graph, spark, name, k, query, *_):
    d, key, x = _indexed(g, name)
    return search.nearest(d.select(F.col(key).alias("node"), F.col(x["properties"][0]).alias("v")), "node", "v", query, int(k), x["metric"])


@proc("db.index.fulltext.queryrelationships")
def fulltext_rels(g: Graph, spark, name, query, *_):
    x = g.indexes[name]
    r = next(t for t in g.rels if t.type in (None, x["labels"][0]))
    text = F.concat_ws(" ", *[F.col(p) if p in r.df.columns else F.col("_props")[p] for p in x["properties"]])
    d = r.df.select(F.concat_ws("|", *[F.col(c).cast("string") for c in r.id or (r.src, r.dst)]).alias("relationship"), text.alias("text"))
    return search.bm25_fixed(d, "relationship", "text", query)


@proc("db.index.vector.queryrelationships")
def vector_rels(g: Graph, spark, name, k, query, *_):
    x = g.indexes[name]
    r = next(t for t in g.rels if t.type in (None, x["labels"][0]))
    d = r.df.select(F.concat_ws("|", *[F.col(c).cast("string") for c in r.id or (r.src, r.dst)]).alias("relationship"), F.col(x["properties"][0]).alias("v"))
    return search.nearest(d, "relationship", "v", query, int(k), x["metric"])


# ---------- paths and neighbourhoods
BOUND: dict[str, Callable[..., DataFrame]] = {}


def bound(*names: str):
    """For procedures whose first argument may be a variable: they take all its distinct values (``s``) at once and say ``s`` in each row."""

    def put(f):
        for n in names:
            BOUND[n.lower()] = f
        return f

    return put


def single(name: str):
    """The form of a bound procedure for one constant start."""

    def f(g: Graph, spark, start, *args):
        starts = spark.createDataFrame([(str(start),)], "s string")
        return BOUND[name](g, spark, starts, *args).drop("s")

    return f


def label_filter(text) -> dict[str, list[str]]:
    """The parts of '+Kept|-Left out|/Not left': '+' and '-' say which nodes come out, '/' at which paths end."""
    parts = [x.strip() for x in str(text or "").split("|") if x.strip()]
    return {sign: [x[1:] for x in parts if x[0] == sign] for sign in "+-/"}


def _labelled(g: Graph, labels_: list[str], types: list[str] | None) -> DataFrame:
    """``id``, as in ``edges(types)``, of the nodes with any of these labels."""
    kind, mixed = dict(g.edges(types).dtypes)["src"], g.mixed(types)
    if g.generic:
        return g.nodes[0].df.filter(F.arrays_overlap("_labels", F.array(*[F.lit(x) for x in labels_]))).select(F.col("id").cast(kind).alias("id"))
    none = g.nodes[0].df.select(F.col(g.nodes[0].id).cast(kind).alias("id")).filter(F.lit(False))
    own = [n.df.select((F.concat(F.lit(f"{n.label}:"), F.col(n.id).cast("string")) if mixed else F.col(n.id).cast(kind)).alias("id")) for n in g.nodes if n.label in labels_]
    return reduce(DataFrame.union, own, none)


def _walk(g: Graph, starts: DataFrame, types, labels_, least: int, most: int) -> DataFrame:
    """``s, id, depth, path`` of the nodes that a label filter lets out."""
    names, lab = types_of(types), label_filter(labels_)
    known = cut(g.keys(starts, names))
    stop = _labelled(g, lab["/"], names) if lab["/"] else None
    out = alg.reach(g.edges(names), known.select(F.col("k").alias("s")), most, direction_of(types), stop).filter(F.col("depth") >= least)
    if lab["-"]:
        out = out.join(_labelled(g, lab["-"], names), "id", "left_anti")
    if lab["+"]:
        out = out.join(_labelled(g, lab["+"], names), "id", "left_semi")
    return out.withColumnRenamed("s", "k").join(known, "k").select("s", "id", "depth", "path")


@bound("apoc.path.subgraphnodes")
def subgraph_nodes(g: Graph, spark, starts, cfg=None, *_):
    c = conf(cfg)
    out = _walk(g, starts, c.get("relationshipFilter"), c.get("labelFilter"), int(c.get("minLevel", 0)), int(c.get("maxLevel", 3))).select("s", F.col("id").alias("node"), "depth")
    if c.get("limit"):
        w = Window.partitionBy("s").orderBy("depth", "node")
        out = out.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= int(c["limit"])).drop("_k")
    return out


def _expanded(g: Graph, starts: DataFrame, types, labels_, least: int, most: int) -> DataFrame:
    """``s, path``: paths without a repeated node, from each start, that end at a node which the label filter lets out."""
    names, lab = types_of(types), label_filter(labels_)
    known = cut(g.keys(starts, names))
    p = alg.simple_paths(g.edges(names), known.select(F.col("k").alias("id")).distinct(), least, most, direction_of(types))
    if lab["/"]:
        ends = _labelled(g, lab["/"], names).select(F.col("id").alias("x"))
        inner = p.select("path", F.explode_outer(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("x"))
        p = p.join(inner.join(ends, "x", "left_semi").select("path").distinct(), "path", "left_anti")
    if lab["-"]:
        p = p.join(_labelled(g, lab["-"], names), "id", "left_anti")
    if lab["+"]:
        p = p.join(_labelled(g, lab["+"], names), "id", "left_semi")
    return p.withColumn("k", F.col("path")[0]).join(known, "k").select("s", "path")


@bound("apoc.path.expand")
def expand(g: Graph, spark, starts, types=None, labels_=None, least=1, most=3, *_):
    if isinstance(types, dict):
        return expand_config(g, spark, starts, types)
    return _expanded(g, starts, types, labels_, int(least), int(most))


@bound("apoc.path.expandconfig")
def expand_config(g: Graph, spark, starts, cfg=None, *_):
    c = conf(cfg)
    return _expanded(g, starts, c.get("relationshipFilter"), c.get("labelFilter"), int(c.get("minLevel", 1)), int(c.get("maxLevel", 3)))


@bound("apoc.path.spanningtree")
def spanning_tree(g: Graph, spark, starts, cfg=None, *_):
    c = conf(cfg)
    return _walk(g, starts, c.get("relationshipFilter"), c.get("labelFilter"), 0, int(c.get("maxLevel", 3))).select("s", "path")


@bound("apoc.neighbors.tohop")
def neighbors_to(g: Graph, spark, starts, types=None, hops=1):
    return _walk(g, starts, types, None, 1, int(hops)).select("s", F.col("id").alias("node"))


@bound("apoc.neighbors.byhop")
def neighbors_by(g: Graph, spark, starts, types=None, hops=1):
    """A row for each hop; ``nodes`` is the answer itself, all nodes of the hop."""
    return _walk(g, starts, types, None, 1, int(hops)).groupBy("s", "depth").agg(F.array_sort(F.collect_list("id")).alias("nodes"))


@bound("apoc.neighbors.athop")
def neighbors_at(g: Graph, spark, starts, types=None, hop=1, *_):
    return _walk(g, starts, types, None, int(hop), int(hop)).select("s", F.col("id").alias("node"))


@bound("apoc.neighbors.count")
def neighbors_count(g: Graph, spark, starts, types=None, depth=1, *_):
    found = _walk(g, starts, types, None, 1, int(depth)).groupBy("s").agg(F.count(F.lit(1)).alias("count"))
    own = starts.select("s").distinct()
    return own.join(found, "s", "left").select("s", F.coalesce("count", F.lit(0)).alias("count"))


for _n in BOUND:
    PROCS[_n] = single(_n)


def weighted(g: Graph, types: list[str] | None, weight: str | None) -> DataFrame:
    """``src, dst, weight`` of all relationship tables of these types; a weight that is missing or no number is 1."""
    out, mixed = None, g.mixed(types)
    end = lambda label, c: F.concat(F.lit(f"{label}:"), F.col(c).cast("string")) if mixed else F.col(c)
    for r in g.between(types or [], None, None):
        d = r.df.filter(F.col("_type").isin(types)) if r.type is None and types else r.df
        w = F.col(weight).cast("double") if weight in d.columns else F.col("_props")[weight].try_cast("double") if weight and "_props" in d.columns else F.lit(1.0)
        one = d.select(end(r.src_label, r.src).alias("src"), end(r.dst_label, r.dst).alias("dst"), F.coalesce(w, F.lit(1.0)).alias("weight"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no relationships of that type")
    return out


@proc("apoc.algo.dijkstra", "apoc.algo.astar")
def dijkstra(g: Graph, spark, start, end, types=None, weight=None, *_):
    """Both give the least costly path along edge directions; the estimate of A* would only change the order in which one machine looks at nodes."""
    e = weighted(g, types_of(types), weight)
    kind = dict(e.dtypes)["src"]
    return alg.dijkstra(e, F.lit(start).cast(kind), F.lit(end).cast(kind)).select("path", "weight")


@proc("apoc.algo.allsimplepaths")
def all_simple(g: Graph, spark, start, end, types=None, depth=5):
    e = g.edges(types_of(types))
    kind = dict(e.dtypes)["src"]
    starts = spark.createDataFrame([(start,)], "id string").select(F.col("id").cast(kind).alias("id"))
    return alg.simple_paths(e, starts, 1, int(depth), direction_of(types)).filter(F.col("id") == F.lit(end).cast(kind)).select("path")


# ---------- algorithms
def _edges(g: Graph, label=None, types=None):
    return g.edges(types_of(types), label, label)


@proc("apoc.algo.pagerank")
def pagerank(g: Graph, spark, label=None, types=None, *_):
    return alg.pagerank(_edges(g, label, types)).select(F.col("id").alias("node"), "score")


@proc("apoc.algo.betweenness")
def betweenness(g: Graph, spark, label=None, types=None, *_):
    return alg.betweenness(_edges(g, label, types)).select(F.col("id").alias("node"), "score")


@proc("apoc.algo.closeness")
def closeness(g: Graph, spark, label=None, types=None, *_):
    return alg.closeness(_edges(g, label, types)).select(F.col("id").alias("node"), "score")


@proc("apoc.algo.louvain")
def louvain(g: Graph, spark, label=None, types=None, *_):
    return alg.louvain(_edges(g, label, types)).select(F.col("id").alias("node"), "community")


@proc("apoc.algo.labelpropagation")
def label_propagation(g: Graph, spark, label=None, types=None, *_):
    return alg.label_propagation(_edges(g, label, types)).select(F.col("id").alias("node"), "community")


@proc("apoc.algo.wcc")
def wcc(g: Graph, spark, label=None, types=None, *_):
    return alg.wcc(_edges(g, label, types)).select(F.col("id").alias("node"), "componentId")


@proc("gds.fastrp.stream")
def fastrp(g: Graph, spark, name=None, cfg=None, *_):
    c = conf(cfg)
    return alg.fastrp(PROJECTIONS.get(name, g).edges(), int(c.get("embeddingDimension", 64)), c.get("iterationWeights", (0.0, 1.0, 1.0, 1.0)), int(c.get("randomSeed", 42))).select(F.col("id").alias("nodeId"), "embedding")


@proc("gds.fastrp.stats")
def fastrp_stats(g: Graph, spark, name=None, cfg=None, *_):
    return fastrp(g, spark, name, cfg).agg(F.count(F.lit(1)).alias("nodeCount"), F.first(F.size("embedding")).alias("embeddingDimension"))


def _names(x) -> list[str] | None:
    """Names of a label or type argument: '*' and null are all, a map gives its keys."""
    if not x or x == "*" or x == ["*"]:
        return None
    return [x] if isinstance(x, str) else list(x)


@proc("gds.graph.project")
def project(g: Graph, spark, name, labels_=None, types=None, *_):
    """Keeps the part of the graph with these labels and types, both ends of a relationship included, under a name."""
    labs, kinds = _names(labels_), _names(types)
    nodes, rels = g.nodes, g.rels
    if g.generic:
        d, r = nodes[0].df, rels[0].df
        if labs:
            d = d.filter(F.arrays_overlap("_labels", F.array(*[F.lit(x) for x in labs])))
            ends = d.select(F.col("id").alias("_e"))
            r = r.join(ends, r["src"] == ends["_e"], "left_semi").join(ends, r["dst"] == ends["_e"], "left_semi")
        r = r.filter(F.col("_type").isin(kinds)) if kinds else r
        part = replace(g, nodes=[replace(nodes[0], df=d)], rels=[replace(rels[0], df=r)])
    else:
        ok = lambda x: not labs or x in labs
        part = replace(g, nodes=[n for n in nodes if ok(n.label)], rels=[r for r in rels if (not kinds or r.type in kinds) and ok(r.src_label) and ok(r.dst_label)])
    PROJECTIONS[name] = part
    count = part.edges().count() if part.rels else 0
    return part.all_nodes().agg(F.count(F.lit(1)).alias("nodeCount")).select(F.lit(name).alias("graphName"), "nodeCount", F.lit(count).cast("bigint").alias("relationshipCount"))


@proc("gds.graph.list")
def projections(g: Graph, spark, *_):
    return spark.createDataFrame([(n,) for n in PROJECTIONS], "graphName string")


@proc("gds.graph.drop")
def drop_projection(g: Graph, spark, name, *_):
    PROJECTIONS.pop(name, None)
    return one_row(spark, graphName=name)


def _link(kind: str):
    def f(g: Graph, spark, cfg=None, *_):
        c = conf(cfg)
        e = PROJECTIONS.get(c.get("graph"), g).edges(types_of(c.get("relationshipTypes")))
        source = c.get("sourceNode")
        out = lp.scores(e, kind, None if source is None else [source])
        return out.orderBy(F.desc("score"), "node1", "node2").limit(int(c["topK"])) if c.get("topK") else out

    return f


for _n, _k in (("adamicadar", "adamic_adar"), ("commonneighbors", "common_neighbors"), ("resourceallocation", "resource_allocation"), ("preferentialattachment", "preferential_attachment"), ("jaccard", "jaccard"), ("predict", "ensemble")):
    PROCS[f"gds.linkprediction.{_n}.stream"] = _link(_k)


# ---------- loading and running
@proc("apoc.load.json")
def load_json(g: Graph, spark, path, *_):
    d = spark.read.json(path)
    return d.select(F.struct(*[F.col(f"`{c}`") for c in d.columns]).alias("value"))


@proc("apoc.import.json")
def import_json(g: Graph, spark, path, *_):
    """Adds the nodes and relationships of an export (``path``/nodes, ``path``/relationships) to the graph in place."""
    from loomgraph.sources.graph_files import add_graph, read_graph

    new = read_graph(spark, path)
    n, r = new.nodes[0].df.count(), new.rels[0].df.count()
    add_graph(g, new)
    return one_row(spark, file=path, nodes=n, relationships=r)


@proc("apoc.load.jsonarray")
def load_json_array(g: Graph, spark, path, *_):
    d = spark.read.option("multiLine", True).json(path)
    return d.select(F.struct(*[F.col(f"`{c}`") for c in d.columns]).alias("value"))


@proc("apoc.load.csv")
def load_csv(g: Graph, spark, path, cfg=None, *_):
    c = conf(cfg)
    d = spark.read.option("header", c.get("header", True)).option("sep", c.get("sep", ",")).csv(path)
    names = d.columns
    return d.select(F.array(*[F.col(f"`{n}`") for n in names]).alias("list"), F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"`{n}`"))]).alias("map"))


@proc("apoc.load.parquet", "apoc.load.orc", "apoc.load.text", "apoc.load.xml")
def load_parquet(g: Graph, spark, path, *_):
    d = spark.read.load(path)
    return d.select(F.struct(*[F.col(f"`{c}`") for c in d.columns]).alias("value"))


def statements(text: str) -> list[str]:
    """A script cut at semicolons that stand outside of quotes and comments."""
    parts = re.split(r"""('(?:\\\\.|[^'\\\\])*'|"(?:\\\\.|[^"\\\\])*"|`[^`]*`|//[^\n]*|/\*.*?\*/)|;""".replace("\\\\", "\\"), text, flags=re.S)
    out, now = [], ""
    for i, x in enumerate(parts):
        if i % 2 and x is None:
            out.append(now)
            now = ""
        else:
            now += x or ""
    return [x.strip() for x in [*out, now] if x.strip()]


def _ran(g: Graph, spark, text: str, params: dict) -> DataFrame:
    """One statement; updates change the graph in place."""
    from loomgraph.cypher.write import execute

    done = execute(g, spark, text, params)
    g.nodes, g.rels = done.graph.nodes, done.graph.rels
    d = one_row(spark, updated=True) if done.rows is None else done.rows
    return d.select(F.struct(*[F.col(f"`{c}`") for c in d.columns]).alias("value"))


@proc("apoc.cypher.run", "apoc.cypher.doit")
def run_text(g: Graph, spark, text, params=None, *_):
    return _ran(g, spark, str(text).strip().rstrip(";"), conf(params))


@proc("apoc.cypher.runmany")
def run_many(g: Graph, spark, text, params=None, *_):
    """Statements one after another; rows come as JSON text, since their columns may differ."""
    out = None
    for k, t in enumerate(statements(str(text))):
        one = _ran(g, spark, t, conf(params)).select(F.lit(k).alias("row"), F.to_json("value").alias("result"))
        out = one if out is None else out.union(one)
    return out


@proc("apoc.export.json.query", "apoc.export.csv.query")
def export_query(g: Graph, spark, text, path, cfg=None, *_):
    from loomgraph.cypher.lower import run

    d = run(g, spark, text, conf(conf(cfg).get("params")))
    (d.write.mode("overwrite").option("header", True).csv if str(path).endswith(".csv") else d.write.mode("overwrite").json)(path)
    reader = spark.read.option("header", True).csv if str(path).endswith(".csv") else spark.read.json
    return reader(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(path).alias("file"), "rows")


@proc("apoc.export.json.all")
def export_all(g: Graph, spark, path, *_):
    from loomgraph.sources.graph_files import write_graph

    return write_graph(g, path)


@proc("apoc.export.csv.all")
def export_csv(g: Graph, spark, path, *_):
    from loomgraph.sources.graph_files import write_graph

    return write_graph(g, path, "csv")
