"""Procedures that change the graph they are called on, and measures of communities.

A change makes new tables and puts them in the graph's place; ids and properties are given
as constants or parameters. All need the generic form unless they say otherwise.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import algorithms as alg
from loomgraph.operators import refactor
from loomgraph.plans import graph_library  # noqa: F401  its procedures have further names here
from loomgraph.plans.procedures import PROCS, one_row, proc, types_of
from loomgraph.session import cut


def put(g: Graph, new: Graph, spark, **said) -> DataFrame:
    """The new version takes the old one's place; what changed is written, so that plans don't grow with the number of changes."""
    kept = [t.df for t in (*g.nodes, *g.rels)]
    fresh = lambda t: t if any(t.df is d for d in kept) else refactor.replace(t, df=cut(t.df))
    g.nodes, g.rels = [fresh(t) for t in new.nodes], [fresh(t) for t in new.rels]
    return one_row(spark, **(said or {"changed": True}))


def texts(props: dict | None) -> dict[str, str]:
    """Properties as the map of text that the generic form keeps; null ones are left out."""
    say = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    return {k: say(v) for k, v in (props or {}).items() if v is not None}


def listed(x) -> list:
    return list(x) if isinstance(x, list | tuple) else [x]


def _rows(g: Graph, spark, kind: str, rows: list[dict]) -> Graph:
    """The graph with more nodes or relationships; the other columns of these are null."""
    refactor._need_generic(g)
    old = (g.nodes if kind == "nodes" else g.rels)[0]
    d = old.df
    ddl = "id string, _labels array<string>, _props map<string,string>" if kind == "nodes" else "id string, src string, dst string, _type string, _props map<string,string>"
    new = spark.createDataFrame([tuple(r.values()) for r in rows], ddl)
    both = d.unionByName(new.select(*[F.col(c).cast(t).alias(c) for c, t in d.dtypes if c in new.columns]), allowMissingColumns=True)
    part = refactor.replace(old, df=both)
    return refactor.replace(g, nodes=[part]) if kind == "nodes" else refactor.replace(g, rels=[part])


def _props_of(d: DataFrame, hit: Column, change: dict[str, str], drop: list[str] = ()) -> DataFrame:
    """Rows where ``hit`` with these properties set and those left out."""
    rest = F.map_filter("_props", lambda k, _: ~k.isin(*change, *drop)) if change or drop else F.col("_props")
    new = F.map_concat(rest, F.create_map(*[F.lit(x) for kv in change.items() for x in kv])) if change else rest
    return d.withColumn("_props", F.when(hit, new).otherwise(F.col("_props")))


# ---------- create
@proc("apoc.create.node")
def create_node(g: Graph, spark, labels, props=None, *_):
    key = str(uuid.uuid4())
    return put(g, _rows(g, spark, "nodes", [{"id": key, "l": listed(labels), "p": texts(props)}]), spark, node=key)


@proc("apoc.create.nodes")
def create_nodes(g: Graph, spark, labels, many, *_):
    rows = [{"id": str(uuid.uuid4()), "l": listed(labels), "p": texts(p)} for p in many]
    put(g, _rows(g, spark, "nodes", rows), spark)
    return spark.createDataFrame([(r["id"],) for r in rows], "node string")


@proc("apoc.create.relationship")
def create_relationship(g: Graph, spark, start, kind, props, end, *_):
    key = str(uuid.uuid4())
    return put(g, _rows(g, spark, "rels", [{"id": key, "s": str(start), "d": str(end), "t": kind, "p": texts(props)}]), spark, rel=key)


@proc("apoc.create.addlabels", "apoc.label.add")
def add_labels(g: Graph, spark, ids, labels, *_):
    return put(g, refactor.set_labels(g, F.col("id").isin(*map(str, listed(ids))), add=listed(labels)), spark)


@proc("apoc.create.removelabels", "apoc.label.remove")
def remove_labels(g: Graph, spark, ids, labels, *_):
    return put(g, refactor.set_labels(g, F.col("id").isin(*map(str, listed(ids))), remove=listed(labels)), spark)


@proc("apoc.label.replace")
def replace_label(g: Graph, spark, ids, old, new, *_):
    return put(g, refactor.set_labels(g, F.col("id").isin(*map(str, listed(ids))) & F.array_contains("_labels", old), [new], [old]), spark)


@proc("apoc.label.clear")
def clear_labels(g: Graph, spark, ids, *_):
    hit = F.col("id").isin(*map(str, listed(ids)))
    return put(g, refactor._nodes(g, lambda d: d.withColumn("_labels", F.when(hit, F.array().cast("array<string>")).otherwise(F.col("_labels")))), spark)


@proc("apoc.create.setproperty", "apoc.node.setproperty")
def set_property(g: Graph, spark, ids, name, value, *_):
    return set_properties(g, spark, ids, [name], [value])


@proc("apoc.create.setproperties")
def set_properties(g: Graph, spark, ids, names, values, *_):
    given = dict(zip(names, values, strict=True))
    hit = F.col("id").isin(*map(str, listed(ids)))
    return put(g, refactor._nodes(g, lambda d: _props_of(d, hit, texts(given), [k for k, v in given.items() if v is None])), spark)


@proc("apoc.create.removeproperties", "apoc.node.removeproperties", "apoc.node.removeproperty")
def remove_properties(g: Graph, spark, ids, names, *_):
    hit = F.col("id").isin(*map(str, listed(ids)))
    return put(g, refactor._nodes(g, lambda d: _props_of(d, hit, {}, listed(names))), spark)


@proc("apoc.create.setrelproperty", "apoc.rel.setproperty")
def set_rel_property(g: Graph, spark, ids, name, value, *_):
    return set_rel_properties(g, spark, ids, [name], [value])


@proc("apoc.create.setrelproperties")
def set_rel_properties(g: Graph, spark, ids, names, values, *_):
    given = dict(zip(names, values, strict=True))
    hit = F.col("id").isin(*map(str, listed(ids)))
    return put(g, refactor._rels(g, lambda d: _props_of(d, hit, texts(given), [k for k, v in given.items() if v is None])), spark)


@proc("apoc.create.removerelproperties", "apoc.rel.removeproperties", "apoc.rel.removeproperty")
def remove_rel_properties(g: Graph, spark, ids, names, *_):
    hit = F.col("id").isin(*map(str, listed(ids)))
    return put(g, refactor._rels(g, lambda d: _props_of(d, hit, {}, listed(names))), spark)


@proc("apoc.create.uuid")
def new_uuid(g: Graph, spark, *_):
    return one_row(spark, uuid=str(uuid.uuid4()))


@proc("apoc.create.uuids")
def new_uuids(g: Graph, spark, n, *_):
    return spark.range(int(n)).select(F.uuid().alias("uuid"))


# ---------- merge
def _same(props: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col("_props")[k] == v for k, v in props.items()], F.lit(True))


@proc("apoc.merge.node", "apoc.merge.mergenode", "apoc.merge.nodeeager")
def merge_node(g: Graph, spark, labels, ident, on_create=None, on_match=None, *_):
    """Nodes with all labels and identifying properties take ``on_match``; if there is none, one is made with ``on_create``."""
    hit = reduce(lambda a, b: a & b, [F.array_contains("_labels", x) for x in listed(labels)], _same(texts(ident)))
    found = [r.id for r in g.nodes[0].df.filter(hit).select("id").limit(1).collect()]
    if not found:
        return create_node(g, spark, labels, {**(ident or {}), **(on_create or {})})
    if on_match:
        put(g, refactor._nodes(g, lambda d: _props_of(d, hit, texts(on_match))), spark)
    return g.nodes[0].df.filter(hit).select(F.col("id").alias("node"))


@proc("apoc.merge.relationship", "apoc.merge.mergerelationship", "apoc.merge.relationshipeager")
def merge_relationship(g: Graph, spark, start, kind, ident, on_create, end, on_match=None, *_):
    hit = (F.col("src") == str(start)) & (F.col("dst") == str(end)) & (F.col("_type") == kind) & _same(texts(ident))
    if not g.rels[0].df.filter(hit).take(1):
        return create_relationship(g, spark, start, kind, {**(ident or {}), **(on_create or {})}, end)
    if on_match:
        put(g, refactor._rels(g, lambda d: _props_of(d, hit, texts(on_match))), spark)
    return g.rels[0].df.filter(hit).select(F.col("id").alias("rel"))


@proc("apoc.merge.properties")
def merge_properties(g: Graph, spark, ids, props, *_):
    hit = F.col("id").isin(*map(str, listed(ids)))
    return put(g, refactor._nodes(g, lambda d: _props_of(d, hit, texts(props))), spark)


@proc("apoc.merge.labels")
def merge_labels(g: Graph, spark, ids, labels, *_):
    return add_labels(g, spark, ids, labels)


@proc("apoc.merge.nodes", "apoc.refactor.mergenodes")
def merge_nodes(g: Graph, spark, ids, *_):
    """All given nodes go into the first."""
    ids = [str(i) for i in ids]
    pairs = spark.createDataFrame([(i, ids[0]) for i in ids[1:]], "id string, into string")
    return put(g, refactor.merge_nodes(g, pairs), spark, node=ids[0])


# ---------- one property in one step
def _atomic(new):
    def f(g: Graph, spark, node, name, *args):
        hit = F.col("id") == str(node)
        old = F.col("_props")[name]
        rest = F.map_filter("_props", lambda k, _: k != name)
        v = new(old, *args)
        change = F.when(v.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), v)))
        put(g, refactor._nodes(g, lambda d: d.withColumn("_props", F.when(hit, change).otherwise(F.col("_props")))), spark)
        return g.nodes[0].df.filter(hit).select(F.col("id").alias("node"), F.col("_props")[name].alias("value"))

    return f


def _number(c: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def _listed(old: Column) -> Column:
    return F.coalesce(F.from_json(old, "array<string>"), F.array().cast("array<string>"))


_num = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
PROCS["apoc.atomic.add"] = _atomic(lambda old, n: _number(_num(old) + float(n)))
PROCS["apoc.atomic.subtract"] = _atomic(lambda old, n: _number(_num(old) - float(n)))
PROCS["apoc.atomic.increment"] = _atomic(lambda old, n=1: _number(_num(old) + float(n)))
PROCS["apoc.atomic.decrement"] = _atomic(lambda old, n=1: _number(_num(old) - float(n)))
PROCS["apoc.atomic.concat"] = _atomic(lambda old, x: F.concat(F.coalesce(old, F.lit("")), F.lit(str(x))))
PROCS["apoc.atomic.update"] = _atomic(lambda old, x: F.lit(None if x is None else str(x)))
PROCS["apoc.atomic.compareandswap"] = _atomic(lambda old, expect, new: F.when(old.eqNullSafe(F.lit(None if expect is None else str(expect))), F.lit(str(new))).otherwise(old))
PROCS["apoc.atomic.insert"] = _atomic(lambda old, at, x: F.to_json(F.array_insert(_listed(old), F.lit(int(at) + 1), F.lit(str(x)))))
PROCS["apoc.atomic.remove"] = _atomic(lambda old, at: F.to_json(F.filter(_listed(old), lambda _, i: i != int(at))))


# ---------- shape (typed graphs too where ``refactor`` allows)
def _shape(f):
    return lambda g, spark, *a: put(g, f(g, *a), spark)


for _n, _f in {
    "renamelabel": refactor.rename_label, "renametype": refactor.rename_type, "settype": refactor.rename_type, "changetype": refactor.rename_type, "renameproperty": refactor.rename_property,
    "invertrelationship": refactor.invert, "invert": refactor.invert, "mergerelationships": lambda g, *_: refactor.merge_parallel(g), "collapsenode": refactor.collapse_node, "extractnode": refactor.extract_node,
    "categorizeproperty": refactor.categorize, "normalizeasboolean": refactor.normalize_boolean,
}.items():
    PROCS[f"apoc.refactor.{_n}"] = _shape(_f)


@proc("apoc.refactor.clonesubgraph", "apoc.create.clonesubgraph")
def clone_subgraph(g: Graph, spark, ids, suffix="'", *_):
    return put(g, refactor.clone_subgraph(g, spark.createDataFrame([(str(i),) for i in ids], "id string"), suffix), spark)


@proc("apoc.refactor.clonenodes", "apoc.create.clone", "apoc.node.clone")
def clone_nodes(g: Graph, spark, ids, suffix="'", *_):
    """Copies without relationships, their ids with a suffix."""
    hit = g.nodes[0].df.filter(F.col("id").isin(*map(str, listed(ids)))).withColumn("id", F.concat("id", F.lit(suffix)))
    put(g, refactor._nodes(g, lambda d: d.unionByName(hit)), spark)
    return hit.select(F.col("id").alias("node"))


@proc("apoc.refactor.redirectrelationship")
def redirect(g: Graph, spark, rel, end, *_):
    hit = F.col("id") == str(rel)
    return put(g, refactor._rels(g, lambda d: d.withColumn("dst", F.when(hit, F.lit(str(end))).otherwise(F.col("dst")))), spark)


@proc("apoc.refactor.from")
def redirect_start(g: Graph, spark, rel, start, *_):
    hit = F.col("id") == str(rel)
    return put(g, refactor._rels(g, lambda d: d.withColumn("src", F.when(hit, F.lit(str(start))).otherwise(F.col("src")))), spark)


@proc("apoc.nodes.delete", "apoc.refactor.deletenodes")
def delete_nodes(g: Graph, spark, ids, *_):
    """The nodes with all their relationships."""
    ids = [str(i) for i in listed(ids)]
    g2 = refactor._nodes(g, lambda d: d.filter(~F.col("id").isin(*ids)))
    return put(g, refactor._rels(g2, lambda d: d.filter(~F.col("src").isin(*ids) & ~F.col("dst").isin(*ids))), spark)


@proc("apoc.rel.delete")
def delete_rels(g: Graph, spark, ids, *_):
    return put(g, refactor._rels(g, lambda d: d.filter(~F.col("id").isin(*map(str, listed(ids))))), spark)


@proc("apoc.nodes.link")
def link(g: Graph, spark, ids, kind, *_):
    """A chain through the nodes in the order given."""
    ids = [str(i) for i in ids]
    return put(g, _rows(g, spark, "rels", [{"id": str(uuid.uuid4()), "s": a, "d": b, "t": kind, "p": {}} for a, b in zip(ids, ids[1:], strict=False)]), spark)


@proc("apoc.rel.reverse")
def reverse_rel(g: Graph, spark, rel, *_):
    hit = F.col("id") == str(rel)
    return put(g, refactor._rels(g, lambda d: d.select(*[F.when(hit, F.col({"src": "dst", "dst": "src"}[c])).otherwise(F.col(c)).alias(c) if c in ("src", "dst") else F.col(c) for c in d.columns])), spark)


# ---------- communities
def _part(g: Graph, label, types) -> DataFrame:
    return g.edges(types_of(types), label, label)


PROCS["apoc.community.louvain"] = PROCS["apoc.algo.community"] = PROCS["apoc.algo.louvain"]
PROCS["apoc.community.labelpropagation"] = PROCS["apoc.algo.labelpropagation"]
PROCS["apoc.community.connectedcomponents"] = PROCS["apoc.community.weaklyconnectedcomponents"] = PROCS["apoc.algo.wcc"]
PROCS["apoc.community.trianglecount"] = PROCS["apoc.algo.trianglecount"]
PROCS["apoc.algo.betweennesscentrality"], PROCS["apoc.algo.closenesscentrality"] = PROCS["apoc.algo.betweenness"], PROCS["apoc.algo.closeness"]


@proc("apoc.algo.degreecentrality")
def degree_centrality(g: Graph, spark, label=None, types=None, *_):
    """``node, score``: neighbours of each node over all other nodes of the edges."""
    e = cut(alg.undirected(_part(g, label, types)))
    n = alg.vertices(_part(g, label, types)).count()
    return e.groupBy(F.col("src").alias("node")).agg((F.count(F.lit(1)) / max(n - 1, 1)).alias("score"))


@proc("apoc.community.numcomponents")
def num_components(g: Graph, spark, label=None, types=None, *_):
    return alg.wcc(_part(g, label, types)).agg(F.count_distinct("componentId").alias("count"))


@proc("apoc.community.totaltriangles")
def total_triangles(g: Graph, spark, label=None, types=None, *_):
    return alg.triangles(_part(g, label, types)).agg((F.coalesce(F.sum("triangles"), F.lit(0)) / 3).cast("bigint").alias("triangles"))


def _clustering(g: Graph, label, types) -> DataFrame:
    e = _part(g, label, types)
    d = alg.undirected(e).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    t = alg.vertices(e).join(d, "id", "left").join(alg.triangles(e), "id", "left")
    return t.select(F.col("id").alias("node"), F.coalesce(F.try_divide(2 * F.col("triangles"), F.col("d") * (F.col("d") - 1)), F.lit(0.0)).alias("coefficient"))


@proc("apoc.community.clusteringcoefficient")
def clustering(g: Graph, spark, label=None, types=None, *_):
    """``node, coefficient``: linked pairs of neighbours over all pairs of neighbours; 0 for fewer than two."""
    return _clustering(g, label, types)


@proc("apoc.community.averageclusteringcoefficient")
def mean_clustering(g: Graph, spark, label=None, types=None, *_):
    return _clustering(g, label, types).agg(F.coalesce(F.avg("coefficient"), F.lit(0.0)).alias("coefficient"))


@proc("apoc.community.density")
def density(g: Graph, spark, label=None, types=None, *_):
    """Different linked pairs over all pairs of nodes, undirected."""
    e = _part(g, label, types)
    n, m = alg.vertices(e).count(), alg.undirected(e).count()
    return one_row(spark, density=m / (n * (n - 1)) if n > 1 else 0.0)


@proc("apoc.community.kcore")
def k_core(g: Graph, spark, k, label=None, types=None, *_):
    return alg.k_core(_part(g, label, types), int(k)).select(F.col("id").alias("node"))


@proc("apoc.community.corenumber")
def core_number(g: Graph, spark, label=None, types=None, *_):
    return alg.core_numbers(_part(g, label, types)).select(F.col("id").alias("node"), "core")


@proc("apoc.community.stronglyconnectedcomponents")
def scc(g: Graph, spark, label=None, types=None, *_):
    return alg.scc(_part(g, label, types)).select(F.col("id").alias("node"), "component")


def communities(g: Graph, label, types, prop) -> tuple[DataFrame, DataFrame]:
    """Undirected edges, and ``id, c``: each node's community out of a property, or by Louvain if none is named."""
    e = _part(g, label, types)
    if prop:
        refactor._need_generic(g)
        c = g.nodes[0].df.select("id", F.col("_props")[prop].alias("c")).filter("c is not null")
    else:
        c = alg.louvain(e).select("id", F.col("community").alias("c"))
    return cut(alg.undirected(e)), cut(c)


@proc("apoc.community.modularity")
def modularity(g: Graph, spark, label=None, types=None, prop=None, *_):
    """The share of edges inside communities less what degrees alone would give."""
    e, c = communities(g, label, types, prop)
    deg = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")).join(c, "id").groupBy("c").agg(F.sum("d").alias("d"))
    x = e.join(c.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst")
    m2 = max(e.count(), 1)
    inside = x.filter("a = b").count()
    return deg.agg((F.lit(inside / m2) - F.coalesce(F.sum((F.col("d") / m2) ** 2), F.lit(0.0))).alias("modularity"))


@proc("apoc.community.conductance")
def conductance(g: Graph, spark, label=None, types=None, prop=None, *_):
    """``community, conductance``: edges that leave it over the lesser of its degrees and those of the rest."""
    e, c = communities(g, label, types, prop)
    x = e.join(c.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst", "left")
    m2 = e.count()
    s = x.groupBy(F.col("a").alias("community")).agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("out"), F.count(F.lit(1)).alias("vol"))
    return s.select("community", F.coalesce(F.try_divide("out", F.least("vol", F.lit(m2) - F.col("vol"))), F.lit(0.0)).alias("conductance"))


for _n, _of in {
    "node.setproperties": "create.setproperties", "node.addlabel": "create.addlabels", "node.addlabels": "create.addlabels", "node.removelabel": "create.removelabels", "node.removelabels": "create.removelabels", "rel.setproperties": "create.setrelproperties",
    "label.merge": "create.addlabels", "export.json": "export.json.all", "export.jsonall": "export.json.all", "export.csv": "export.csv.all", "export.csvall": "export.csv.all", "refactor.clonesubgraphfrompaths": "refactor.clonesubgraph",
}.items():
    PROCS[f"apoc.{_n}"] = PROCS[f"apoc.{_of}"]


@proc("apoc.graph.validate")
def validate(g: Graph, spark, *_):
    return PROCS["apoc.schema.validate"](g, spark)


@proc("apoc.graph.nodes")
def graph_nodes(g: Graph, spark, *_):
    return g.all_nodes().select(F.col("id").alias("node"), "label")


@proc("apoc.graph.relationships")
def graph_relationships(g: Graph, spark, *_):
    return g.edges()


@proc("apoc.neighbors.exists")
def near_exists(g: Graph, spark, start, types=None, depth=1, *_):
    found = PROCS["apoc.neighbors.count"](g, spark, start, types, depth)
    return found.agg((F.coalesce(F.max("count"), F.lit(0)) > 0).alias("exists"))


@proc("apoc.cypher.runfirstcolumn", "apoc.cypher.runfirstcolumnmany")
def first_column(g: Graph, spark, text, params=None, *_):
    """Values of the first column of a reading query."""
    from loomgraph.cypher.lower import run

    d = run(g, spark, text, params or {})
    return d.select(F.col(f"`{d.columns[0]}`").alias("value"))


@proc("apoc.cypher.runfirstcolumnsingle")
def first_value(g: Graph, spark, text, params=None, *_):
    return first_column(g, spark, text, params).limit(1)


@proc("apoc.cypher.tojson")
def as_json(g: Graph, spark, text, params=None, *_):
    from loomgraph.cypher.lower import run

    d = run(g, spark, text, params or {})
    return d.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in d.columns])).alias("value"))


@proc("apoc.hashing.fingerprintgraph")
def fingerprint(g: Graph, spark, *_):
    """One number for a generic graph's elements whatever their order: the sum of a hash of each."""
    refactor._need_generic(g)
    n = g.nodes[0].df.select(F.xxhash64("id", F.array_sort("_labels"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("_props"))))).alias("h"))
    r = g.rels[0].df.select(F.xxhash64("src", "dst", "_type", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("_props"))))))
    return n.union(r).agg(F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("value"))


# ---------- many rows, and repeatedly
@proc("apoc.periodic.iterate", "apoc.periodic.rock_n_roll")
def iterate(g: Graph, spark, rows, update, cfg=None, *_):
    """An update for each row of a reading query, as one plan: a version is made in one step, whatever the size of a batch."""
    from loomgraph.cypher.lower import run
    from loomgraph.cypher.write import batched

    total = run(g, spark, rows).count()
    put(g, batched(g, spark, rows, update, (cfg or {}).get("params")).graph, spark)
    return one_row(spark, batches=1 if total else 0, total=total)


@proc("apoc.periodic.commit")
def commit(g: Graph, spark, text, params=None, *_):
    """An update that returns how much it did, again and again until that is nothing."""
    from loomgraph.cypher.write import execute

    total = runs = 0
    while True:
        done = execute(g, spark, text, params or {})
        n = done.rows.first()[0] if done.rows is not None else 0
        put(g, done.graph, spark)
        runs += 1
        if not n:
            return one_row(spark, updates=total, executions=runs)
        total += n


PROCS["apoc.cypher.doitall"] = PROCS["apoc.cypher.runmany"]


@proc("db.create.setnodevectorproperty")
def set_vector(g: Graph, spark, node, name, vector, *_):
    """Puts a vector on a node: an array column of a typed table, JSON text in the generic form."""
    if g.generic:
        return set_properties(g, spark, node, [name], [json.dumps(list(map(float, vector)))])
    label, _, key = str(node).rpartition(":")
    new = F.array(*[F.lit(float(x)) for x in vector])

    def change(n):
        if label and n.label != label:
            return n
        old = F.col(name).cast("array<double>") if name in n.df.columns else F.lit(None).cast("array<double>")
        return refactor.replace(n, df=n.df.withColumn(name, F.when(F.col(n.id).cast("string") == key, new).otherwise(old)))

    return put(g, refactor.replace(g, nodes=[change(n) for n in g.nodes]), spark)


@proc("db.create.setrelationshipvectorproperty")
def set_rel_vector(g: Graph, spark, rel, name, vector, *_):
    return set_rel_properties(g, spark, rel, [name], [json.dumps(list(map(float, vector)))])
