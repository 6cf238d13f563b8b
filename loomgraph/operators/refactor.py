"""Changes of a graph's shape, each a new version; all are column changes, unions or joins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.graph import Graph, generic_graph


def _need_generic(g: Graph) -> None:
    if not g.generic:
        raise ValueError("this change needs a generic graph")


def _nodes(g: Graph, f) -> Graph:
    _need_generic(g)
    return replace(g, nodes=[replace(g.nodes[0], df=f(g.nodes[0].df))])


def _rels(g: Graph, f) -> Graph:
    _need_generic(g)
    return replace(g, rels=[replace(g.rels[0], df=f(g.rels[0].df))])


def rename_label(g: Graph, old: str, new: str) -> Graph:
    if not g.generic:
        r = [replace(x, src_label=new if x.src_label == old else x.src_label, dst_label=new if x.dst_label == old else x.dst_label) for x in g.rels]
        return replace(g, nodes=[replace(n, label=new) if n.label == old else n for n in g.nodes], rels=r)
    return _nodes(g, lambda d: d.withColumn("_labels", F.transform("_labels", lambda x: F.when(x == old, new).otherwise(x))))


def rename_type(g: Graph, old: str, new: str) -> Graph:
    if not g.generic:
        return replace(g, rels=[replace(r, type=new) if r.type == old else r for r in g.rels])
    return _rels(g, lambda d: d.withColumn("_type", F.when(F.col("_type") == old, new).otherwise(F.col("_type"))))


def rename_property(g: Graph, old: str, new: str) -> Graph:
    return _nodes(g, lambda d: d.withColumn("_props", F.transform_keys("_props", lambda k, _: F.when(k == old, new).otherwise(k))))


def _split(label: str) -> Column:
    return F.array_contains("_labels", label)


def set_labels(g: Graph, where: Column, add: list[str] = (), remove: list[str] = ()) -> Graph:
    lab = F.array_except(F.array_union("_labels", F.array(*map(F.lit, add)).cast("array<string>")), F.array(*map(F.lit, remove)).cast("array<string>"))
    return _nodes(g, lambda d: d.withColumn("_labels", F.when(where, lab).otherwise(F.col("_labels"))))


def invert(g: Graph, kind: str) -> Graph:
    if not g.generic:
        return replace(g, rels=[replace(r, src=r.dst, dst=r.src, src_label=r.dst_label, dst_label=r.src_label, owner={"src": "dst", "dst": "src", None: None}[r.owner]) if r.type == kind else r for r in g.rels])
    hit = F.col("_type") == kind
    return _rels(g, lambda d: d.withColumn("_s", F.when(hit, F.col("dst")).otherwise(F.col("src"))).withColumn("dst", F.when(hit, F.col("src")).otherwise(F.col("dst"))).withColumn("src", F.col("_s")).drop("_s"))


def merge_nodes(g: Graph, pairs) -> Graph:
    """``pairs`` has ``id`` and ``into``: each node goes into another, its relationships with it; labels are united, the kept node's properties win."""
    _need_generic(g)
    p = pairs.filter("id <> into").select("id", "into")
    n, r = g.nodes[0].df, g.rels[0].df
    gone = n.join(p, "id").groupBy("into").agg(F.flatten(F.collect_list("_labels")).alias("_l"), F.flatten(F.collect_list(F.map_entries("_props"))).alias("_p"))
    kept = n.join(p.select("id"), "id", "left_anti").join(gone.withColumnRenamed("into", "id"), "id", "left")
    extra = F.filter(F.coalesce("_p", F.array()), lambda e: ~F.array_contains(F.map_keys("_props"), e["key"]))
    first = F.filter(extra, lambda e, i: ~F.exists(F.slice(extra, 1, i), lambda o: o["key"] == e["key"]))
    kept = kept.withColumn("_labels", F.array_distinct(F.concat("_labels", F.coalesce("_l", F.array().cast("array<string>"))))).withColumn("_props", F.when(F.col("_p").isNotNull(), F.map_concat("_props", F.map_from_entries(first))).otherwise(F.col("_props"))).select(*n.columns)
    for end in ("src", "dst"):
        r = r.join(p.select(F.col("id").alias(end), "into"), end, "left").withColumn(end, F.coalesce("into", F.col(end))).drop("into")
    return replace(g, nodes=[replace(g.nodes[0], df=kept)], rels=[replace(g.rels[0], df=r.select(*g.rels[0].df.columns))])


def merge_parallel(g: Graph) -> Graph:
    """Of relationships with the same ends and type one is left, that of the least id."""
    return _rels(g, lambda d: d.groupBy("src", "dst", "_type").agg(F.min_by(F.struct(*d.columns), "id").alias("r")).select("r.*"))


def collapse_node(g: Graph, label: str, kind: str) -> Graph:
    """Every node of a label becomes relationships from each that points at it to each that it points at."""
    _need_generic(g)
    n, r = g.nodes[0].df, g.rels[0].df
    mid = n.filter(_split(label)).select(F.col("id").alias("m"))
    a, b = r.join(mid, F.col("dst") == F.col("m"), "left_semi"), r.join(mid, F.col("src") == F.col("m"), "left_semi")
    new = a.select("src", F.col("dst").alias("m"), F.col("id").alias("x")).join(b.select(F.col("src").alias("m"), "dst", F.col("id").alias("y")), "m")
    new = new.select(F.concat_ws("+", "x", "y").alias("id"), "src", "dst", F.lit(kind).alias("_type"), F.create_map().cast("map<string,string>").alias("_props"))
    rest = r.join(mid.select(F.col("m").alias("src")), "src", "left_anti").join(mid.select(F.col("m").alias("dst")), "dst", "left_anti")
    return replace(g, nodes=[replace(g.nodes[0], df=n.filter(~_split(label)))], rels=[replace(g.rels[0], df=rest.unionByName(new, allowMissingColumns=True).select(*r.columns))])


def extract_node(g: Graph, kind: str, label: str, first: str, second: str) -> Graph:
    """Every relationship of a type becomes a node with two relationships, which takes its properties."""
    _need_generic(g)
    n, r = g.nodes[0].df, g.rels[0].df
    own = r.filter(F.col("_type") == kind)
    node = own.select(F.concat(F.lit("n:"), "id").alias("id"), F.array(F.lit(label)).alias("_labels"), "_props")
    none = F.create_map().cast("map<string,string>")
    a = own.select(F.concat("id", F.lit(":a")).alias("id"), "src", F.concat(F.lit("n:"), "id").alias("dst"), F.lit(first).alias("_type"), none.alias("_props"))
    b = own.select(F.concat("id", F.lit(":b")).alias("id"), F.concat(F.lit("n:"), "id").alias("src"), "dst", F.lit(second).alias("_type"), none.alias("_props"))
    rest = r.filter(F.col("_type") != kind).unionByName(a, allowMissingColumns=True).unionByName(b, allowMissingColumns=True)
    return replace(g, nodes=[replace(g.nodes[0], df=n.unionByName(node, allowMissingColumns=True))], rels=[replace(g.rels[0], df=rest)])


def categorize(g: Graph, prop: str, kind: str, label: str) -> Graph:
    """Each value of a property becomes a node that those who had it point at; the property goes."""
    _need_generic(g)
    n, r = g.nodes[0].df, g.rels[0].df
    val = n.select("id", F.col("_props")[prop].alias("v")).filter("v is not null")
    node = val.select("v").distinct().select(F.concat(F.lit(f"{label}:"), "v").alias("id"), F.array(F.lit(label)).alias("_labels"), F.create_map(F.lit("name"), F.col("v")).alias("_props"))
    rel = val.select(F.concat_ws("+", F.lit(kind), "id").alias("id"), F.col("id").alias("src"), F.concat(F.lit(f"{label}:"), "v").alias("dst"), F.lit(kind).alias("_type"), F.create_map().cast("map<string,string>").alias("_props"))
    kept = n.withColumn("_props", F.map_filter("_props", lambda k, _: k != prop))
    return replace(g, nodes=[replace(g.nodes[0], df=kept.unionByName(node, allowMissingColumns=True))], rels=[replace(g.rels[0], df=r.unionByName(rel, allowMissingColumns=True))])


def normalize_boolean(g: Graph, prop: str, true: list[str], false: list[str]) -> Graph:
    v = F.col("_props")[prop]
    new = F.when(v.isin(*true), "true").when(v.isin(*false), "false")
    m = F.map_filter("_props", lambda k, _: k != prop)
    return _nodes(g, lambda d: d.withColumn("_props", F.when(v.isNull(), F.col("_props")).when(new.isNotNull(), F.map_concat(m, F.create_map(F.lit(prop), new))).otherwise(m)))


def subgraph(g: Graph, ids) -> Graph:
    """The nodes of ``ids`` (a column ``id``) and the relationships between them."""
    _need_generic(g)
    r = g.rels[0].df.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return replace(g, nodes=[replace(g.nodes[0], df=g.nodes[0].df.join(ids.select("id"), "id", "left_semi"))], rels=[replace(g.rels[0], df=r.select(*g.rels[0].df.columns))])


def clone_subgraph(g: Graph, ids, suffix: str = "'") -> Graph:
    """The graph with a copy of the subgraph of ``ids`` beside it."""
    s = subgraph(g, ids)
    n = s.nodes[0].df.withColumn("id", F.concat("id", F.lit(suffix)))
    r = s.rels[0].df.withColumns({c: F.concat(c, F.lit(suffix)) for c in ("id", "src", "dst")})
    return replace(g, nodes=[replace(g.nodes[0], df=g.nodes[0].df.unionByName(n))], rels=[replace(g.rels[0], df=g.rels[0].df.unionByName(r))])


def from_edges(edges, src: str, dst: str, label: str = "Node", kind: str = "REL") -> Graph:
    """A generic graph of the ends and pairs of a table."""
    n = edges.select(F.explode(F.array(F.col(src).cast("string"), F.col(dst).cast("string"))).alias("id")).filter("id is not null").distinct()
    n = n.select("id", F.array(F.lit(label)).alias("labels"), F.create_map().cast("map<string,string>").alias("props"))
    e = edges.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst")).filter("src is not null and dst is not null").distinct()
    return generic_graph(n, e.select(F.concat_ws(">", "src", "dst").alias("id"), "src", "dst", F.lit(kind).alias("type"), F.create_map().cast("map<string,string>").alias("props")))


def difference(a: Graph, b: Graph):
    """``id, change`` of nodes that only one graph has or whose labels or properties differ."""
    x = a.nodes[0].df.select("id", F.array_sort("_labels").alias("l1"), F.array_sort(F.map_entries("_props")).alias("p1"))
    y = b.nodes[0].df.select("id", F.array_sort("_labels").alias("l2"), F.array_sort(F.map_entries("_props")).alias("p2"))
    j = x.join(y, "id", "full")
    c = F.when(F.col("l2").isNull(), "left only").when(F.col("l1").isNull(), "right only").when(~F.col("l1").eqNullSafe(F.col("l2")) | ~F.col("p1").eqNullSafe(F.col("p2")), "changed")
    return j.select("id", c.alias("change")).filter("change is not null")
