"""Graphs in files: JSON lines, CSV, parquet, and dumps with nodes and relationships."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import Graph, NodeTable, RelTable, generic_graph

NODE = "id string, labels array<string>, properties map<string,string>"
REL = "id string, type string, startNode string, endNode string, properties map<string,string>"


def _flat(d: DataFrame) -> DataFrame:
    """Labels joined by ';' and properties as JSON text, for CSV."""
    return d.select(*[F.array_join(c, ";").alias(c) if t.startswith("array") else F.to_json(c).alias(c) if t.startswith("map") else F.col(c) for c, t in d.dtypes])


def write_graph(g: Graph, path: str, form: str = "json") -> DataFrame:
    """Nodes and relationships as JSON lines, or as CSV with a header, in two folders; returns what was written."""
    if not g.generic:
        n = None
        for t in g.nodes:
            props = F.create_map(*[x for c in t.props for x in (F.lit(c), F.col(c).cast("string"))])
            one = t.df.select(F.concat_ws(":", F.lit(t.label), F.col(t.id).cast("string")).alias("id"), F.array(F.lit(t.label)).alias("labels"), props.alias("properties"))
            n = one if n is None else n.union(one)
        r = None
        for t in g.rels:
            props = F.create_map(*[x for c in t.props for x in (F.lit(c), F.col(c).cast("string"))]) if t.props else F.create_map().cast("map<string,string>")
            rid = F.concat_ws("|", F.lit(t.type), *[F.col(c).cast("string") for c in t.id])
            one = t.df.select(rid.alias("id"), F.lit(t.type).alias("type"), F.concat_ws(":", F.lit(t.src_label), F.col(t.src).cast("string")).alias("startNode"), F.concat_ws(":", F.lit(t.dst_label), F.col(t.dst).cast("string")).alias("endNode"), props.alias("properties"))
            r = one if r is None else r.union(one)
    else:
        n = g.nodes[0].df.select("id", F.col("_labels").alias("labels"), F.col("_props").alias("properties"))
        r = g.rels[0].df.select("id", F.col("_type").alias("type"), F.col("src").alias("startNode"), F.col("dst").alias("endNode"), F.col("_props").alias("properties"))
    spark = n.sparkSession
    for part, d in (("nodes", n), ("relationships", r)):
        out = d.write.mode("overwrite")
        if form == "csv":
            _flat(d).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{part}")
        else:
            out.json(f"{path}/{part}")
    read = (lambda part: spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{path}/{part}")) if form == "csv" else (lambda part: spark.read.schema(NODE if part == "nodes" else REL).json(f"{path}/{part}"))
    count = lambda part: read(part).agg(F.count(F.lit(1)).alias(part))
    return count("nodes").crossJoin(count("relationships")).select(F.lit(path).alias("file"), "nodes", "relationships")  # a row each


def add_graph(g: Graph, new: Graph) -> Graph:
    """Puts the elements of a generic graph into ``g``, which is changed: a typed graph gets a table for each new label and type."""
    n, r = new.nodes[0].df, new.rels[0].df
    if g.generic:
        g.nodes = [replace(g.nodes[0], df=g.nodes[0].df.unionByName(n, allowMissingColumns=True))]
        g.rels = [replace(g.rels[0], df=g.rels[0].df.unionByName(r, allowMissingColumns=True))]
        return g
    prop = lambda d, c: sorted(x[0] for x in d.select(F.explode(F.map_keys(c))).distinct().collect())  # noqa: E731  names of properties
    plain = lambda x: F.regexp_replace(x, "^[^:|]*:", "")  # noqa: E731  exported ids begin with their label
    names = [x[0] for x in n.select(F.col("_labels")[0]).distinct().collect()]
    label = {x: x for x in names}
    for x in names:
        own = n.filter(F.col("_labels")[0] == x)
        cols = [c for c in prop(own, "_props") if c != "id"]
        d = own.select(plain("id").alias("id"), *[F.col("_props")[c].alias(c) for c in cols])
        old = next((t for t in g.nodes if t.label == x), None)
        if old is None:
            g.nodes = [*g.nodes, NodeTable(x, d, "id")]
        else:
            fit = d.select(*[(F.col("id") if c == old.id else F.col(c) if c in cols else F.lit(None)).cast(t).alias(c) for c, t in old.df.dtypes])
            g.nodes = [replace(t, df=t.df.unionByName(fit)) if t is old else t for t in g.nodes]
    start, end = F.split_part("src", F.lit(":"), F.lit(1)), F.split_part("dst", F.lit(":"), F.lit(1))
    for t, a, b in r.select("_type", start, end).distinct().collect():  # kinds of relationship
        own = r.filter((F.col("_type") == t) & (start == a) & (end == b))
        cols = [c for c in prop(own, "_props") if c not in ("src", "dst")]
        g.rels = [*g.rels, RelTable(t, label.get(a, a), label.get(b, b), own.select(plain("src").alias("src"), plain("dst").alias("dst"), "id", *[F.col("_props")[c].alias(c) for c in cols if c != "id"]), "src", "dst", ("id",), hidden=("id",))]
    return g


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """``element_id, embedding, dimensions`` of a line-wise embedding dump: nodeId, elementId, legacyId, embedding, dimensions."""
    d = spark.read.schema("nodeId string, elementId string, legacyId bigint, embedding array<float>, dimensions int").json(path)
    return d.select(F.coalesce("elementId", "nodeId").alias("element_id"), F.col("legacyId").alias("legacy_id"), "embedding", F.coalesce("dimensions", F.size("embedding")).alias("dimensions"))


def read_graph(spark: SparkSession, path: str) -> Graph:
    n = spark.read.schema(NODE).json(f"{path}/nodes").withColumnRenamed("properties", "props")
    r = spark.read.schema(REL).json(f"{path}/relationships")
    return generic_graph(n, r.select("id", F.col("startNode").alias("src"), F.col("endNode").alias("dst"), "type", F.col("properties").alias("props")))


def read_document(spark: SparkSession, path: str) -> Graph:
    """One JSON document with ``nodes`` and ``relationships`` arrays."""
    schema = "nodes array<struct<id:string,labels:array<string>,properties:map<string,string>>>, relationships array<struct<id:string,type:string,startNode:string,endNode:string,properties:map<string,string>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    n = d.select(F.explode("nodes").alias("n")).select("n.id", "n.labels", F.col("n.properties").alias("props"))
    r = d.select(F.explode("relationships").alias("r")).select("r.id", F.col("r.startNode").alias("src"), F.col("r.endNode").alias("dst"), "r.type", F.col("r.properties").alias("props"))
    return generic_graph(n, r)


def read_dump(spark: SparkSession, nodes: str, rels: str) -> Graph:
    """Line-wise dumps: elementId, labels, properties; elementId, type, source, target, properties."""
    n = spark.read.schema("elementId string, labels array<string>, properties map<string,string>").json(nodes)
    r = spark.read.schema("elementId string, type string, source string, target string, properties map<string,string>").json(rels)
    return generic_graph(n.select(F.col("elementId").alias("id"), "labels", F.col("properties").alias("props")), r.select(F.col("elementId").alias("id"), F.col("source").alias("src"), F.col("target").alias("dst"), "type", F.col("properties").alias("props")))


def union_graph(parts: list[Graph], name: str = "composite") -> Graph:
    """The constituents side by side as one graph; typed labels of the same name are united by column name."""
    if all(g.generic for g in parts):
        n = parts[0].nodes[0].df
        r = parts[0].rels[0].df
        for g in parts[1:]:
            n, r = n.unionByName(g.nodes[0].df, allowMissingColumns=True), r.unionByName(g.rels[0].df, allowMissingColumns=True)
        return generic_graph(n, r, name)
    return Graph([n for g in parts for n in g.nodes], [r for g in parts for r in g.rels], name)
