"""The test tables as graphs."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.graph import Graph, NodeTable, RelTable, generic_graph
from loomgraph.session import table


_OPEN: dict[tuple[str, str, str], Graph] = {}


def opened(f):
    """A graph's tables are looked up once a session and folder; what is kept are plans, not rows."""

    @wraps(f)
    def g(spark: SparkSession, d: str) -> Graph:
        key = (spark.sparkContext.applicationId, d, f.__name__)
        if key not in _OPEN:
            _OPEN[key] = f(spark, d)
        return _OPEN[key]

    return g


@opened
def trade_graph(spark: SparkSession, d: str) -> Graph:
    """Customers, orders, parts, suppliers, nations, regions, typed; foreign keys are relationships of their owner's table."""
    t = {n: table(spark, d, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    nodes = [
        NodeTable("Region", t["region"], "r_regionkey"),
        NodeTable("Nation", t["nation"], "n_nationkey"),
        NodeTable("Customer", t["customer"], "c_custkey"),
        NodeTable("Supplier", t["supplier"], "s_suppkey"),
        NodeTable("Part", t["part"], "p_partkey"),
        NodeTable("Order", t["orders"], "o_orderkey"),
    ]
    items = t["lineitem"]
    line = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    supplies = items.select("l_suppkey", "l_partkey").distinct()
    rels = [
        RelTable("PLACED", "Customer", "Order", t["orders"], "o_custkey", "o_orderkey", ("o_orderkey",), "dst"),
        RelTable("IN", "Nation", "Region", t["nation"], "n_nationkey", "n_regionkey", ("n_nationkey",), "src"),
        RelTable("LIVES_IN", "Customer", "Nation", t["customer"], "c_custkey", "c_nationkey", ("c_custkey",), "src"),
        RelTable("BASED_IN", "Supplier", "Nation", t["supplier"], "s_suppkey", "s_nationkey", ("s_suppkey",), "src"),
        RelTable("CONTAINS", "Order", "Part", items, "l_orderkey", "l_partkey", line),
        RelTable("SUPPLIES", "Supplier", "Part", supplies, "l_suppkey", "l_partkey", ("l_suppkey", "l_partkey")),
    ]
    return Graph(nodes, rels, "trade")


@opened
def memory_graph(spark: SparkSession, d: str) -> Graph:
    """The node and relationship dumps, generic; of elements exported twice the latest counts."""
    n = table(spark, d, "nodes")
    latest = Window.partitionBy("element_id").orderBy(F.desc("updated_at"), F.desc("access_count"))
    n = n.withColumn("_k", F.row_number().over(latest)).filter("_k = 1")
    props = F.coalesce(F.from_json("properties", "map<string,string>"), F.create_map().cast("map<string,string>"))
    n = n.select(F.col("element_id").alias("id"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), props.alias("props"), "decay_score", "access_count", "created_at", "last_accessed")
    r = table(spark, d, "relationships").dropDuplicates(["element_id"])
    r = r.select(F.col("element_id").alias("id"), F.col("source").alias("src"), F.col("target").alias("dst"), F.col("rel_type").alias("type"), props.alias("props"), "confidence", "auto_generated", "created_at")
    return generic_graph(n, r, "memory")


def frame(df: DataFrame, label: str, key: str) -> Graph:
    """A graph of one label without relationships."""
    return Graph([NodeTable(label, df, key)], [])
