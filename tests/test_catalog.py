"""Catalog commands, further procedures and changes of shape."""

import pytest

from loomgraph.cypher.admin import Catalog, command
from loomgraph.cypher.lower import run
from loomgraph.cypher.parser import QueryError
from loomgraph.graph import Graph, NodeTable, RelTable, generic_graph
from loomgraph.operators import refactor


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def small(spark):
    n = spark.createDataFrame([("a", ["P"], {"name": "Ann", "ok": "yes"}), ("b", ["P", "Q"], {"name": "Bob"}), ("c", ["R"], {"name": "Cy"}), ("d", [], {})], "id string, labels array<string>, props map<string,string>")
    r = spark.createDataFrame([("1", "a", "b", "K", {}), ("2", "b", "c", "K", {}), ("3", "a", "b", "K", {}), ("4", "c", "a", "L", {})], "id string, src string, dst string, type string, props map<string,string>")
    return generic_graph(n, r)


def test_commands(spark):
    docs = spark.createDataFrame([(1, "graph index"), (2, "cache"), (3, None)], "id bigint, text string")
    c = Catalog({"main": Graph([NodeTable("Doc", docs, "id")], [])}, current="main")
    assert command(c, spark, "CREATE FULLTEXT INDEX t IF NOT EXISTS FOR (n:Doc) ON EACH [n.text]").first().name == "t"
    assert rows(run(c.graph(), spark, "CALL db.index.fulltext.queryNodes('t', 'graph') YIELD node RETURN node")) == [(1,)]
    command(c, spark, "CREATE VECTOR INDEX v FOR (n:Doc) ON (n.e) OPTIONS {indexConfig: {`vector.dimensions`: 3, `vector.similarity_function`: 'cosine'}}")
    assert c.graph().indexes["v"]["dims"] == 3
    assert {r.name for r in command(c, spark, "SHOW INDEXES").collect()} == {"t", "v"}
    command(c, spark, "CREATE CONSTRAINT u FOR (n:Doc) REQUIRE n.id IS UNIQUE")
    with pytest.raises(QueryError):
        command(c, spark, "CREATE CONSTRAINT FOR (n:Doc) REQUIRE n.text IS NOT NULL")
    command(c, spark, "DROP INDEX v")
    with pytest.raises(QueryError):
        command(c, spark, "DROP INDEX v")
    command(c, spark, "CREATE DATABASE other")
    command(c, spark, "CREATE ALIAS o FOR DATABASE other")
    command(c, spark, "CREATE COMPOSITE DATABASE both OF other, other")
    assert rows(command(c, spark, "SHOW CONSTITUENTS FOR both")) == [("other",), ("other",)]
    command(c, spark, "USE o")
    assert run(c.graph(), spark, "MATCH (n) RETURN count(n) AS n").first().n == 0
    for t in ("SHOW DATABASES", "SHOW ALIASES", "SHOW CONSTRAINTS", "SHOW PROCEDURES", "SHOW FUNCTIONS", "SHOW COMPOSITE DATABASES"):
        command(c, spark, t).collect()
    with pytest.raises(QueryError):
        command(c, spark, "MAKE SENSE")


def test_procedures(spark, small):
    call = lambda t: rows(run(small, spark, t))
    assert call("CALL apoc.search.prefix('P', 'name', 'A') YIELD node RETURN node") == [("a",)]
    assert call("CALL apoc.search.multiSearchAny('P', {name: 'Bob', ok: 'yes'}) YIELD node RETURN node") == [("a",), ("b",)]
    assert call("CALL apoc.node.neighborsOut('a') YIELD node RETURN node") == [("b",)]
    assert call("CALL apoc.node.degree('a') YIELD degree RETURN degree") == [(3,)]
    assert call("CALL apoc.nodes.connected('a', 'c') YIELD connected RETURN connected") == [(True,)]
    assert call("CALL apoc.paths.distance('a', 'c', 'K>') YIELD distance RETURN distance") == [(2,)]
    assert call("CALL apoc.nodes.cycles('a') YIELD path RETURN path") == [(["a", "b", "c", "a"],)]
    assert call("CALL apoc.label.stats() YIELD label, count RETURN label, count") == [("P", 2), ("Q", 1), ("R", 1)]
    assert call("CALL apoc.cypher.run('MATCH (n:P) RETURN n.name AS x') YIELD value RETURN value.x") == [("Ann",), ("Bob",)]
    assert call("CALL db.relationshipTypes() YIELD relationshipType AS t WHERE t <> 'L' RETURN t") == [("K",)]
    assert call("CALL apoc.algo.wcc() YIELD componentId RETURN count(DISTINCT componentId) AS n") == [(1,)]


def test_shape(spark, small):
    count = lambda g, t: run(g, spark, t).first()[0]
    g = refactor.rename_type(refactor.rename_label(small, "P", "X"), "K", "M")
    assert count(g, "MATCH (:X)-[r:M]->() RETURN count(r)") == 3
    assert count(refactor.merge_parallel(small), "MATCH ()-[r:K]->() RETURN count(r)") == 2
    assert rows(run(refactor.invert(small, "L"), spark, "MATCH (x)-[:L]->(y) RETURN x.name, y.name")) == [("Ann", "Cy")]
    g = refactor.merge_nodes(small, spark.createDataFrame([("b", "a")], "id string, into string"))
    assert rows(run(g, spark, "MATCH (n:Q)-[:K]->(m) RETURN n.name, m.name")) == [("Ann", "Ann"), ("Ann", "Ann"), ("Ann", "Cy")]
    g = refactor.collapse_node(small, "Q", "VIA")
    assert rows(run(g, spark, "MATCH (x)-[:VIA]->(y) RETURN x.name, y.name")) == [("Ann", "Cy"), ("Ann", "Cy")]
    g = refactor.extract_node(small, "L", "Link", "FROM", "TO")
    assert rows(run(g, spark, "MATCH (x)-[:FROM]->(:Link)-[:TO]->(y) RETURN x.name, y.name")) == [("Cy", "Ann")]
    g = refactor.categorize(small, "ok", "HAS", "Ok")
    assert rows(run(g, spark, "MATCH (x)-[:HAS]->(o:Ok) RETURN x.name, o.name, x.ok")) == [("Ann", "yes", None)]
    assert rows(run(refactor.normalize_boolean(small, "ok", ["yes"], ["no"]), spark, "MATCH (n {name: 'Ann'}) RETURN n.ok")) == [("true",)]
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert count(refactor.clone_subgraph(small, ids), "MATCH ()-[r:K]->() RETURN count(r)") == 5
    assert rows(refactor.difference(small, refactor.subgraph(small, ids))) == [("c", "left only"), ("d", "left only")]


def test_typed_invert(spark):
    a, b = spark.createDataFrame([(1,)], "ak int"), spark.createDataFrame([(9, 1)], "bk int, a int")
    g = Graph([NodeTable("A", a, "ak"), NodeTable("B", b, "bk")], [RelTable("T", "A", "B", b, "a", "bk", ("bk",), "dst")])
    assert rows(run(refactor.invert(g, "T"), spark, "MATCH (b:B)-[:T]->(a:A) RETURN b.bk, a.ak")) == [(9, 1)]


def test_shortest_path_procedures(spark):
    """A diamond with a longer way round, then a chain: two shortest paths of two hops, and one end nine hops off."""
    es = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "x"), ("x", "y"), ("y", "d"), *((f"{i}", f"{i + 1}") for i in range(9)), ("d", "0")]
    n = spark.createDataFrame([(i, ["P"], {}) for i in sorted({x for e in es for x in e})], "id string, labels array<string>, props map<string,string>")
    g = generic_graph(n, spark.createDataFrame([(str(i), a, b, "K", {}) for i, (a, b) in enumerate(es)], "id string, src string, dst string, type string, props map<string,string>"))
    call = lambda f, x: rows(run(g, spark, f"CALL apoc.path.{f}({x}) YIELD path RETURN path"))
    two = [(["a", "b", "d"],), (["a", "c", "d"],)]
    assert call("allShortestPaths", "'a', 'd', 'K>'") == call("allShortestPaths", "'a', 'd', 'K>', 2") == two
    assert call("shortestPath", "'a', 'd', 'K>', 10") == two[:1]
    assert call("allShortestPaths", "'a', 'd', 'K>', 1") == call("allShortestPaths", "'d', 'a', 'K>'") == []
    assert call("shortestPath", "'0', '9', 'K>', 10") == [([str(i) for i in range(10)],)]
    assert call("allShortestPaths", "'0', '9', 'K>', 8") == [] and call("shortestPath", "'a', 'a', 'K>', 3") == [(["a"],)]
