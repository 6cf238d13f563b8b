"""Parsing, lowering and updating, on small hand-made graphs."""

import pytest

from loomgraph.cypher.lower import run
from loomgraph.cypher.parser import QueryError, parse
from loomgraph.cypher.write import check_exists, check_unique, execute
from loomgraph.graph import Graph, NodeTable, RelTable, generic_graph


@pytest.fixture(scope="module")
def people(spark):
    n = spark.createDataFrame([(1, "Alice", 30), (2, "Bob", 25), (3, "Charlie", 35), (4, "Dave", None)], "id bigint, name string, age bigint")
    k = spark.createDataFrame([(1, 2, 2020), (2, 3, 2018), (1, 4, 2021), (4, 3, 2022)], "src bigint, dst bigint, since bigint")
    return Graph([NodeTable("Person", n, "id")], [RelTable("KNOWS", "Person", "Person", k, "src", "dst")])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_hops_and_paths(spark, people):
    assert rows(run(people, spark, "MATCH (a:Person {name: 'Alice'})-[r:KNOWS]->(b) RETURN b.name, r.since")) == [("Bob", 2020), ("Dave", 2021)]
    assert rows(run(people, spark, "MATCH (a {name: 'Alice'})-[:KNOWS*2]->(b) RETURN b.name")) == [("Charlie",), ("Charlie",)]
    assert rows(run(people, spark, "MATCH (a {name: 'Alice'})-[:KNOWS*0..1]->(b) RETURN b.name")) == [("Alice",), ("Bob",), ("Dave",)]
    assert rows(run(people, spark, "MATCH (a:Person)<-[:KNOWS]-(b:Person) WHERE a.age IS NULL RETURN b.name")) == [("Alice",)]
    # A relationship is used once in a pattern: no way back over the same one.
    assert rows(run(people, spark, "MATCH (a {name: 'Bob'})-[:KNOWS]-(b)-[:KNOWS]-(c) RETURN c.name")) == [("Dave",), ("Dave",)]


def test_shortest_paths(spark, people):
    t = "MATCH (a:Person {name: 'Alice'}), (c:Person {name: 'Charlie'}) MATCH p = %s((a)-[:KNOWS*..5]->(c)) RETURN length(p) AS n"
    assert rows(run(people, spark, t % "shortestPath")) == [(2,)]
    assert rows(run(people, spark, t % "allShortestPaths")) == [(2,), (2,)]
    assert rows(run(people, spark, "MATCH (a:Person {name: 'Charlie'}), (c:Person {name: 'Alice'}) MATCH p = shortestPath((a)-[:KNOWS*..5]->(c)) RETURN length(p)")) == []


def test_shortest_paths_that_are_only_measured(spark):
    """Lengths and counts agree with the paths themselves, without pairs of all nodes being made: cycles, parallel edges, a hub, a node that isn't there."""
    n = spark.createDataFrame([(str(i), ["T"] if i % 2 else ["T", "U"]) for i in range(12)], "id string, labels array<string>").selectExpr("*", "map('i', id) AS props")
    pairs = [(i, (i * 5 + 1) % 12) for i in range(12)] + [(0, j) for j in range(1, 6)] + [(0, 1), (3, 9), (3, 9), (9, 4), (7, 99), (99, 2), (2, 2)]
    r = spark.createDataFrame([(str(k), str(a), str(b), "K") for k, (a, b) in enumerate(pairs)], "id string, src string, dst string, type string").selectExpr("*", "map('k', id) AS props")
    g = generic_graph(n, r, "g")
    t = "MATCH (a:T), (b:U) WHERE a <> b AND a.i <> '5' MATCH p = %s((a)-[:K*%s]->(b)) RETURN elementId(a) AS a, elementId(b) AS b, %s"
    for kind, hops in (("shortestPath", "1.."), ("allShortestPaths", "1.."), ("allShortestPaths", "..2")):
        want = rows(run(g, spark, t % (kind, hops, "size(nodes(p)) - 1 AS len, count(*) AS n")))
        found = run(g, spark, t % (kind, hops, "length(p) AS len, count(p) AS n"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert rows(found) == want and len(want) > 12 and "Cartesian" not in plan and "NestedLoop" not in plan
    assert max(r[3] for r in rows(run(g, spark, t % ("allShortestPaths", "1..", "length(p) AS len, count(*) AS n")))) > 1


def test_bounded_shortest_paths_make_no_pairs(spark):
    """A ring of nine: from each node the three after it, of which the ids in order count; conditions on pairs come after the paths."""
    n = spark.createDataFrame([(str(i), ["T"]) for i in range(9)], "id string, labels array<string>").selectExpr("*", "map('i', id) AS props")
    r = spark.createDataFrame([(str(i), str(i), str((i + 1) % 9), "K") for i in range(9)], "id string, src string, dst string, type string").selectExpr("*", "map('k', id) AS props")
    found = run(generic_graph(n, r, "g"), spark, "MATCH (a:T), (b:T) WHERE elementId(a) < elementId(b) MATCH p = shortestPath((a)-[:K*..3]->(b)) RETURN length(p) AS len, count(*) AS n")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == [(1, 8), (2, 7), (3, 6)] and "Cartesian" not in plan and "NestedLoop" not in plan


def test_ordering_of_nulls_and_paging(spark, people):
    assert [r[0] for r in run(people, spark, "MATCH (n:Person) RETURN n.name ORDER BY n.age").collect()] == ["Bob", "Alice", "Charlie", "Dave"]
    assert [r[0] for r in run(people, spark, "MATCH (n:Person) RETURN n.name AS x ORDER BY n.age DESC SKIP 1 LIMIT 2").collect()] == ["Charlie", "Alice"]


def test_parameters_and_functions(spark, people):
    assert rows(run(people, spark, "MATCH (n:Person) WHERE n.age > $a RETURN n.name", {"a": 28})) == [("Alice",), ("Charlie",)]
    assert rows(run(people, spark, "RETURN size('abc') AS a, size([1, 2]) AS b, range(1, 5, 2) AS c, toUpper('x') + 'y' AS d")) == [(3, 2, [1, 3, 5], "Xy")]
    assert rows(run(people, spark, "MATCH (n:Person) RETURN count(n.age) AS a, count(*) AS b, collect(n.age) AS c"))[0][:2] == (3, 4)


@pytest.mark.parametrize("text", ["MATCH (n RETURN n", "RETURN $x", "MATCH (n:Person) RETURN nope(n.name)", "MATCH (n:None) RETURN n", "RETURN 1 AS a UNION RETURN 1 AS a, 2 AS b", "FOO BAR"])
def test_errors(spark, people, text):
    with pytest.raises(QueryError):
        run(people, spark, text).collect()


def test_precedence():
    e = parse("RETURN 1 + 2 * 3 = 7 AND NOT false OR true")["parts"][0][0].data["items"].items[0][0]
    assert e[:2] == ("bin", "or") and e[2][:2] == ("bin", "and") and e[2][2][:2] == ("bin", "=")


def test_single_join_for_owned_keys(spark):
    """A foreign key relationship costs one join and no scan of the key table twice."""
    c = spark.createDataFrame([(1, "a")], "ck bigint, name string")
    o = spark.createDataFrame([(10, 1), (11, None)], "ok bigint, cust bigint")
    g = Graph([NodeTable("C", c, "ck"), NodeTable("O", o, "ok")], [RelTable("P", "C", "O", o, "cust", "ok", ("ok",), "dst")])
    df = run(g, spark, "MATCH (c:C)-[:P]->(o:O) RETURN c.name AS n, o.ok AS k")
    assert rows(df) == [("a", 10)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def empty(spark):
    return generic_graph(spark.createDataFrame([], "id string, labels array<string>, props map<string,string>"), spark.createDataFrame([], "id string, src string, dst string, type string, props map<string,string>"))


def test_updates_make_new_versions(spark):
    g0 = empty(spark)
    w = execute(g0, spark, "CREATE (a:P {name: 'A', age: 1})-[:K {since: 2}]->(b:P {name: 'B'})")
    assert (w.stats["nodes_created"], w.stats["relationships_created"]) == (2, 1)
    g1 = w.graph
    assert run(g0, spark, "MATCH (n) RETURN count(n) AS n").first()[0] == 0
    g2 = execute(g1, spark, "MERGE (a:P {name: 'A'}) ON MATCH SET a.age = 5 ON CREATE SET a.age = 9").graph
    assert rows(run(g2, spark, "MATCH (n:P) RETURN n.name, n.age")) == [("A", "5"), ("B", None)]
    g3 = execute(g2, spark, "UNWIND ['A', 'C', 'C'] AS x MERGE (a:P {name: x})").graph
    assert run(g3, spark, "MATCH (n:P) RETURN count(n) AS n").first()[0] == 3
    g4 = execute(g3, spark, "MATCH (n:P {name: 'A'}) SET n:Q, n.age = 7 REMOVE n.name").graph
    assert rows(run(g4, spark, "MATCH (n:Q) RETURN n.age, n.name")) == [("7", None)]
    with pytest.raises(QueryError):
        execute(g1, spark, "MATCH (n:P {name: 'A'}) DELETE n")
    g5 = execute(g1, spark, "MATCH (n:P {name: 'A'}) DETACH DELETE n").graph
    assert run(g5, spark, "MATCH (n) RETURN count(n) AS n").first()[0] == 1
    assert run(g5, spark, "MATCH ()-[r]->() RETURN count(r) AS n").first()[0] == 0
    g6 = execute(g1, spark, "MATCH (:P)-[r:K]->(:P) DELETE r").graph
    assert run(g6, spark, "MATCH ()-[r]->() RETURN count(r) AS n").first()[0] == 0


def test_typed_updates_and_constraints(spark, people):
    w = execute(people, spark, "MATCH (n:Person {name: 'Bob'}) SET n.age = 26, n.city = 'X' RETURN n.age AS age")
    assert rows(run(w.graph, spark, "MATCH (n:Person) WHERE n.city = 'X' RETURN n.name, n.age")) == [("Bob", 26)]
    w = execute(w.graph, spark, "MATCH (a:Person {name: 'Bob'}), (b:Person {name: 'Dave'}) CREATE (a)-[:LIKES]->(b)")
    assert rows(run(w.graph, spark, "MATCH (a)-[:LIKES]->(b) RETURN a.name, b.name")) == [("Bob", "Dave")]
    assert check_unique(people, "Person", "name").count() == 0
    assert rows(check_exists(people, "Person", "age")) == [(4,)]


def test_foreach_and_procedures(spark, people):
    g = execute(empty(spark), spark, "FOREACH (x IN [1, 2, 3] | CREATE (:Num {v: x}))").graph
    assert run(g, spark, "MATCH (n:Num) RETURN sum(n.v) AS s").first()[0] == 6
    assert rows(run(people, spark, "CALL apoc.path.subgraphNodes('1', {maxLevel: 1, relationshipFilter: 'KNOWS>'}) YIELD node RETURN node")) == [(1,), (2,), (4,)]
    assert rows(run(people, spark, "CALL apoc.algo.dijkstra('1', '3', 'KNOWS', 'since') YIELD weight RETURN weight")) == [(4038.0,)]
    assert run(people, spark, "EXPLAIN MATCH (n:Person) RETURN n.name").count() > 3


def test_empty_tables(spark):
    g = empty(spark)
    for t in ("MATCH (n) RETURN n", "MATCH (a)-[r]->(b) RETURN a, b", "MATCH (a)-[:X*1..2]->(b) RETURN a.name", "MATCH (a) OPTIONAL MATCH (a)-[:K]->(b) RETURN b.name"):
        assert run(g, spark, t).collect() == []


def test_inline_conditions_on_other_variables(spark, people):
    assert rows(run(people, spark, "UNWIND ['Bob', 'Dave'] AS x MATCH (n:Person {name: x}) RETURN x, n.age")) == [("Bob", 25), ("Dave", None)]
    assert rows(run(people, spark, "MATCH (a:Person {name: 'Bob'}) MATCH (b:Person {age: a.age + 5}) RETURN b.name")) == [("Alice",)]
    assert rows(run(people, spark, "UNWIND ['Bob'] AS x MATCH (a:Person)-[:KNOWS]->(b:Person {name: x}) RETURN a.name")) == [("Alice",)]
