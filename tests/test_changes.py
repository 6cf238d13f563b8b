"""Procedures that change, export and import graphs, and paths and ids on small graphs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomgraph.cypher.lower import run
from loomgraph.cypher.parser import QueryError
from loomgraph.graph import Graph, NodeTable, RelTable, generic_graph
from loomgraph.operators import algorithms as alg
from loomgraph.operators import search, timeline
from loomgraph.plans import change_library, procedures  # noqa: F401


def chain(spark, n, extra=()):
    """n nodes in a row; ``extra`` relationships (from, to, type)."""
    nodes = spark.createDataFrame([(f"n{i}", ["Even" if i % 2 == 0 else "Odd"], {"i": str(i)}) for i in range(n)], "id string, labels array<string>, props map<string,string>")
    rels = [(f"r{i}", f"n{i}", f"n{i + 1}", "NEXT", {}) for i in range(n - 1)] + [(f"x{k}", f"n{a}", f"n{b}", t, {}) for k, (a, b, t) in enumerate(extra)]
    return generic_graph(nodes, spark.createDataFrame(rels, "id string, src string, dst string, type string, props map<string,string>"))


def test_paths_without_an_upper_end(spark):
    g = chain(spark, 16)
    ask = lambda q: [tuple(r) for r in run(g, spark, q).collect()]
    assert ask("MATCH (a {i: '0'})-[:NEXT*1..]->(b) RETURN count(*) AS n") == [(15,)]
    assert ask("MATCH (a {i: '0'})-[:NEXT*12..]->(b) RETURN b.i AS i") == [("12",), ("13",), ("14",), ("15",)]
    assert ask("MATCH (a {i: '0'})-[:NEXT*]->(b) RETURN count(*) AS n") == [(10,)]
    assert ask("MATCH (a {i: '0'})-[:NEXT*20..]->(b) RETURN count(*) AS n") == [(0,)]
    assert ask("MATCH (a {i: '0'}), (b {i: '15'}) MATCH p = shortestPath((a)-[:NEXT*1..]->(b)) RETURN length(p) AS n") == [(15,)]
    assert ask("MATCH (a {i: '3'}), (b {i: '0'}) MATCH p = shortestPath((a)-[:NEXT*1..]->(b)) RETURN length(p) AS n") == []


def test_endless_paths_are_an_error(spark, monkeypatch):
    import loomgraph.cypher.lower as lower

    monkeypatch.setattr(lower, "OPEN_END_HOPS", 6)
    with pytest.raises(QueryError):
        run(chain(spark, 12), spark, "MATCH (a)-[:NEXT*1..]->(b) RETURN count(*) AS n")


def test_ids_of_several_labels(spark):
    """A nation and a region of one number are different nodes."""
    n = lambda rows, name: NodeTable(name, spark.createDataFrame(rows, f"k int, {name.lower()}_name string"), "k")
    r = spark.createDataFrame([(i, i % 2) for i in range(6)], "a int, b int")
    g = Graph([n([(i, f"n{i}") for i in range(6)], "Nation"), n([(i, f"r{i}") for i in range(2)], "Region")], [RelTable("IN", "Nation", "Region", r, "a", "b", ("a",))])
    got = run(g, spark, "MATCH (r:Region) CALL apoc.path.subgraphNodes(r, {relationshipFilter: '<IN', minLevel: 1}) YIELD node RETURN r.region_name AS r, node").collect()
    assert sorted((x.r, x.node) for x in got) == [(f"r{i % 2}", f"Nation:{i}") for i in sorted(range(6), key=lambda i: (i % 2, i))]
    assert run(g, spark, "CALL apoc.neighbors.toHop('Region:1', '<IN', 1) YIELD node RETURN count(node) AS n").first().n == 3
    deg = run(g, spark, "MATCH (n) RETURN labels(n)[0] AS l, sum(degree(n)) AS d").collect()
    assert {x.l: x.d for x in deg} == {"Nation": 6, "Region": 6}
    assert run(g, spark, "MATCH (a:Nation), (b:Region) WHERE a = b RETURN count(*) AS n").first().n == 0


def test_scripts(spark):
    assert procedures.statements("RETURN 'a;b' AS x; // c;d\nRETURN 1;; /* ; */ RETURN \"q;\" AS y") == ["RETURN 'a;b' AS x", "// c;d\nRETURN 1", "/* ; */ RETURN \"q;\" AS y"]
    g = chain(spark, 3)
    run(g, spark, "CALL apoc.cypher.doIt('CREATE (:New {i: 7})')").collect()
    got = run(g, spark, "CALL apoc.cypher.runMany('CREATE (:New {i: 8}); MATCH (n:New) RETURN count(n) AS n') YIELD row, result RETURN row, result").collect()
    assert [(r.row, r.result) for r in got][-1] == (1, '{"n":2}')


def test_export_and_import(spark, tmp_path):
    g = chain(spark, 5)
    out = run(g, spark, f"CALL apoc.export.csv.all('{tmp_path}/c') YIELD nodes, relationships RETURN nodes, relationships").first()
    assert tuple(out) == (5, 4)
    rows = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/c/nodes").collect()
    assert sorted((r.id, r.labels, r.properties) for r in rows)[0] == ("n0", "Even", '{"i":"0"}')
    run(g, spark, f"CALL apoc.export.json.all('{tmp_path}/j')").collect()
    h = chain(spark, 1)
    h.nodes[0] = h.nodes[0].__class__(None, h.nodes[0].df.filter("false"), "id")
    said = run(h, spark, f"CALL apoc.import.json('{tmp_path}/j') YIELD nodes, relationships RETURN nodes, relationships").first()
    assert tuple(said) == (5, 4) and run(h, spark, "MATCH (a)-[:NEXT]->(b) RETURN count(*) AS n").first().n == 4


def test_changes(spark):
    g = chain(spark, 4)
    call = lambda q: run(g, spark, q).collect()
    value = lambda name: run(g, spark, f"MATCH (n {{i: '1'}}) RETURN n.{name} AS v").first().v
    call("CALL apoc.create.setProperty('n1', 'w', 4)")
    assert value("w") == "4"
    for text, want in (("add('n1', 'w', 2)", "6"), ("subtract('n1', 'w', 0.5)", "5.5"), ("concat('n1', 'w', 'x')", "5.5x"), ("compareAndSwap('n1', 'w', '5.5x', 'y')", "y"), ("compareAndSwap('n1', 'w', 'no', 'z')", "y"), ("update('n1', 'w', 1)", "1"), ("increment('n1', 'w')", "2"), ("update('n1', 'l', '[\"a\", \"c\"]')", "2")):
        call(f"CALL apoc.atomic.{text}")
        assert value("w") == want, text
    call("CALL apoc.atomic.insert('n1', 'l', 1, 'b')")
    assert value("l") == '["a","b","c"]'
    call("CALL apoc.atomic.remove('n1', 'l', 0)")
    assert value("l") == '["b","c"]'
    call("CALL apoc.create.removeProperties('n1', ['l', 'w'])")
    assert value("l") is None
    call("CALL apoc.create.addLabels(['n1', 'n2'], ['Mid'])")
    call("CALL apoc.create.removeLabels('n2', 'Even')")
    assert sorted(r.n for r in run(g, spark, "MATCH (n:Mid) RETURN size(labels(n)) AS n").collect()) == [1, 2]
    call("CALL apoc.create.relationship('n3', 'BACK', {w: 1}, 'n0')")
    call("CALL apoc.merge.relationship('n3', 'BACK', {w: 1}, {}, 'n0', {seen: 'yes'})")
    assert run(g, spark, "MATCH (a)-[r:BACK]->(b) RETURN r.w AS w, r.seen AS s, a.i AS a").collect()[0][:] == ("1", "yes", "3")
    call("CALL apoc.merge.nodes(['n0', 'n1'])")
    assert run(g, spark, "MATCH (n) RETURN count(n) AS n").first().n == 3
    call("CALL apoc.nodes.delete(['n3'])")
    assert run(g, spark, "MATCH ()-[r]->() RETURN count(r) AS n").first().n == 2  # n0 to itself and on to n2
    call("CALL apoc.nodes.link(['n2', 'n0'], 'CHAIN')")
    call("CALL apoc.refactor.cloneNodes(['n2'], '-copy')")
    assert run(g, spark, "MATCH (n) RETURN count(n) AS n").first().n == 3


def test_projection(spark):
    g = chain(spark, 6, [(0, 2, "SKIP"), (1, 3, "SKIP")])
    said = run(g, spark, "CALL gds.graph.project('even', 'Even', ['SKIP']) YIELD nodeCount, relationshipCount RETURN nodeCount, relationshipCount").first()
    assert tuple(said) == (3, 1)


def test_strong_components_and_cores(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7), (1, 2), (None, 3)], "src bigint, dst bigint")
    assert {r.id: r.component for r in alg.scc(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    assert {r.id: r.core for r in alg.core_numbers(e).collect()} == {1: 2, 2: 2, 3: 2, 4: 1, 5: 1, 6: 1, 7: 0}
    assert alg.scc(e.limit(0)).collect() == [] and alg.core_numbers(e.limit(0)).collect() == []


def test_cooldown(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", at(s)) for s in (0, 200, 400, 650, 700, 2000, 2299, 2300)] + [("b", at(5)), ("b", None)]
    got = timeline.cooled(spark.createDataFrame(rows, "k string, ts timestamp"), ["k"], "ts", 300)
    assert sorted((r.k, r.ts) for r in got.collect()) == [("a", at(s)) for s in (0, 400, 700, 2000, 2300)] + [("b", at(5))]
    assert timeline.cooled(spark.createDataFrame([], "k string, ts timestamp"), ["k"], "ts", 300).collect() == []


def test_keyword_scores(spark):
    """Statistics are over all texts although only those with a query term are kept."""
    docs = spark.createDataFrame([(1, "we index the graph graph"), (2, "nothing here"), (3, None), (4, "graphs of your index")], "id bigint, t string")
    got = {r.id: r.score for r in search.bm25(docs, "id", "t", "graph your", prefix=True).collect()}
    assert set(got) == {1, 4} and got[1] > got[4] > 0  # "your" and "we" carry no meaning
    assert search.bm25(docs, "id", "t", "of the").collect() == [] and search.bm25(docs.limit(0), "id", "t", "graph").collect() == []
    assert docs.select(F.size(search.tokens(F.col("t"))).alias("n")).filter("n > 0").count() == 3


def test_transactions(spark):
    from loomgraph.cypher.transactions import Transactions

    t = Transactions(chain(spark, 3), spark)
    count = lambda: t.execute("MATCH (n) RETURN count(n) AS n").first().n
    t.execute("CREATE (:New {i: '9'})")
    assert count() == 4
    t.execute("BEGIN")
    t.execute("CREATE (:New {i: '10'})")
    t.execute("CALL apoc.nodes.delete(['n0'])").collect()
    assert count() == 4 and t.execute("MATCH (n:New) RETURN count(n) AS n").first().n == 2
    t.execute("ROLLBACK")
    assert count() == 4 and t.execute("MATCH (n:New) RETURN count(n) AS n").first().n == 1
    t.execute("begin transaction;")
    t.execute("MATCH (n:New) DETACH DELETE n")
    t.execute("COMMIT")
    assert count() == 3
    t.execute("BEGIN")
    t.execute("CREATE (:New)")
    with pytest.raises(Exception):  # noqa: B017
        t.execute("MATCH (n RETURN n")
    assert count() == 3 and t.saved is None
    for text in ("COMMIT", "ROLLBACK"):
        with pytest.raises(QueryError):
            t.execute(text)


def test_periodic_and_vectors(spark):
    g = chain(spark, 5)
    assert tuple(run(g, spark, "CALL apoc.periodic.iterate('MATCH (n:Odd) RETURN n', 'SET n.k = 1', {}) YIELD batches, total RETURN batches, total").first()) == (1, 2)
    assert run(g, spark, "MATCH (n) WHERE n.k = '1' RETURN count(n) AS n").first().n == 2
    run(g, spark, "CALL db.create.setNodeVectorProperty('n0', 'v', [1, 0.5])").collect()
    assert run(g, spark, "MATCH (n {i: '0'}) RETURN n.v AS v").first().v == "[1.0, 0.5]"
    said = run(g, spark, "CALL apoc.periodic.commit('MATCH (n:Odd) WHERE n.k = \\'1\\' SET n.k = \\'2\\' RETURN count(n) AS n') YIELD updates, executions RETURN updates, executions").first()
    assert tuple(said) == (2, 2)
