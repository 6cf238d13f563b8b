"""Graph algorithms, search, timeline operators, sources and streams against plain Python or values by hand."""

import itertools
import json
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import temporal
from loomgraph.operators import algorithms as alg
from loomgraph.operators import linkprediction as lp
from loomgraph.operators import search, timeline
from loomgraph.operators.components import connected_components, forest
from loomgraph.sources import graph_files
from loomgraph.streaming import live


def edges(spark, es):
    return spark.createDataFrame(es, "src bigint, dst bigint")


TRIANGLES = [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (3, 4)]


@pytest.fixture(scope="module")
def web():
    r = random.Random(4)
    return sorted({(r.randrange(60), r.randrange(60)) for _ in range(160)})


def components_of(es):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in es:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components(spark):
    r = random.Random(1)
    es = [(i, i + 1) for i in range(0, 300)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(230)] + [(5000, i) for i in range(5001, 5400)] + [(7, 7), (9999, 9999)]
    df = spark.createDataFrame(es + [(None, 3)], "src bigint, dst bigint").repartition(6)
    assert {r.id: r.component for r in connected_components(df).collect()} == components_of(es)
    assert connected_components(edges(spark, [])).collect() == []


def test_forest():
    import numpy as np

    a, b = forest(np.array([5, 6, 9, 2]), np.array([6, 7, 2, 9]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {6: 5, 7: 5, 9: 2}


def test_pagerank(spark, web):
    nodes = {x for e in web for x in e}
    out = defaultdict(list)
    for a, b in web:
        out[a].append(b)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        loose = sum(v for k, v in rank.items() if not out[k])
        new = {k: 0.15 / len(nodes) + 0.85 * loose / len(nodes) for k in nodes}
        for a in out:
            for b in out[a]:
                new[b] += 0.85 * rank[a] / len(out[a])
        rank = new
    got = {r.id: r.score for r in alg.pagerank(edges(spark, web)).collect()}
    assert got == pytest.approx(rank)


def neighbours(es):
    n = defaultdict(set)
    for a, b in es:
        if a != b:
            n[a].add(b)
            n[b].add(a)
    return n


def test_triangles_core_closeness(spark, web):
    n = neighbours(web)
    tri = defaultdict(int)
    for x, y, z in itertools.combinations(sorted(n), 3):
        if y in n[x] and z in n[x] and z in n[y]:
            for v in (x, y, z):
                tri[v] += 1
    assert {r.id: r.triangles for r in alg.triangles(edges(spark, web)).collect()} == dict(tri)
    core = {k: set(v) for k, v in n.items()}
    while low := [k for k, v in core.items() if len(v) < 4]:
        for k in low:
            for m in core.pop(k):
                core.get(m, set()).discard(k)
    assert {r.id for r in alg.k_core(edges(spark, web), 4).collect()} == set(core)
    total = len({x for e in web for x in e})
    want = {}
    for s in {x for e in web for x in e}:
        dist, front = {s: 0}, [s]
        while front:
            front = [y for x in front for y in n[x] if y not in dist and not dist.update({y: dist[x] + 1})]
        d = sum(dist.values())
        want[s] = (len(dist) - 1) ** 2 / (d * (total - 1)) if d else 0.0
    assert {r.id: r.score for r in alg.closeness(edges(spark, web)).collect()} == pytest.approx(want)


def test_betweenness(spark, web):
    nodes = sorted({x for e in web for x in e})
    out = defaultdict(set)
    for a, b in web:
        if a != b:
            out[a].add(b)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, order, front = {s: 0}, defaultdict(float, {s: 1.0}), [s], [s]
        while front:
            nxt = []
            for x in front:
                for y in out[x]:
                    if y not in dist:
                        dist[y] = dist[x] + 1
                        nxt.append(y)
                    if dist[y] == dist[x] + 1:
                        sigma[y] += sigma[x]
            order += nxt
            front = nxt
        delta = defaultdict(float)
        for x in reversed(order):
            for y in out[x]:
                if dist.get(y) == dist[x] + 1:
                    delta[x] += sigma[x] / sigma[y] * (1 + delta[y])
            if x != s:
                score[x] += delta[x]
    n = len(nodes)
    want = {k: v * 2 / ((n - 1) * (n - 2)) for k, v in score.items()}
    assert {r.id: r.score for r in alg.betweenness(edges(spark, web)).collect()} == pytest.approx(want)


def test_paths(spark):
    w = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 2.0), ("C", "D", 1.0), ("A", "E", 3.0), ("E", "F", 1.0)], "src string, dst string, weight double")
    assert [tuple(r) for r in alg.dijkstra(w, F.lit("A"), F.lit("D")).select("path", "weight").collect()] == [(["A", "B", "C", "D"], 4.0)]
    assert alg.dijkstra(w, F.lit("D"), F.lit("A")).collect() == []
    starts = spark.createDataFrame([(1,)], "id bigint")
    assert {r.id: r.depth for r in alg.bfs(edges(spark, TRIANGLES), starts, 2, "out").collect()} == {1: 0, 2: 1, 3: 2}
    assert sorted(r.path for r in alg.simple_paths(edges(spark, TRIANGLES), starts, 1, 3).collect()) == [[1, 2], [1, 2, 3], [1, 2, 3, 4]]


def test_dijkstra_long_chain(spark):
    """The cheap way has 66 hops, the dear one a single hop."""
    w = spark.createDataFrame([(i, i + 1, 1.0) for i in range(66)] + [(0, 66, 1000.0)], "src bigint, dst bigint, weight double").coalesce(1)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = alg.dijkstra(w, F.lit(0).cast("bigint"), F.lit(66).cast("bigint")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert (got.weight, got.path) == (66.0, list(range(67)))
    with pytest.raises(ValueError):
        alg.dijkstra(w.withColumn("weight", -F.col("weight")), F.lit(0), F.lit(1))


def test_communities(spark):
    e = edges(spark, TRIANGLES)
    assert alg.wcc(e).select("componentId").distinct().count() == 1
    for f in (alg.louvain, alg.label_propagation):
        com = {r.id: r.community for r in f(e).collect()}
        assert set(com) == {1, 2, 3, 4, 5, 6}
    com = {r.id: r.community for r in alg.louvain(e).collect()}
    assert com[1] == com[2] and com[5] == com[6] and com[1] != com[6]
    emb = alg.fastrp(e, 16).collect()
    assert emb == alg.fastrp(e, 16).collect() or {r.id: r.embedding for r in emb} == pytest.approx({r.id: r.embedding for r in alg.fastrp(e, 16).collect()})
    assert all(abs(math.hypot(*r.embedding) - 1) < 1e-9 or math.hypot(*r.embedding) == 0 for r in emb)


def test_link_prediction(spark):
    d = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4)])
    r = {(x.node1, x.node2): x for x in lp.raw_scores(d).collect()}
    assert (r[1, 4].common, r[1, 4].jaccard, r[1, 4].aa, r[1, 4].ra) == (2, 1.0, pytest.approx(2 / math.log(2)), 1.0)
    assert {(x.node1, x.node2): x.score for x in lp.scores(d, "common_neighbors").collect()}[1, 4] == 0.5
    assert lp.scores(d, "ensemble", [1]).count() == 1


def test_search(spark):
    d = spark.createDataFrame([(1, "Graph search in graphs"), (2, "the cache"), (3, None), (4, ""), (5, "cache of a graph")], "id bigint, t string")
    s = {r.id: r.score for r in search.bm25(d, "id", "t", "graph").collect()}
    assert set(s) == {1, 5} and s[1] > s[5] > 0
    assert search.bm25(d, "id", "t", "the of").collect() == []
    assert [r.id for r in search.bm25_fixed(d, "id", "t", "+graph -search").collect()] == [5]
    assert [r.id for r in search.phrase(d, "id", "t", "graph SEARCH").collect()] == [1]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [-1.0, 0.0]), (4, [1.0]), (5, None)], "id bigint, v array<double>")
    assert [r.id for r in search.nearest(v, "id", "v", [1.0, 0.0], 5).collect()] == [1, 2]
    m = spark.createDataFrame([(0, 1, 1.0, [1.0, 0.0]), (0, 2, 0.99, [1.0, 0.0]), (0, 3, 0.5, [0.0, 1.0])], "g int, id int, s double, v array<double>")
    assert [r.id for r in search.mmr(m, "g", "id", "s", "v", 2, 0.5).orderBy("place").collect()] == [1, 3]
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, item string, rank int")
    rel = spark.createDataFrame([(1, "b"), (1, "z"), (2, "q")], "query_id int, item string")
    got = {r.query_id: r for r in search.retrieval_measures(ranked, rel).collect()}
    assert (got[1].p5, got[1].mrr, got[1].ap, got[1].hit, got[2].mrr, got[2].hit) == (0.2, 0.5, 0.25, True, 0.0, False)


def test_timeline(spark):
    e = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:04:00"), ("u", "2024-01-01 00:10:00"), ("v", "2024-01-01 00:00:00")], "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.k, r.session, r.n) for r in timeline.session_summary(e, "k", "ts", 300).collect()) == [("u", 1, 2), ("u", 2, 1), ("v", 1, 1)]
    assert timeline.sessions(e, "k", "ts", 3600, 300).select("session").distinct().count() == 2
    assert timeline.cooled(e, ["k"], "ts", 300).count() == 3
    p = spark.createDataFrame([("s", "a", 0), ("s", "b", 29), ("s", "b", 31), ("s", "c", 59)], "s string, i string, t int").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted((r.a, r.b, r.n) for r in timeline.co_access(p, "s", "i", "ts", 30, 1).collect()) == [("a", "b", 1), ("b", "c", 2)]
    row = spark.range(1).select(timeline.decay_score(F.lit("2025-01-01"), F.lit("2025-01-01"), F.lit(100), F.lit("episodic")).alias("x")).first()
    assert row.x == pytest.approx(0.4 + 0.3 + 0.09)
    kept = timeline.retained(spark.createDataFrame([("a", "2024-01-01"), ("b", "2020-01-01"), (None, None)], "kind string, c string"), "c", "kind", {"a": 30, "b": 30}, F.lit("2024-01-10"))
    assert kept.count() == 2


def test_filters(spark):
    zs = [3.0, 5.0, 4.0, 8.0, None, 9.0]
    df = spark.createDataFrame([(1, i, z) for i, z in enumerate(zs)], "k int, i int, z double")
    x = last = 0.0
    p, n = 30.0, 0
    for z in [z for z in zs if z is not None]:
        if n == 0:
            x = last = z
        else:
            x0, p0 = x + ((x - last) * 0.5 if n > 1 else 0.0), p + 0.1
            g = p0 / (p0 + 88.0)
            last, x, p = x, x0 + g * (z - x0), (1 - g) * p0
        n += 1
    assert temporal.fold_series(df, "k", "i", "z").first().state["x"] == pytest.approx(x)
    assert temporal.fold_series(df, "k", "i", "z", "velocity").first().state["n"] == 5


def test_files(spark, tmp_path):
    doc = {"nodes": [{"id": "1", "labels": ["A"], "properties": {"x": "1"}}, {"id": "2", "labels": [], "properties": {}}], "relationships": [{"id": "r", "type": "K", "startNode": "1", "endNode": "2", "properties": {}}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    g = graph_files.read_document(spark, str(tmp_path / "g.json"))
    done = graph_files.write_graph(g, str(tmp_path / "out")).first()
    assert (done.nodes, done.relationships) == (2, 1)
    back = graph_files.read_graph(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.nodes[0].df.collect())) == sorted(map(tuple, g.nodes[0].df.collect()))
    assert graph_files.union_graph([g, back]).nodes[0].df.count() == 4


def test_streams(spark, tmp_path):
    d = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a", 1.0), (1, "2024-01-01 00:30:00", "a", 2.0), (2, "2024-01-01 03:00:00", "b", 4.0)], "user_id bigint, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    d.write.parquet(str(tmp_path / "in"))
    s = live.event_stream(spark, str(tmp_path / "in"), d.schema)
    for name, df, mode in (("w", live.windowed_counts(s), "append"), ("k", live.live_filter(s), "update"), ("s", live.live_sessions(s), "append")):
        q = df.writeStream.format("memory").queryName(f"live_{name}").outputMode(mode).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert [(r.event_type, r.n, r.total) for r in spark.table("live_w").collect()] == [("a", 2, 3.0)]
    assert {(r.user_id, r.n) for r in spark.table("live_k").collect()} == {(1, 2), (2, 1)}


def test_hybrid_recommend_groups(spark):
    t = spark.createDataFrame([(1, "graph cache"), (2, "other words"), (3, None)], "id bigint, t string")
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "a"), (4, [0.0, 1.0], "b"), (5, None, "b")], "id bigint, v array<double>, g string")
    got = [r.id for r in search.hybrid(t, v, "id", "t", "v", "graph", [1.0, 0.0], 3).collect()]
    assert got[0] == 1 and set(got) == {1, 2, 4}
    assert [r.id for r in search.hybrid(t.limit(0), v, "id", "t", "v", "the", [1.0, 0.0], 1).collect()] == [1]
    assert [r.id for r in search.recommend(v, "id", "v", [1], [4], 2).collect()] == [2]
    assert sorted((r.g, r.id) for r in search.best_per_group(v, "id", "v", "g", [1.0, 0.0], 1).collect()) == [("a", 1), ("b", 4)]
