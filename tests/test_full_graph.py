"""Graph queries over all relationships against brute force on a small fixture."""

import math
import random
from collections import defaultdict
from itertools import combinations

import pytest

from loomgraph.operators import algorithms as alg
from loomgraph.plans import queries as q


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Relationships with a hub, a chain, parallel edges, a loop and null ends."""
    r = random.Random(7)
    es = [(0, i) for i in range(1, 20)] + [(100 + i, 101 + i) for i in range(12)] + [(r.randrange(40), r.randrange(40)) for _ in range(60)] + [(3, 4)] * 2 + [(50, 50), (None, 1), (1, None)]
    name = lambda x: None if x is None else f"4:g:{x}"
    d = tmp_path_factory.mktemp("full")
    spark.createDataFrame([(name(a), name(b)) for a, b in es], "source string, target string").write.parquet(f"{d}/relationships.parquet")
    return str(d), {(a, b) for a, b in es if a is not None and b is not None}


def hops(near, s):
    dist, front = {s: 0}, [s]
    while front:
        front = [y for x in front for y in near[x] if y not in dist and not dist.update({y: dist[x] + 1})]
    return dist


def neighbours(es):
    n = defaultdict(set)
    for a, b in es:
        if a != b:
            n[a].add(b)
            n[b].add(a)
    return n


def test_closeness(spark, folder):
    d, es = folder
    near, nodes = neighbours(es), {x for e in es for x in e}
    want = {}
    for s in nodes:
        h = hops(near, s)
        want[s] = (len(h) - 1) ** 2 / (sum(h.values()) * (len(nodes) - 1)) if len(h) > 1 else 0.0
    assert {r.id: r.score for r in q.OPS["closeness"][0](spark, d).collect()} == pytest.approx(want, abs=1e-8)
    joined = alg.closeness(q._clean_edges(spark, d), max_edges=1)
    assert {r.id: r.score for r in joined.collect()} == pytest.approx(want)


def test_betweenness(spark, folder):
    """By counts of shortest paths: v lies on s -> t if the distances add up."""
    d, es = folder
    nodes = {x for e in es for x in e}
    out = defaultdict(set)
    for a, b in es:
        if a != b:
            out[a].add(b)
    dist, paths = {s: hops(out, s) for s in nodes}, {}
    for s in nodes:
        c = paths[s] = defaultdict(int, {s: 1})
        for x in sorted(dist[s], key=dist[s].get):
            for y in out[x]:
                if dist[s][y] == dist[s][x] + 1:
                    c[y] += c[x]
    want = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t in dist[s]:
            for v in dist[s]:
                if len({s, t, v}) == 3 and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
                    want[v] += paths[s][v] * paths[v][t] / paths[s][t]
    n = len(nodes)
    got = {r.id: r.score for r in q.OPS["betweenness"][0](spark, d).collect()}
    assert got == pytest.approx({k: x * 2 / ((n - 1) * (n - 2)) for k, x in want.items()}, abs=1e-8) and max(got.values()) > 0


def test_link_prediction(spark, folder):
    d, es = folder
    near = neighbours(es)
    want = {}
    for a, b in combinations(sorted(near), 2):
        if (both := near[a] & near[b]) and b not in near[a]:
            want[a, b] = (len(both), sum(1 / math.log(len(near[m])) for m in both if len(near[m]) > 1), sum(1 / len(near[m]) for m in both), len(near[a]) * len(near[b]), len(both) / len(near[a] | near[b]))
    got = {(r.node1, r.node2): tuple(r)[2:] for r in q.OPS["link_prediction"][0](spark, d).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
