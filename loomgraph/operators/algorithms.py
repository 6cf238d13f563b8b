"""Graph algorithms as loops of joins and grouped sums over an edge DataFrame.

Edges have ``src`` and ``dst`` of one type; nodes are the ends of edges. Loops cut their
lineage with checkpoints. Edges with a null end are left out; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.session import cut

PATH = F.struct


def clean(e: DataFrame) -> DataFrame:
    return e.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())


def undirected(e: DataFrame) -> DataFrame:
    """Each pair of neighbours in both directions once, without loops."""
    e = clean(e).select("src", "dst").filter("src <> dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def vertices(e: DataFrame) -> DataFrame:
    return clean(e).select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def turned(e: DataFrame, direction: str) -> DataFrame:
    e = clean(e).select("src", "dst")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return (e if direction == "out" else back if direction == "in" else e.union(back)).distinct()


def bfs(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "both", paths: bool = False) -> DataFrame:
    """``id, depth`` (and ``path``) of nodes within ``depth`` hops of the starts; each node once, at its least depth."""
    e = turned(edges, direction)
    seen = starts.select("id", F.lit(0).alias("depth"), F.array(F.col("id").cast("string")).alias("path")).dropDuplicates(["id"])
    front = seen
    for d in range(1, depth + 1):
        step = front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id"), F.lit(d).alias("depth"), F.array_append("path", F.col("dst").cast("string")).alias("path"))
        step = step.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min("depth").alias("depth"), F.min("path").alias("path"))
        front = cut(step) if d % 3 == 0 else step
        seen = seen.union(front)
    return seen if paths else seen.drop("path")


def reach(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "both", stop: DataFrame | None = None) -> DataFrame:
    """``s, id, depth, path`` for each start ``s`` by itself: nodes within ``depth`` hops, each once at its least depth, by its least path.

    Nodes in ``stop`` (``id``) are reached but not left. Every round is written and read again; the loop ends with the frontier.
    """
    e = cut(turned(edges, direction))
    seen = front = cut(starts.select("s", F.col("s").alias("id"), F.lit(0).alias("depth"), F.array(F.col("s").cast("string")).alias("path")).dropDuplicates(["s"]))
    for d in range(1, depth + 1):
        go = front if stop is None else front.join(stop, "id", "left_anti")
        step = go.join(e, go["id"] == e["src"]).select("s", F.col("dst").alias("id"), F.lit(d).alias("depth"), F.array_append("path", F.col("dst").cast("string")).alias("path"))
        front = cut(step.join(seen.select("s", "id"), ["s", "id"], "left_anti").groupBy("s", "id").agg(F.min("depth").alias("depth"), F.min("path").alias("path")))
        if not front.take(1):
            break
        seen = seen.union(front)
    return seen


def simple_paths(edges: DataFrame, starts: DataFrame, least: int, most: int, direction: str = "out") -> DataFrame:
    """``id, path``: paths of ``least`` to ``most`` hops from the starts that meet no node twice; ``id`` is the end."""
    e = turned(edges, direction)
    front = starts.select("id", F.array("id").alias("path"))
    out = [front] if least == 0 else []
    for k in range(1, most + 1):
        front = front.join(e, front["id"] == e["src"]).filter(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("id"), F.array_append("path", F.col("dst")).alias("path"))
        if k >= least:
            out.append(front)
    return reduce(lambda x, y: x.union(y), out)


def shortest_paths(edges: DataFrame, starts: DataFrame, end: str, most: int | None = None, direction: str = "out") -> DataFrame:
    """``path``: all paths of fewest hops from the starts to ``end`` (its id as text), if those are ``most`` at most.

    A frontier goes on until it meets the end or is empty; paths are then made backwards through its levels only.
    """
    e = cut(turned(edges, direction))
    front = seen = cut(starts.select("id"))
    levels = [front]
    ends = lambda f: f.filter(F.col("id").cast("string") == end).select("id", F.array("id").alias("path"))
    while not ends(front).take(1):
        if most is not None and len(levels) > most:
            break
        front = cut(front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        if not front.take(1):
            break
        seen = cut(seen.union(front))
        levels.append(front)
    p = ends(front)
    for level in reversed(levels[:-1]):
        p = cut(p.join(e, p["id"] == e["dst"]).select(F.col("src").alias("id"), F.concat(F.array("src"), "path").alias("path")).join(level, "id", "left_semi"))
    return p.select("path")


def dijkstra(edges: DataFrame, start: Column, end: Column) -> DataFrame:
    """``path, weight``: the least costly path along edge directions by relaxation until nothing improves; weights must not be negative."""
    e = clean(edges).groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    spark = edges.sparkSession
    best = cut(spark.range(1).select(start.alias("id"), F.lit(0.0).alias("weight"), F.array(start).alias("path")))
    if e.filter("weight < 0").take(1):
        raise ValueError("weights must not be negative")
    front = best
    while True:
        step = front.join(e.withColumnRenamed("weight", "w"), front["id"] == e["src"]).select(F.col("dst").alias("id"), (F.col("weight") + F.col("w")).alias("weight"), F.array_append("path", F.col("dst")).alias("path"))
        step = step.groupBy("id").agg(F.min(F.struct("weight", "path")).alias("b")).select("id", "b.*")
        old = best.select("id", F.col("weight").alias("old"))
        front = cut(step.join(old, "id", "left").filter("old is null or weight < old").drop("old"))
        if not front.take(1):
            break
        best = cut(best.join(front.select("id"), "id", "left_anti").unionByName(front))
    return best.filter(F.col("id") == end)


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """``id, score`` after exactly ``rounds`` rounds; nodes without out-edges spread their score over all.

    Every node also gives itself nothing, so that one join and one grouped sum make the next scores of all
    nodes. Each round is written and read again: its plan is the same in the first and the last.
    """
    e = clean(edges).select("src", "dst")
    v = vertices(e)
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    own = v.join(out.select(F.col("src").alias("id"), "deg"), "id", "left").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"), F.col("deg").isNull().alias("loose"))
    links = cut(e.join(out, "src").select("src", "dst", (1 / F.col("deg")).alias("w"), F.lit(False).alias("loose")).union(own).repartition("src"))
    n, loose = links.agg(F.count_if(F.expr("src = dst and w = 0")), F.count_if("loose")).first()
    if not n:
        return v.select("id", F.lit(0.0).alias("score"))
    rank = v.select("id", F.lit(1.0 / n).alias("score"))
    at_rest = loose / n  # the scores of nodes without out-edges
    for i in range(rounds):
        given = links.join(rank.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.sum(F.col("score") * F.col("w")).alias("got"), F.max("loose").alias("loose"))
        rank = cut(given.select(F.col("dst").alias("id"), (F.lit((1 - damping) / n) + damping * (F.col("got") + F.lit(at_rest) / n)).alias("score"), "loose"))
        if i + 1 < rounds:
            at_rest = rank.filter("loose").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
            rank = rank.drop("loose")
    return rank.select("id", "score")


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """Distinct values of ``by`` numbered from 0 in order, sorted by range over all tasks rather than in one."""
    d = cut(df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # a row a task
    own = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return d.withColumn("_own", own).join(ahead, "_part").withColumn(name, (F.col("_ahead") + F.col("_own") - 1).cast("int")).drop("_part", "_own", "_ahead")


def wcc(edges: DataFrame) -> DataFrame:
    """``id, componentId``: components of the undirected graph, numbered from 0 by their least id."""
    e = clean(edges)
    if dict(e.dtypes)["src"] == "bigint":
        comp = connected_components(e)
    else:
        ids = cut(vertices(e).select("id", F.xxhash64("id").alias("k")))
        a, b = ids.select(F.col("id").alias("src"), F.col("k").alias("u")), ids.select(F.col("id").alias("dst"), F.col("k").alias("v"))
        found = connected_components(e.join(a, "src").join(b, "dst"), "u", "v").withColumnRenamed("id", "k")
        found = found.join(ids, "k")
        least = found.groupBy("component").agg(F.min("id").alias("least"))
        comp = found.join(least, "component").select("id", F.col("least").alias("component"))
    roots = numbered(comp.select("component").distinct(), "component", "componentId")
    return comp.join(roots, "component").select("id", "componentId")


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """``id, community``: every node takes the label most frequent among its neighbours, the least of equals.

    A round is two steps: in each, the nodes of one half (by hash) change at once, which keeps labels from
    swapping forever; results may differ from an in-place sweep. It ends after ``rounds`` rounds, or when a round changes nothing.
    """
    e = cut(undirected(edges))
    lab, still = vertices(edges).select("id", F.col("id").alias("community")), 0
    for i in range(2 * rounds):
        votes = e.join(lab, e["dst"] == lab["id"]).groupBy("src", "community").agg(F.count(F.lit(1)).alias("n"))
        top = votes.groupBy("src").agg(F.max("n").alias("n"))
        best = votes.join(top, ["src", "n"]).groupBy("src").agg(F.min("community").alias("new"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2
        new = lab.join(best, lab["id"] == best["src"], "left").select("id", F.when(turn & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("community")).alias("community"), (turn & F.col("new").isNotNull() & (F.col("new") != F.col("community"))).alias("moved"))
        new = cut(new)
        still = 0 if new.filter("moved").take(1) else still + 1
        lab = new.select("id", "community")
        if still == 2:
            break
    return lab


def louvain(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``id, community``: local moves to the neighbouring community of largest gain, halves in turn, up to
    ``rounds`` sweeps or until none moves in one."""
    e = undirected(edges)
    e = cut(e)
    m2 = max(e.count(), 1)
    deg = cut(e.groupBy("src").agg(F.count(F.lit(1)).cast("double").alias("deg")))
    com, still = deg.select(F.col("src").alias("id"), F.col("src").alias("community"), "deg"), 0
    for i in range(2 * rounds):
        tot = com.groupBy("community").agg(F.sum("deg").alias("tot"))
        inn = e.join(com.select("id", "community"), e["dst"] == F.col("id")).groupBy("src", "community").agg(F.count(F.lit(1)).alias("k_in"))
        cand = inn.join(tot, "community").join(com.select(F.col("id").alias("src"), F.col("community").alias("own"), "deg"), "src")
        mine = F.when(F.col("community") == F.col("own"), F.col("deg")).otherwise(0.0)
        gain = F.col("k_in") - (F.col("tot") - mine) * F.col("deg") / m2
        best = cand.groupBy("src").agg(F.max(F.struct(gain.alias("gain"), (F.col("community") == F.col("own")).alias("stay"), "community")).alias("b"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2
        new = com.join(best, com["id"] == best["src"], "left")
        go = turn & F.col("b.gain").isNotNull() & (F.col("b.gain") > 0) & (F.col("b.community") != com["community"])
        new = cut(new.select("id", F.when(go, F.col("b.community")).otherwise(com["community"]).alias("community"), "deg", F.coalesce(go, F.lit(False)).alias("moved")))
        still = 0 if new.filter("moved").take(1) else still + 1
        com = new.drop("moved")
        if still == 2:
            break
    return com.select("id", "community")


def triangles(edges: DataFrame) -> DataFrame:
    """``id, triangles``: edges are pointed from the lesser degree to the greater, so that a hub closes few wedges."""
    e = cut(undirected(edges))
    deg = e.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    o = e.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst").filter("d < d2 or (d = d2 and src < dst)").select("src", "dst")
    o = cut(o)
    a, b, c = o.alias("a"), o.alias("b"), o.alias("c")
    t = a.join(b, (F.col("a.src") == F.col("b.src")) & (F.col("a.dst") < F.col("b.dst"))).select(F.col("a.src").alias("x"), F.col("a.dst").alias("y"), F.col("b.dst").alias("z"))
    t = t.join(c, ((F.least("y", "z") == F.least("c.src", "c.dst")) & (F.greatest("y", "z") == F.greatest("c.src", "c.dst")))).select("x", "y", "z")
    return t.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """``id``: what is left when nodes with fewer than ``k`` neighbours are taken away again and again."""
    e = cut(undirected(edges))
    while True:
        keep = e.groupBy("src").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") >= k).select("src")
        new = cut(e.join(keep, "src", "left_semi").join(keep.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"))
        if new.count() == e.count():
            return new.select(F.col("src").alias("id")).distinct()
        e = new


def core_numbers(edges: DataFrame) -> DataFrame:
    """``id, core``: the largest k whose k-core holds the node; nodes without neighbours have 0."""
    e = cut(undirected(edges))
    done = vertices(edges).join(e.select(F.col("src").alias("id")), "id", "left_anti").select("id", F.lit(0).alias("core"))
    for k in count(2):
        before = e.select(F.col("src").alias("id")).distinct()
        if not e.take(1):
            return done
        while True:
            keep = e.groupBy("src").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") >= k).select("src")
            new = cut(e.join(keep, "src", "left_semi").join(keep.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"))
            same = new.count() == e.count()
            e = new
            if same:
                break
        done = done.union(before.join(e.select(F.col("src").alias("id")), "id", "left_anti").select("id", F.lit(k - 1).alias("core")))


def scc(edges: DataFrame) -> DataFrame:
    """``id, component``: strongly connected components, each named by its least id.

    In a round every node learns the least id that reaches it; those that reach that id back, over nodes of
    the same colour, are its component and leave the graph. Nodes without a way in or out leave first.
    """
    e = cut(clean(edges).select("src", "dst").filter("src <> dst").distinct())
    left, done = cut(vertices(edges)), None

    def among(e: DataFrame, v: DataFrame) -> DataFrame:
        return e.join(v.select(F.col("id").alias("src")), "src", "left_semi").join(v.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")

    while left.take(1):
        while True:
            both = left.join(e.select(F.col("src").alias("id")), "id", "left_semi").join(e.select(F.col("dst").alias("id")), "id", "left_semi")
            alone = cut(left.join(both, "id", "left_anti"))
            if not alone.take(1):
                break
            single = alone.select("id", F.col("id").alias("component"))
            done = single if done is None else done.union(single)
            left = cut(both)
            e = cut(among(e, left))
        if not left.take(1):
            break
        colour = left.select("id", F.col("id").alias("c"))
        while True:
            come = e.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("n"))
            new = cut(colour.join(come, "id", "left").select("id", F.least("c", F.coalesce("n", "c")).alias("c"), (F.col("n") < F.col("c")).alias("moved")))
            colour = new.select("id", "c")
            if not new.filter("moved").take(1):
                break
        own = e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").filter("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "a")
        own = cut(own)
        found = front = cut(colour.filter("id = c"))
        while True:
            step = own.join(front.select(F.col("id").alias("src"), F.col("c")), "src").filter("a = c").select(F.col("dst").alias("id"), "c").distinct()
            front = cut(step.join(found.select("id"), "id", "left_anti"))
            if not front.take(1):
                break
            found = found.union(front)
        found = cut(found)
        done = found.select("id", F.col("c").alias("component")) if done is None else done.union(found.select("id", "c"))
        left = cut(left.join(found.select("id"), "id", "left_anti"))
        e = cut(among(e, left))
    if done is None:
        return left.select("id", F.col("id").alias("component"))
    least = done.groupBy("component").agg(F.min("id").alias("least"))
    return done.join(least, "component").select("id", F.col("least").alias("component"))


def _adjacency(e: DataFrame, ids: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each numbered node's neighbours begin (n + 1 places), and the neighbours."""
    num = e.join(ids.select(F.col("id").alias("src"), F.col("k").alias("a")), "src").join(ids.select(F.col("id").alias("dst"), F.col("k").alias("b")), "dst").select(F.col("a").cast("int"), F.col("b").cast("int")).toArrow()
    a, b = num["a"].to_numpy(), num["b"].to_numpy()
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    return np.searchsorted(a, np.arange(n + 1)), b


def _walker(at: np.ndarray, to: np.ndarray, wanted: np.ndarray, most: int | None, every: bool):
    """Breadth-first search from some starts at once; a state is a start's number times the nodes, plus a node."""
    n = len(at) - 1
    some = int(np.clip(8_000_000 // max(n, 1), 1, 1024))
    seen, place = np.zeros(some * n, bool), np.zeros(some * n, np.int32)

    def walk(starts: np.ndarray):
        """``start, end, hops, paths`` of the wanted nodes first met in each round."""
        for lo in range(0, len(starts), some):
            own = starts[lo : lo + some]
            front, ways = np.arange(len(own)) * n + own, np.ones(len(own), np.int64)
            seen[front] = True
            met, d = [front], 0
            while len(front) and (most is None or d < most):
                d += 1
                v = front % n
                many = at[v + 1] - at[v]
                by = np.repeat(np.arange(len(front)), many)
                near = (front - v)[by] + to[np.arange(len(by)) + np.repeat(at[v] - np.cumsum(many) + many, many)]
                new = ~seen[near]
                near = near[new]
                place[near] = np.arange(len(near))
                front = near[place[near] == np.arange(len(near))]
                if every:
                    place[front] = np.arange(len(front))
                    more = np.zeros(len(front), np.int64)
                    np.add.at(more, place[near], ways[by[new]])
                    ways = more
                else:
                    ways = np.ones(len(front), np.int64)
                seen[front] = True
                met.append(front)
                hit = np.flatnonzero(wanted[front % n])
                if len(hit):
                    yield own[front[hit] // n], front[hit] % n, d, ways[hit]
            for x in met:
                seen[x] = False

    return walk


def fewest_hops(edges: DataFrame, starts: DataFrame, ends: DataFrame, most: int | None = None, every: bool = False, max_edges: int = 20_000_000) -> tuple[DataFrame, DataFrame] | None:
    """``_s, _e, _hops`` with a row for one shortest path, or for every one, from each start to each other end (``id``), and ``id, k`` of the numbers.

    Starts are spread over tasks, each with the whole adjacency; parallel edges make different paths.
    None if there are more than ``max_edges`` edges.
    """
    e = clean(edges).select("src", "dst").filter("src <> dst")
    e = e if every else e.distinct()
    if e.count() > max_edges:
        return None
    spark, known = edges.sparkSession, "id is not null"
    ids = cut(numbered(vertices(e).union(starts.filter(known)).union(ends.filter(known)).distinct(), "id", "k"))
    n = ids.count()
    wanted = np.zeros(n, bool)
    wanted[ids.join(ends.distinct(), "id").select("k").toArrow()["k"].to_numpy()] = True
    shared = spark.sparkContext.broadcast((*_adjacency(e, ids, n), wanted))

    def run(batches):
        walk, held, count_held = None, [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int32()) for c in zip(*held, strict=True)], names=["_s", "_e", "_hops"])
        for b in batches:
            walk = walk or _walker(*shared.value, most, every)
            for s, t, d, ways in walk(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)):
                while len(s):
                    # Some rows at a time: a pair has as many as it has paths.
                    now = np.minimum(ways, max(1, 500_000 // len(s)))
                    held.append((np.repeat(s, now), np.repeat(t, now), np.full(now.sum(), d)))
                    count_held += int(now.sum())
                    if count_held > 500_000:
                        yield flush()
                        held, count_held = [], 0
                    left = ways > now
                    s, t, ways = s[left], t[left], (ways - now)[left]
        if held:
            yield flush()

    own = ids.join(starts.distinct(), "id").select("k").repartition(4 * spark.sparkContext.defaultParallelism, "k")
    return own.mapInArrow(run, "_s int, _e int, _hops int"), ids


def closeness(edges: DataFrame, max_edges: int = 20_000_000) -> DataFrame:
    """``id, score`` = reached^2 / (sum of distances * (n - 1)) over the undirected graph.

    Sources are spread over tasks, each with the whole adjacency; a bit stands for a source, so a pass over the
    edges takes a hop for hundreds. With more than ``max_edges`` rows of neighbours, pairs are joined instead.
    """
    e = cut(undirected(edges))
    v = vertices(edges)
    n, m = v.count(), e.count()
    if m > max_edges:
        s = _pair_hops(e, v)
    else:
        ids = cut(numbered(v, "id", "k"))
        spark = edges.sparkSession
        shared = spark.sparkContext.broadcast(_adjacency(e, ids, n))
        words = int(np.clip(8_000_000 // max(m, 1), 1, 16))

        def hops(parts):
            at, to = shared.value
            has = np.flatnonzero(at[1:] > at[:-1])
            r, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for pdf in parts:
                for lo in range(0, len(pdf) if len(has) else 0, 64 * words):
                    own = pdf["k"].to_numpy()[lo : lo + 64 * words]
                    i = np.arange(len(own))
                    front = np.zeros((n, words), np.uint64)
                    front[own, i // 64] = np.uint64(1) << (i % 64).astype(np.uint64)
                    seen, d = front.copy(), 0
                    while front.any():
                        d += 1
                        near = np.zeros_like(front)
                        near[has] = np.bitwise_or.reduceat(front[to], at[has], axis=0)
                        front = near & ~seen
                        seen |= front
                        c = np.bitwise_count(front).sum(1, dtype=np.int64)  # distances are the same both ways
                        r += c
                        total += d * c
            yield pd.DataFrame({"k": np.arange(n), "r": r, "total": total})

        parts = ids.select("k").repartition(spark.sparkContext.defaultParallelism, "k").mapInPandas(hops, "k bigint, r bigint, total bigint")
        s = parts.groupBy("k").agg(F.sum("r").alias("r"), F.sum("total").alias("total")).join(ids, "k")
    return s.select("id", F.coalesce(F.try_divide(F.col("r") * F.col("r"), F.col("total") * (n - 1)), F.lit(0.0)).alias("score"))


def _pair_hops(e: DataFrame, v: DataFrame) -> DataFrame:
    """``id, r, total``: nodes reached and the sum of their distances; (source, node) pairs grow by a hop a round, n^2 in the end."""
    front = seen = v.select(F.col("id").alias("s"), F.col("id").alias("t"), F.lit(0).alias("d"))
    for d in count(1):
        step = front.join(e, front["t"] == e["src"]).select("s", F.col("dst").alias("t")).distinct().join(seen.select("s", "t"), ["s", "t"], "left_anti").withColumn("d", F.lit(d))
        front = cut(step)
        if not front.take(1):
            break
        seen = cut(seen.union(front))
    return seen.groupBy(F.col("s").alias("id")).agg((F.count(F.lit(1)) - 1).alias("r"), F.sum("d").alias("total"))


def betweenness(edges: DataFrame, max_edges: int = 20_000_000) -> DataFrame:
    """``id, score``: Brandes over directed edges without weights, times 2 / ((n - 1)(n - 2)) for n > 2.

    Sources are spread over tasks, each with the whole adjacency, whose size is checked against
    ``max_edges`` (the measure costs nodes times edges, far beyond what larger graphs allow).
    """
    e = clean(edges).select("src", "dst").filter("src <> dst").distinct()
    spark = edges.sparkSession
    ids = cut(numbered(vertices(edges), "id", "k"))
    n, m = ids.count(), e.count()
    if m > max_edges:
        raise ValueError(f"{m} edges are more than {max_edges}; take a subgraph or raise max_edges")
    shared = spark.sparkContext.broadcast(_adjacency(e, ids, n))

    def brandes(parts):
        at, to = shared.value
        score = np.zeros(n)
        for pdf in parts:
            for s in pdf["k"]:
                dist, sigma, delta = np.full(n, -1), np.zeros(n), np.zeros(n)
                dist[s], sigma[s] = 0, 1
                levels = [np.array([s])]
                while len(levels[-1]):
                    f = levels[-1]
                    cnt = at[f + 1] - at[f]
                    src = np.repeat(f, cnt)
                    dst = to[np.repeat(at[f] - np.concatenate([[0], np.cumsum(cnt)[:-1]]), cnt) + np.arange(cnt.sum())]
                    dist[dst[dist[dst] < 0]] = len(levels)
                    down = dist[dst] == len(levels)
                    np.add.at(sigma, dst[down], sigma[src[down]])
                    levels.append(np.unique(dst[down]))
                for f in reversed(levels[:-1]):
                    cnt = at[f + 1] - at[f]
                    src = np.repeat(f, cnt)
                    dst = to[np.repeat(at[f] - np.concatenate([[0], np.cumsum(cnt)[:-1]]), cnt) + np.arange(cnt.sum())]
                    down = dist[dst] == dist[src] + 1
                    np.add.at(delta, src[down], sigma[src[down]] / sigma[dst[down]] * (1 + delta[dst[down]]))
                delta[s] = 0
                score += delta
        yield pd.DataFrame({"k": np.arange(n), "score": score})

    parts = ids.select("k").repartition(spark.sparkContext.defaultParallelism, "k").mapInPandas(brandes, "k bigint, score double")
    scale = 2.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return parts.groupBy("k").agg((F.sum("score") * scale).alias("score")).join(ids, "k").select("id", "score")


def fastrp(edges: DataFrame, dims: int = 64, weights: tuple[float, ...] = (0.0, 1.0, 1.0, 1.0), seed: int = 42) -> DataFrame:
    """``id, embedding``: sparse random starts drawn by hash, neighbours' means mixed in by weight, unit length.

    A round is one join and one grouped average, with a sum for each component kept apart in the partial
    aggregate; no edge is made into a row a component.
    """
    e = cut(undirected(edges))
    v = vertices(edges)
    draw = lambda i: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), i), F.lit(6))
    start = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.when(draw(i) == 0, -1.0).when(draw(i) == 1, 1.0).otherwise(0.0))
    emb = cut(v.select("id", start.alias("x")))
    for w in weights[1:]:
        far = e.join(emb, e["dst"] == emb["id"]).select("src", *[F.col("x")[i].alias(f"x{i}") for i in range(dims)])
        mean = far.groupBy("src").agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(dims)]).select("src", F.array(*[F.col(f"x{i}") for i in range(dims)]).alias("m"))
        emb = emb.join(mean, emb["id"] == mean["src"], "left")
        emb = cut(emb.select("id", F.zip_with("x", F.coalesce("m", "x"), lambda x, y: x * (1 - w) + y * w).alias("x")))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, y: s + y * y))
    return emb.select("id", norm.alias("n"), "x").select("id", F.transform("x", lambda y: F.coalesce(F.try_divide(y, F.col("n")), F.lit(0.0))).alias("embedding"))
