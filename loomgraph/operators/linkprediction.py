"""Scores of pairs of nodes that aren't linked, from the neighbours that they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.algorithms import undirected
from loomgraph.session import cut

# Weights of the ensemble.
ENSEMBLE = {"common_neighbors": 0.2, "jaccard": 0.2, "adamic_adar": 0.3, "resource_allocation": 0.2, "preferential_attachment": 0.1}


def _raw(edges: DataFrame, sources: list | None) -> DataFrame:
    """``node1, node2, common, aa, ra, d1, d2`` for pairs two hops apart that aren't neighbours.

    With sources only their pairs are made. Wedges are pre-aggregated where they meet; a hub's
    wedges are the square of its degree, as the scores need, and are spread by both ends.
    """
    e = cut(undirected(edges))
    deg = e.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    mid = e.join(deg.select(F.col("src").alias("m"), "d"), e["dst"] == F.col("m")).select(F.col("src").alias("node1"), "m", "d")
    if sources is not None:
        mid = mid.filter(F.col("node1").isin(*sources))
    other = e.select(F.col("src").alias("m"), F.col("dst").alias("node2"))
    w = mid.join(other, "m").filter("node1 <> node2")
    if sources is None:
        w = w.filter("node1 < node2")
    lnd = F.when(F.col("d") > 1, 1 / F.ln("d")).otherwise(0.0)
    p = w.groupBy("node1", "node2").agg(F.count(F.lit(1)).alias("common"), F.sum(lnd).alias("aa"), F.sum(1 / F.col("d")).alias("ra"))
    p = p.join(e.select(F.col("src").alias("node1"), F.col("dst").alias("node2")), ["node1", "node2"], "left_anti")
    return p.join(deg.select(F.col("src").alias("node1"), F.col("d").alias("d1")), "node1").join(deg.select(F.col("src").alias("node2"), F.col("d").alias("d2")), "node2")


def normalised(kind: str):
    return {
        "common_neighbors": lambda: 1 - 1 / (1 + F.col("common") / 2),
        "adamic_adar": lambda: F.tanh(F.col("aa") / 5),
        "resource_allocation": lambda: F.tanh(F.col("ra") / 5),
        "jaccard": lambda: F.col("common") / (F.col("d1") + F.col("d2") - F.col("common")),
        "preferential_attachment": lambda: F.least(F.log10(F.col("d1") * F.col("d2") + 1) / 4, F.lit(1.0)),
    }[kind]()


def scores(edges: DataFrame, kind: str, sources: list | None = None) -> DataFrame:
    """``node1, node2, score`` of the pairs with a shared neighbour, normalised to 0..1 by the kind; 'ensemble' weighs all."""
    r = _raw(edges, sources)
    s = normalised(kind) if kind != "ensemble" else sum((w * normalised(k) for k, w in ENSEMBLE.items()), F.lit(0.0))
    return r.select("node1", "node2", s.alias("score"))


def raw_scores(edges: DataFrame, sources: list | None = None) -> DataFrame:
    return _raw(edges, sources).select("node1", "node2", "common", "aa", "ra", (F.col("d1") * F.col("d2")).alias("pa"), normalised("jaccard").alias("jaccard"))


def hybrid(topology: DataFrame, semantic: DataFrame, weight: float = 0.5, least: float = 0.3) -> DataFrame:
    """``node1, node2, score``: topology rescaled to 0..1 (a constant becomes 1) mixed with a similarity of the same pairs."""
    lim = topology.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    t = topology.crossJoin(F.broadcast(lim)).select("node1", "node2", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0).alias("t"))
    j = t.join(semantic.select("node1", "node2", F.col("similarity").alias("s")), ["node1", "node2"], "full")
    mix = weight * F.coalesce("t", F.lit(0.0)) + (1 - weight) * F.coalesce("s", F.lit(0.0))
    return j.select("node1", "node2", mix.alias("score")).filter(F.col("score") >= least)
