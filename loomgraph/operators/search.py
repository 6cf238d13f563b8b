"""Keyword and vector search, rank fusion, diversification, and retrieval measures."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomgraph.session import cut

# BM25 constants, fusion constant, and words that carry no meaning in English text.
K1, B = 1.2, 0.75
RRF_K, RRF_LEAST = 60, 0.01
STOP_WORDS = "a an and are as at be by for from has have he in is it its of on or that the to was were with this but they we you your my their been do does did".split()


def tokens(text: Column, stop: bool = True) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS) if stop else F.length(w) > 1)


def inverted_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf, dl``: a row for each different term of each text."""
    d = df.select(F.col(key), tokens(F.col(text)).alias("ts")).filter(F.size("ts") > 0)
    return d.select(key, F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(df: DataFrame, key: str, text: str, query: str, prefix: bool = True) -> DataFrame:
    """``key, score`` by BM25 with the true mean length; a term that only begins with a query term counts 0.8.

    The corpus is read and cut into words once: the same pass counts all texts and their mean length and
    writes the occurrences of query terms, from which everything else is made. It isn't shuffled.
    """
    words = list(dict.fromkeys(w for w in np.char.lower(query.split()) if w not in STOP_WORDS and len(w) > 1))
    if not words:
        return df.sparkSession.createDataFrame([], f"{key} {dict(df.dtypes)[key]}, score double")
    hit = lambda t: reduce(lambda x, y: x | y, [(t == w) if not prefix else t.startswith(w) for w in words])
    d = df.select(F.col(key), tokens(F.col(text)).alias("ts")).select(key, F.size("ts").alias("dl"), F.filter("ts", hit).alias("hits")).filter("dl > 0")
    seen = Observation()
    held = cut(d.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total")).filter(F.size("hits") > 0))
    n, total = seen.get["n"] or 0, seen.get["total"] or 0
    some = held.select(key, "dl", F.explode("hits").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df_ = some.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = reduce(lambda x, y: x + y, [F.when(F.col("term") == w, 1.0).when(F.col("term").startswith(w), 0.8).otherwise(0.0) for w in words])
    s = some.join(df_, "term").withColumn("n", F.lit(n)).withColumn("avgdl", F.lit(total / max(n, 1)))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return s.groupBy(key).agg(F.sum(weight * part).alias("score"))


def bm25_fixed(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """``key, score`` as the index procedure has it: mean length 100, idf ln((n + 1) / df) of at least 0.1,
    occurrences inside words count, +term must be there and adds 2, -term must not be there."""
    must = [w[1:].lower() for w in query.split() if w.startswith("+") and len(w) > 1]
    never = [w[1:].lower() for w in query.split() if w.startswith("-") and len(w) > 1]
    words = list(dict.fromkeys([w.lower() for w in query.split() if w[:1] not in "+-"] + must))
    d = df.select(key, F.lower(F.col(text)).alias("t")).filter(F.col("t").isNotNull())
    count = lambda w: (F.length("t") - F.length(F.replace(F.col("t"), F.lit(w), F.lit("")))) / len(w)
    stats = d.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.contains("t", F.lit(w))).alias(f"df{i}") for i, w in enumerate(words)])
    ok = reduce(lambda x, y: x & y, [F.contains("t", F.lit(w)) for w in must] + [~F.contains("t", F.lit(w)) for w in never], F.lit(True))
    dl = F.size(F.split("t", r"\s+"))
    s = d.filter(ok).crossJoin(F.broadcast(stats))  # one row
    total = F.lit(2.0 * len(must))
    for i, w in enumerate(words):
        idf = F.greatest(F.ln((F.col("n") + 1) / F.greatest(F.col(f"df{i}"), F.lit(1))), F.lit(0.1))
        total = total + F.when(count(w) > 0, idf * count(w) * (K1 + 1) / (count(w) + K1 * (1 - B + B * dl / 100))).otherwise(0.0)
    return s.select(key, total.alias("score")).filter("score > 0").orderBy(F.desc("score"), key)


def phrase(df: DataFrame, key: str, text: str, words: str) -> DataFrame:
    return df.filter(F.contains(F.array_join(tokens(F.col(text), False), " "), F.lit(" ".join(words.lower().split())))).select(key)


def dot(v: Column, q: list[float]) -> Column:
    return F.aggregate(F.zip_with(v.cast("array<double>"), F.array(*[F.lit(float(x)) for x in q]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def similarity(v: Column, q: list[float], metric: str) -> Column:
    if metric == "dot":
        return dot(v, q)
    if metric == "euclidean":
        d = F.aggregate(F.zip_with(v.cast("array<double>"), F.array(*[F.lit(float(x)) for x in q]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        return 1 / (1 + F.sqrt(d))
    norm = F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return F.try_divide(dot(v, q), norm * float(np.linalg.norm(q)))


def nearest(df: DataFrame, key: str, vector: str, query: list[float], k: int, metric: str = "cosine", least: float = 0.0) -> DataFrame:
    """``key, score`` of the k most similar rows; vectors of another length are skipped, scores under ``least`` dropped."""
    d = df.filter(F.size(vector) == len(query)).select(key, similarity(F.col(vector), query, metric).alias("score"))
    return d.groupBy(key).agg(F.max("score").alias("score")).filter(F.col("score") >= least).orderBy(F.desc("score"), key).limit(k)


def rrf(lists: list[tuple[DataFrame, float]], key: str, k: int = RRF_K, least: float = RRF_LEAST) -> DataFrame:
    """``key, score`` = sum of weight / (k + rank) over lists with columns ``key, rank``."""
    parts = [d.select(key, (w / (k + F.col("rank"))).alias("s")) for d, w in lists]
    return reduce(lambda a, b: a.union(b), parts).groupBy(key).agg(F.sum("s").alias("score")).filter(F.col("score") >= least)


def adaptive_weights(query: str) -> tuple[float, float]:
    """Weights of vector and keyword lists: short queries lean on words, long ones on vectors."""
    n = len(query.split())
    return (0.5, 1.5) if n <= 2 else (1.5, 0.5) if n >= 6 else (1.0, 1.0)


def mmr(df: DataFrame, group: str, key: str, score: str, vector: str, k: int, lam: float = 0.7, most: int = 1000) -> DataFrame:
    """``group, key, place``: greedy choice by lam * score - (1 - lam) * largest cosine to what is chosen.

    Groups are result lists; a list longer than ``most`` is refused rather than cut.
    """

    def pick(pdf):
        if len(pdf) > most:
            raise ValueError(f"a result list has more than {most} entries")
        pdf = pdf.sort_values([score, key], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(pdf[vector].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        sims, s, left, out = v @ v.T, pdf[score].to_numpy(), list(range(len(pdf))), []
        while left and len(out) < k:
            best = max(left, key=lambda i: (lam * s[i] - (1 - lam) * max((sims[i, j] for j in out), default=0.0), -i))
            out.append(best)
            left.remove(best)
        res = pdf.iloc[out][[group, key]].copy()
        res["place"] = np.arange(1, len(out) + 1)
        return res

    kinds = dict(df.dtypes)
    return df.select(group, key, score, vector).groupBy(group).applyInPandas(pick, f"{group} {kinds[group]}, {key} {kinds[key]}, place int")


def hybrid(texts: DataFrame, vectors: DataFrame, key: str, text: str, vector: str, query: str, embedded: list[float], k: int = 10, pool: int = 200) -> DataFrame:
    """``key, score`` by rank fusion of keyword and vector results (``pool`` of each), weighted by the query's length.

    A key that only one list has still counts. Either table may be empty; a query of stop words only leaves the vectors.
    """
    wv, wb = adaptive_weights(query)
    v = nearest(vectors, key, vector, embedded, pool)
    b = bm25(texts, key, text, query).orderBy(F.desc("score"), key).limit(pool)

    def ranked(d: DataFrame) -> DataFrame:
        return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key))).select(key, "rank")  # at most ``pool`` rows

    return rrf([(ranked(v), wv), (ranked(b), wb)], key, least=0.0).orderBy(F.desc("score"), key).limit(k)


def recommend(df: DataFrame, key: str, vector: str, liked: list, disliked: list, k: int = 10) -> DataFrame:
    """``key, score``: rows most similar to the mean of the liked vectors less that of the disliked, which are left out themselves."""
    side = lambda ids, sign: df.filter(F.col(key).isin(*ids)).select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg((sign * F.avg("x")).alias("x"))
    parts = [side(ids, s) for ids, s in ((liked, 1.0), (disliked, -1.0)) if ids]
    target = {r.i: r.x for r in reduce(lambda a, b: a.union(b), parts).groupBy("i").agg(F.sum("x").alias("x")).collect()}  # one number a dimension
    if not target:
        return df.sparkSession.createDataFrame([], f"{key} {dict(df.dtypes)[key]}, score double")
    q = [target[i] for i in sorted(target)]
    return nearest(df.filter(~F.col(key).isin(*liked, *disliked)), key, vector, q, k, least=-1.0)


def best_per_group(df: DataFrame, key: str, vector: str, group: str, query: list[float], per: int = 3) -> DataFrame:
    """``group, key, score``: the ``per`` most similar rows of each group."""
    d = df.filter(F.size(vector) == len(query)).select(group, key, similarity(F.col(vector), query, "cosine").alias("score")).filter("score is not null")
    w = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return d.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per).drop("r")


def kmeans(df: DataFrame, key: str, vector: str, k: int | None = None, seed: int = 1) -> DataFrame:
    """``key, cluster``: parallel k-means; without k, the root of half the rows between 10 and 1000."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = df.filter(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    if k is None:
        n = d.count()
        k = min(max(10, min(1000, int((n / 2) ** 0.5))), max(n, 1))
    return KMeans(k=k, seed=seed, maxIter=20).fit(d).transform(d).select(key, F.col("prediction").alias("cluster"))


def retrieval_measures(ranked: DataFrame, relevant: DataFrame, query: str = "query_id", item: str = "item") -> DataFrame:
    """Per query: precision@5, recall@10, reciprocal rank, average precision, ndcg@10, hit.

    ``ranked`` has query, item, rank (from 1); ``relevant`` query, item and perhaps grade. Queries
    without relevant items give no row; those without results count 0.
    """
    rel = relevant.withColumn("grade", F.col("grade") if "grade" in relevant.columns else F.lit(1.0)).select(query, item, "grade").distinct()
    per = rel.groupBy(query).agg(F.count(F.lit(1)).alias("n_rel"), F.reverse(F.array_sort(F.collect_list("grade"))).alias("gs"))
    ideal = F.aggregate(F.transform(F.slice("gs", 1, 10), lambda g, i: g / F.log2(i + 2)), F.lit(0.0), lambda s, x: s + x)
    hits = ranked.select(query, item, "rank").join(rel, [query, item])
    w = Window.partitionBy(query).orderBy("rank")
    hits = hits.withColumn("nth", F.row_number().over(w))
    agg = hits.groupBy(query).agg(
        F.count_if(F.col("rank") <= 5).alias("in5"),
        F.count_if(F.col("rank") <= 10).alias("in10"),
        (1 / F.min("rank")).alias("rr"),
        F.sum(F.col("nth") / F.col("rank")).alias("ap"),
        F.sum(F.when(F.col("rank") <= 10, F.col("grade") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return per.join(agg, query, "left").select(
        query,
        z(F.col("in5") / 5).alias("p5"),
        z(F.col("in10") / F.col("n_rel")).alias("r10"),
        z(F.col("rr")).alias("mrr"),
        z(F.col("ap") / F.col("n_rel")).alias("ap"),
        z(F.try_divide("dcg", ideal)).alias("ndcg10"),
        F.coalesce(F.col("in10") > 0, F.lit(False)).alias("hit"),
    )
