"""One ranking from several scores on unlike scales.

Inside its query each score is replaced by its empirical percentile (ties share the
mean rank), mapped through the inverse normal distribution, and the weighted means
order the hits; a score's range has no say. A null score stands below any number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut

SCORES = ("vector_score", "bm25_score", "rrf_score")
HOT = 50_000

# Coefficients of the published fit.
FIT = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile of p in (0, 1), by Acklam's rational fit (absolute error about 1e-9)."""
    a, b, c, d = FIT

    def horner(cs: tuple[float, ...], x: Column) -> Column:
        return reduce(lambda s, k: s * x + F.lit(k), cs[1:], F.lit(cs[0]))

    low = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = horner(c, low) / horner(d, low)
    q = p - 0.5
    mid = q * horner(a, q * q) / horner(b, q * q)
    return F.when(p < 0.02425, tail).when(p > 1 - 0.02425, -tail).otherwise(mid)


def _hot_ranks(rows: DataFrame, group: list[str], score: str) -> DataFrame:
    """group, score, twice the mean rank — for groups too large for one task.

    Equal scores are counted first; the distinct ones are sorted by range over all tasks,
    numbered inside each task, and shifted by what the tasks before hold of their group.
    """
    c = rows.groupBy(*group, score).agg(F.count(F.lit(1)).alias("c"))
    c = cut(c.repartitionByRange(*group, F.col(score).asc_nulls_first()).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "part").orderBy(F.col(score).asc_nulls_first())
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = c.groupBy(*group, "part").agg(F.sum("c").alias("held")).withColumn("ahead", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    c = c.withColumn("upto", F.sum("c").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    on = reduce(lambda x, y: x & y, [F.col(f"c.{g}").eqNullSafe(F.col(f"p.{g}")) for g in [*group, "part"]])
    c = c.alias("c").join(parts.alias("p"), on).select("c.*", "p.ahead")
    return c.select(*group, score, (2 * (F.col("ahead") + F.col("upto")) - F.col("c") + 1).alias(f"twice_{score}"))


def percentile_ranks(hits: DataFrame, group: str = "query_id", scores: tuple[str, ...] = SCORES, hot: int = HOT) -> DataFrame:
    """``hits`` with ``n`` (rows of the group) and ``pct_<score>`` = (mean rank - 0.5) / n, nulls lowest.

    Groups of up to ``hot`` rows are ranked by windows after one shuffle. Larger groups are
    ranked by a sort over all tasks, with the same result.
    """
    by = Window.partitionBy(group)
    sizes = hits.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    big = sizes.filter(F.col("n") > hot).select(group)
    has_big = bool(big.take(1))
    small = hits.join(big, group, "left_anti") if has_big else hits
    n = F.count(F.lit(1)).over(by)
    out = small.withColumn("n", n)
    for s in scores:
        # rank counts from below, and the rank from above gives where the equals end: no further shuffle.
        up, down = F.rank().over(by.orderBy(F.col(s).asc_nulls_first())), F.rank().over(by.orderBy(F.col(s).desc_nulls_last()))
        out = out.withColumn(f"pct_{s}", (up + F.col("n") - down) / (2.0 * F.col("n")))
    if not has_big:
        return out
    rows = hits.join(big, group, "left_semi").join(sizes, group)
    for s in scores:
        r = _hot_ranks(rows.select(group, s), [group], s).withColumnRenamed(group, "_g").withColumnRenamed(s, "_s")
        rows = rows.join(r, F.col(group).eqNullSafe(F.col("_g")) & F.col(s).eqNullSafe(F.col("_s"))).drop("_g", "_s")
        rows = rows.withColumn(f"pct_{s}", (F.col(f"twice_{s}") - 1) / (2.0 * F.col("n"))).drop(f"twice_{s}")
    return out.unionByName(rows)


def fused_scores(hits: DataFrame, group: str = "query_id", scores: tuple[str, ...] = SCORES, weights: tuple[float, ...] | None = None, hot: int = HOT) -> DataFrame:
    """``percentile_ranks`` with ``fused``: the weighted mean of the inverse normal percentiles.

    A score that is the same for all hits of a group is at the median for each and so neutral;
    a group of one row gets 0. NaN counts as the largest number, as Spark orders it.
    """
    weights = weights or tuple(1.0 for _ in scores)
    out = percentile_ranks(hits, group, scores, hot)
    total = reduce(lambda x, y: x + y, [w * inverse_normal(F.col(f"pct_{s}")) for w, s in zip(weights, scores, strict=True)])
    return out.withColumn("fused", total / float(sum(weights)))


def majority_firsts(fused: DataFrame, group: str = "query_id", item: str = "node_id", scores: tuple[str, ...] = SCORES) -> DataFrame:
    """Of each group the item that beats every other in more than half of the scores, if there is one.

    The first of the fused order is tried first: it is counted against every hit of its group. Only
    groups in which it doesn't beat all are searched further, by a fold that keeps the winner of each
    meeting (the fused value decides an even one), inside blocks of 1024 or the root of the group's size
    and then across them, so that neither step takes in a large group whole: an item that beats all
    others wins each of its meetings, whatever the order. The one left is again counted against all.
    Works on the percentiles of ``fused_scores``.
    """
    need = len(scores) // 2 + 1
    pct = [f"pct_{s}" for s in scores]

    def wins(a: Column, b: Column) -> Column:
        return reduce(lambda x, y: x + y, [(a[p] > b[p]).cast("int") for p in pct])

    def best(xs: Column) -> Column:
        def meet(a: Column, b: Column) -> Column:
            x, y = wins(a, b), wins(b, a)
            return F.when(x >= need, a).when(y >= need, b).when(a["fused"] >= b["fused"], a).otherwise(b)

        return F.reduce(F.slice(xs, 2, F.size(xs)), F.element_at(xs, 1), meet)

    rows = cut(fused.select(group, "n", F.struct("fused", *pct, item).alias("h")))

    def beating(hits: DataFrame, tried: DataFrame) -> DataFrame:
        met = hits.join(tried, group).groupBy(group).agg(F.sum((wins(F.col("w"), F.col("h")) >= need).cast("bigint")).alias("beaten"), F.first("n").alias("n"), F.first("w").alias("w"))
        return met.select(group, (F.col("beaten") == F.col("n") - 1).alias("all_beaten"), F.col(f"w.{item}").alias(item))

    leads = cut(beating(rows, rows.groupBy(group).agg(F.max("h").alias("w"))))
    rest = rows.join(leads.filter("not all_beaten").select(group), group, "left_semi")
    rest = rest.withColumn("block", F.pmod(F.xxhash64(f"h.{item}"), F.ceil(F.col("n") / F.greatest(F.sqrt("n"), F.lit(1024.0)))))
    first = rest.groupBy(group, "block").agg(F.collect_list("h").alias("hs")).select(group, best(F.col("hs")).alias("h"))
    first = first.groupBy(group).agg(F.collect_list("h").alias("hs")).select(group, best(F.col("hs")).alias("w"))
    return leads.union(beating(rest, first)).filter("all_beaten").select(group, item)
