"""Sessions, access patterns, decay, and relationships suggested by use over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.temporal import fold_series

# Decay rates an hour by tier, importance by tier, weights of the three parts.
LAMBDA = {"episodic": 0.00412, "semantic": 0.000418, "procedural": 0.0000417}
IMPORTANCE = {"episodic": 0.3, "semantic": 0.6, "procedural": 0.9}
ARCHIVE = 0.05


def sessions(df: DataFrame, key: str, ts: str, gap_s: int = 300, most_s: int | None = None, bucket_s: int = 86_400) -> DataFrame:
    """Rows with ``session``: numbered from 1 in each key; a gap over ``gap_s`` begins a new one.

    Rows are ordered inside (key, day) only, and days are joined by their last time and their number of
    new sessions, so that a key with a third of all rows is spread over its days. Rows without a time are
    left out. With ``most_s``, a session is also cut into pieces of that length from its start.
    """
    day = Window.partitionBy(key, "_b")
    w = day.orderBy("_t")
    days = Window.partitionBy(key).orderBy("_b")
    d = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp"))).filter("_t is not null").withColumn("_b", F.floor(F.col("_t") / (bucket_s * 1_000_000)))
    d = d.withColumn("_prev", F.lag("_t").over(w))
    last = d.groupBy(key, "_b").agg(F.max("_t").alias("_m")).withColumn("_before", F.lag("_m").over(days)).drop("_m")
    on = lambda x: [d[key].eqNullSafe(x[key]), d["_b"] == x["_b"]]
    d = d.join(last, on(last)).drop(last[key], last["_b"])
    since = F.col("_t") - F.coalesce("_prev", "_before")
    d = d.withColumn("_new", (since.isNull() | (since > gap_s * 1_000_000)).cast("int")).drop("_prev", "_before")
    ahead = d.groupBy(key, "_b").agg(F.sum("_new").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    d = d.join(ahead, on(ahead)).drop(ahead[key], ahead["_b"])
    d = d.withColumn("session", F.col("_ahead") + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if most_s is not None:
        start = F.min("_t").over(Window.partitionBy(key, "session"))
        d = d.withColumn("_piece", F.floor((F.col("_t") - start) / (most_s * 1_000_000)))
        d = d.withColumn("session", F.dense_rank().over(Window.partitionBy(key).orderBy("session", "_piece"))).drop("_piece")
    return d.drop("_t", "_b", "_new", "_ahead")


def session_summary(df: DataFrame, key: str, ts: str, gap_s: int = 300) -> DataFrame:
    return sessions(df, key, ts, gap_s).groupBy(key, "session").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("started"), F.max(ts).alias("ended"))


def _peaks(df: DataFrame, key: str, part: Column, slots: int, scale: float, least: float, name: str) -> DataFrame:
    c = df.groupBy(key, part.alias("slot")).agg(F.count(F.lit(1)).alias("c"))
    p = c.groupBy(key).agg(F.sum("c").alias("total"), F.max("c").alias("most"), F.max_by("slot", F.struct("c", -F.col("slot"))).alias("slot"))
    conf = F.least(F.greatest((F.col("most") / (F.col("total") / slots) - 1) / scale, F.lit(0.0)), F.lit(1.0))
    return p.select(key, F.lit(name).alias("pattern"), "slot", conf.alias("confidence")).filter(F.col("confidence") >= least)


def daily_pattern(df: DataFrame, key: str, ts: str) -> DataFrame:
    return _peaks(df, key, F.hour(ts), 24, 3, 0.3, "daily")


def weekly_pattern(df: DataFrame, key: str, ts: str) -> DataFrame:
    return _peaks(df, key, F.weekday(ts), 7, 2, 0.4, "weekly")


def bursts(df: DataFrame, key: str, ts: str, window_s: int = 60, least: int = 5) -> DataFrame:
    """Each moment with ``least`` or more accesses in the last ``window_s`` seconds."""
    d = df.withColumn("_s", F.unix_timestamp(F.col(ts).cast("timestamp")))
    n = F.count(F.lit(1)).over(Window.partitionBy(key).orderBy("_s").rangeBetween(-window_s, 0))
    return d.withColumn("n", n).filter(F.col("n") >= least).select(key, ts, "n", F.least(F.col("n") / window_s / 10, F.lit(1.0)).alias("confidence"))


def co_access(df: DataFrame, session: str, item: str, ts: str, window_s: int = 30, least: int = 3) -> DataFrame:
    """``a < b, n, confidence`` for items met within ``window_s`` in one session at least ``least`` times.

    Times are put into buckets as long as the window; a row meets its own and the next bucket, so the
    range join is an equality join and no all-pairs step.
    """
    d = df.select(F.col(session).alias("s"), F.col(item).alias("i"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    d = d.withColumn("b", F.floor(F.col("t") / window_s))
    x = d.select("s", F.col("i").alias("i1"), F.col("t").alias("t1"), F.explode(F.array("b", F.col("b") + 1)).alias("b"), F.col("b").alias("own"))
    y = d.select("s", F.col("i").alias("i2"), F.col("t").alias("t2"), "b")
    p = x.join(y, ["s", "b"]).filter((F.abs(F.col("t1") - F.col("t2")) <= window_s) & (F.col("i1") != F.col("i2")) & ((F.col("b") > F.col("own")) | (F.col("i1") < F.col("i2"))))
    p = p.groupBy(F.least("i1", "i2").alias("a"), F.greatest("i1", "i2").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return p.filter(F.col("n") >= least).withColumn("confidence", F.least(F.col("n") / 10, F.lit(0.8)))


def transitive(edges: DataFrame, least: float = 0.5) -> DataFrame:
    """``a, c, confidence``: A to B to C with A other than C and a product of confidences of at least ``least``; the best way counts."""
    x, y = edges.alias("x"), edges.alias("y")
    p = x.join(y, F.col("x.dst") == F.col("y.src")).filter("x.src <> y.dst").select(F.col("x.src").alias("a"), F.col("y.dst").alias("c"), (F.col("x.confidence") * F.col("y.confidence")).alias("confidence"))
    return p.filter(F.col("confidence") >= least).groupBy("a", "c").agg(F.max("confidence").alias("confidence"))


def similarity_band(s: Column) -> Column:
    return F.when(s >= 0.95, 0.9).when(s >= 0.90, 0.7).when(s >= 0.85, 0.5).otherwise(0.3)


def decay_score(last_access: Column, now: Column, accesses: Column, tier: Column) -> Column:
    """0.4 e^(-lambda h) + 0.3 ln(1 + n) / ln 101 (at most 1) + 0.3 importance, held in 0..1."""
    hours = F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_access.cast("timestamp"))) / 3.6e9, F.lit(0.0))
    pick = lambda m: F.coalesce(F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])[F.lower(tier)], F.lit(m["semantic"]))
    often = F.least(F.ln(1 + F.greatest(accesses, F.lit(0))) / F.ln(F.lit(101.0)), F.lit(1.0))
    return F.least(F.greatest(0.4 * F.exp(-pick(LAMBDA) * hours) + 0.3 * often + 0.3 * pick(IMPORTANCE), F.lit(0.0)), F.lit(1.0))


def edge_decay(confidence: Column, active: Column, created: Column, auto: Column, now: Column) -> Column:
    """The confidence of a generated relationship after decay of 5 % a day; null where it would be deleted (under 0.3)."""
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(active.cast("timestamp"))) / 8.64e10
    young = F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp")) < 7 * 8.64e10
    new = confidence * F.pow(F.lit(0.95), F.greatest(days, F.lit(0.0)))
    return F.when(~F.coalesce(auto, F.lit(False)) | young, confidence).when(new >= 0.3, new)


def evidence(df: DataFrame, src: str, dst: str, label: str, session: str, score: str, least: int = 3, least_score: float = 0.5, least_sessions: int = 2) -> DataFrame:
    g = df.groupBy(src, dst, label).agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("total"), F.count_distinct(session).alias("sessions"))
    return g.filter((F.col("n") >= least) & (F.col("total") >= least_score) & (F.col("sessions") >= least_sessions))


def cooled(df: DataFrame, keys: list[str], ts: str, seconds: float) -> DataFrame:
    """Rows at least ``seconds`` after the last row of the same keys that was itself kept; the first is kept. Rows without a time are left out.

    A row that comes ``seconds`` after the one before it is kept whatever went before, so keys are cut there
    into runs that are gone through apart, in order, with one time in memory.
    """
    d = df.withColumn("_key", F.struct(*keys)).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    d = sessions(d, "_key", ts, seconds - 1e-6).withColumn("_run", F.xxhash64("_key", "session")).drop("_key")
    step = round(seconds * 1_000_000)

    def keep(batches):
        run = last = None
        for pdf in batches:
            take = []
            for r, t in zip(pdf["_run"], pdf["_us"], strict=True):
                if r != run or t - last >= step:
                    run, last = r, t
                    take.append(True)
                else:
                    take.append(False)
            yield pdf[take].drop(columns=["_run", "_us", "session"])

    return d.repartition("_run").sortWithinPartitions("_run", "_us").mapInPandas(keep, df.schema)


# Velocities beyond which a rate of access grows or decays, and a relationship becomes stronger or weaker.
GROWTH, EVOLVES, LEAST_SEEN = 0.05, 0.01, 3


def trend(velocity: Column) -> Column:
    """``pattern, confidence`` of a velocity: growing or decaying beyond ``GROWTH``, else null."""
    name = F.when(velocity > GROWTH, "growing").when(velocity < -GROWTH, "decaying")
    return F.when(name.isNotNull(), F.struct(name.alias("pattern"), F.least(F.abs(velocity) / 0.5, F.lit(1.0)).alias("confidence")))


def access_velocity(df: DataFrame, key: str, ts: str) -> DataFrame:
    """``key, n, velocity``: how the filtered time between accesses (seconds) changes an access, by the constant-velocity filter."""
    w = Window.partitionBy(key).orderBy(ts)
    t = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    d = df.filter(F.col(ts).isNotNull()).select(key, F.col(ts).alias("_o"), (t - F.lag(t).over(w.orderBy(ts))).alias("_gap")).filter("_gap is not null")
    f = fold_series(d, key, "_o", "_gap", "velocity")
    return f.select(key, F.col("n").cast("bigint").alias("n"), f["state"]["vel"].alias("velocity"))


def hot_and_cold(df: DataFrame, key: str, ts: str, k: int = 10) -> DataFrame:
    """``side, key, velocity, place``: the ``k`` keys of largest positive velocity (hot) and of most negative (cold), the lesser key first of equals."""
    v = access_velocity(df, key, ts).select(key, "velocity")
    hot = v.filter("velocity > 0").orderBy(F.desc("velocity"), key).limit(k).withColumn("side", F.lit("hot"))
    cold = v.filter("velocity < 0").orderBy("velocity", key).limit(k).withColumn("side", F.lit("cold"))
    place = F.row_number().over(Window.partitionBy("side").orderBy(F.desc(F.abs("velocity")), key))  # at most k rows a side
    return hot.union(cold).select("side", key, "velocity", place.alias("place"))


def evolution(df: DataFrame, src: str, dst: str, weight: str, ts: str, steps: int = 5) -> DataFrame:
    """``a, b, n, direction, velocity, strength, predicted, confidence`` of each undirected pair by its weights in order of time.

    The direction is unknown under ``LEAST_SEEN`` observations. Rows with a null are left out.
    """
    d = df.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"), F.col(ts).alias("_o"), F.col(weight).cast("double").alias("_w")).dropna()
    d = d.select(F.struct("a", "b").alias("_pair"), F.struct("_o", "_w").alias("_o"), "_w")
    f = fold_series(d, "_pair", "_o", "_w", "velocity")
    v, n = f["state"]["vel"], F.col("n").cast("bigint")
    direction = F.when(n < LEAST_SEEN, "unknown").when(v > EVOLVES, "strengthening").when(v < -EVOLVES, "weakening").otherwise("stable")
    return f.select("_pair.a", "_pair.b", n.alias("n"), direction.alias("direction"), v.alias("velocity"), f["state"]["pos"].alias("strength"), (f["state"]["pos"] + v * steps).alias("predicted"), (n / (n + 10)).alias("confidence"))


def next_access(df: DataFrame, key: str, ts: str) -> DataFrame:
    """``key, n, mean_gap_s, predicted, confidence``: the mean gap, held between a second and 30 days, after the last access."""
    s = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), ((F.max(s) - F.min(s)) / F.greatest(F.count(F.lit(1)) - 1, F.lit(1))).alias("mean_gap_s"), F.max(s).alias("_last"))
    held = F.least(F.greatest("mean_gap_s", F.lit(1.0)), F.lit(2_592_000.0))
    return g.select(key, "n", "mean_gap_s", F.timestamp_seconds(F.col("_last") + held).alias("predicted"), (F.col("n") / (F.col("n") + 10)).alias("confidence"))


def load_by_bucket(df: DataFrame, ts: str, seconds: int = 300) -> DataFrame:
    """``bucket, n, rate`` with the z-score of each bucket's count among all buckets."""
    b = df.groupBy(F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("bucket"), "n", (F.col("n") / seconds).alias("rate"))
    lim = b.agg(F.avg("n").alias("m"), F.stddev_pop("n").alias("sd"))
    return b.crossJoin(F.broadcast(lim)).select("bucket", "n", "rate", F.try_divide(F.col("n") - F.col("m"), F.col("sd")).alias("z"))


def retained(df: DataFrame, created: str, kind: str, policies: dict[str, int], now: Column, held: Column | None = None) -> DataFrame:
    """Rows that their kind's policy (days) hasn't yet expired, or that are held."""
    days = F.create_map(*[x for k, v in policies.items() for x in (F.lit(k), F.lit(v))])[F.col(kind)]
    old = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(created).cast("timestamp"))) / 8.64e10
    keep = days.isNull() | (old <= days) | F.col(created).isNull()
    return df.filter(keep if held is None else keep | F.coalesce(held, F.lit(False)))
