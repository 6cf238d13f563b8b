"""The same event operators over streams: windows with watermarks, sessions, and a stateful filter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, key, n, total`` by tumbling window; rows later than ``late`` are left out, closed windows leave the state."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def live_sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ends"), "n")


def live_filter(events: DataFrame, key: str = "user_id", ts: str = "ts", value: str = "value", q: float = 0.1, r: float = 88.0) -> DataFrame:
    """A scalar Kalman filter kept per key: state is four numbers, so it stays small however long the stream runs."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x, p, last, n = state.get if state.exists else (0.0, 30.0, 0.0, 0)
        for b in batches:
            for z in b.sort_values(ts)[value].dropna():
                if n == 0:
                    x = last = float(z)
                else:
                    x0, p0 = x + ((x - last) * 0.5 if n > 1 else 0.0), p + q
                    gain = p0 / (p0 + r)
                    last, x, p = x, x0 + gain * (float(z) - x0), (1 - gain) * p0
                n += 1
        state.update((x, p, last, n))
        yield pd.DataFrame({key: [k[0]], "x": [x], "n": [n]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, x double, n long", "x double, p double, last double, n long", "update", GroupStateTimeout.NoTimeout)


def upsert(events: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Writes each micro-batch's latest row a key to a folder of versions; replays of a batch overwrite the same folder."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
