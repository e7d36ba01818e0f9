"""Structured Streaming twins: windowed counts with a watermark, duplicates dropped once, bad records set aside, and a bounded buffer per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quarry.registry import query
from quarry.sources.market import table


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums per time window and keys; with `late` a watermark, beyond which rows are dropped. The same for a table and a stream."""
    events = events.withWatermark(time, late) if late else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    g = events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    events = events.withWatermark(time, late) if late else events
    g = events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_seen(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once within the watermark: the idempotent intake of records that may be delivered again."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def with_dead_letters(write: Callable[[DataFrame], None], reject: Callable[[DataFrame], None], valid) -> Callable[[DataFrame, int], None]:
    """A batch handler that writes valid rows to one sink and the others, with the batch's number, to another."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            write(batch.where(valid))
            reject(batch.where(~valid | valid.isNull()).withColumn("batch", F.lit(number)))
        finally:
            batch.unpersist()

    return handle


class LastValues(StatefulProcessor):
    """Keeps the last `size` values of a key and emits their mean change for each new row."""

    def __init__(self, size: int = 128) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getListState("values", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = [v[0] for v in self.values.get()]
        out = []
        for frame in rows:
            for ts, v in zip(frame.sort_values("ts")["ts"], frame.sort_values("ts")["value"], strict=True):
                held = [*held, float(v)][-self.size :]
                out.append((key[0], ts, (held[-1] - held[0]) / max(1, len(held) - 1)))
        self.values.put([(v,) for v in held])
        yield pd.DataFrame(out, columns=["key", "ts", "forecast"])

    def close(self) -> None:
        pass


def online_forecast(events: DataFrame, key: str, size: int = 128) -> DataFrame:
    """Stream of (key, ts, forecast) with a bounded buffer of state per key."""
    keyed = events.select(F.col(key).cast("string").alias("key"), "ts", "value")
    return keyed.groupBy("key").transformWithStateInPandas(LastValues(size), "key string, ts timestamp, forecast double", "append", "none")


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("events_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _tumbling(spark, sf):
    return windowed(_events(spark, sf), "ts", ["event_type"], "6 hours").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("events_sliding", "WITH s AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR]) AS window_start FROM events) SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1, 2")
def _sliding(spark, sf):
    return windowed(_events(spark, sf), "ts", ["event_type"], "2 hours", "1 hour").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("events_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM i GROUP BY user_id, i")
def _sessions(spark, sf):
    s = sessions(_events(spark, sf), "ts", "user_id", "30 minutes")
    return s.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n")
