"""Structured Streaming forms of the event-log operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "events*.parquet") -> DataFrame:
    """Files of events as a stream; event time is a TIMESTAMP, as watermarks need."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n) per window; rows later than the watermark are dropped in append mode."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def fold(events: DataFrame) -> DataFrame:
    """(user_id, attempt, n_events, cursor), updated as rows of (user_id, event_id, attempt) come.

    A newer attempt resets a run, rows of an older one and rows at or before the cursor are ignored, so that a replay of the
    log changes nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempt, n, cursor = state.get if state.exists else (-1, 0, -1)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for event_id, own in zip(rows["event_id"].tolist(), rows["attempt"].tolist()):
            if own < attempt or event_id <= cursor:
                continue
            n = 1 if own > attempt else n + 1
            attempt, cursor = own, event_id
        state.update((attempt, n, cursor))
        yield pd.DataFrame({"user_id": [key[0]], "attempt": [attempt], "n_events": [n], "cursor": [cursor]})

    shape = "attempt bigint, n_events bigint, cursor bigint"
    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, " + shape, shape, "update", GroupStateTimeout.NoTimeout)
