import os

import pytest
from pyspark.sql import functions as F

from evidentia.streaming import events as S

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("event_id"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 37)).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("user_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"))
    rows.coalesce(1).write.parquet(str(tmp_path / "x"))
    part = next(p for p in os.listdir(tmp_path / "x") if p.endswith(".parquet"))
    os.makedirs(tmp_path / "in")
    os.rename(tmp_path / "x" / part, tmp_path / "in" / "events-1.parquet")
    return str(tmp_path / "in")


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows_equal_the_batch(spark, folder, tmp_path):
    got = run(S.window_counts(S.event_stream(spark, folder, SCHEMA)), "windows", "complete", tmp_path)
    batch = spark.read.schema(SCHEMA).parquet(folder).groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_fold_ignores_old_attempts_and_replays(spark, folder, tmp_path):
    stream = S.event_stream(spark, folder, SCHEMA).select("user_id", "event_id", F.floor(F.col("event_id") / 150).alias("attempt"))
    got = {r.user_id: (r.attempt, r.n_events, r.cursor) for r in run(S.fold(stream), "folded", "update", tmp_path).collect()}
    for u in range(7):
        own = [e for e in range(400) if e % 7 == u]
        assert got[u] == (2, sum(e >= 300 for e in own), max(own))


def test_deduplication(spark, folder, tmp_path):
    got = run(S.deduplicated(S.event_stream(spark, folder, SCHEMA)), "once", "append", tmp_path)
    assert got.count() == 400
