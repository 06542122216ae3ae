"""Coalescing and idle timers: the stream against the batch form and a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.streaming import timers as T

DELTAS = "call bigint, seq bigint, ts timestamp, text string, ends boolean"


def deltas(n_calls=6):
    r = random.Random(7)
    rows = []
    for call in range(n_calls):
        ms = 1_700_000_000_000 + call * 11
        for k in range(r.randrange(3, 30)):
            ms += r.choice([0, 1, 10, 30, 49, 50, 51, 400])
            text = r.choice([None, "", "x" * 200, "ab", "c" * 16_384, "é"])
            rows.append((call, 100 * call + k, ms, text, False))
        if call % 2:
            rows.append((call, 100 * call + 99, ms + 5, r.choice([None, "end"]), True))
    return rows


def plain(rows):
    out, state = [], {}
    for call, seq, ms, text, ends in sorted(rows):
        s = state.setdefault(call, {"last": 0, "held": []})
        if text:
            s["held"].append((seq, text))
            if ms - s["last"] >= 50 or sum(len(t) for _, t in s["held"]) >= 16_384:
                out.append((call, s["held"][0][0], len(s["held"]), "".join(t for _, t in s["held"])))
                s["held"], s["last"] = [], ms
        if ends and s["held"]:
            out.append((call, s["held"][0][0], len(s["held"]), "".join(t for _, t in s["held"])))
            s["held"] = []
    return sorted(out + [(c, s["held"][0][0], len(s["held"]), "".join(t for _, t in s["held"])) for c, s in state.items() if s["held"]])


def frame(spark, rows):
    return spark.createDataFrame(rows, "call bigint, seq bigint, ms bigint, text string, ends boolean").select("call", "seq", F.timestamp_millis("ms").alias("ts"), "text", "ends")


@pytest.fixture
def store(spark):
    old = {k: spark.conf.get(k, None) for k in T.STORE}
    for k, v in T.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def run(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def files(spark, parts, folder, schema):
    """A stream of files, one for each micro-batch."""
    for k, rows in enumerate(parts):
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_batch_equals_a_plain_loop(spark):
    rows = deltas() + [(None, 1, 5, "a", None), (None, 2, 6, "b", None)]
    got = sorted((tuple(r) for r in T.coalesce(frame(spark, rows).repartition(3)).collect()), key=str)
    known = plain([r for r in rows if r[0] is not None])
    assert got == sorted([*known, (None, 1, 1, "a"), (None, 2, 1, "b")], key=str)
    assert T.coalesce(spark.createDataFrame([], DELTAS)).count() == 0


def test_the_stream_equals_the_batch(spark, store, tmp_path):
    rows = deltas()
    parts = [frame(spark, [r for r in rows if r[1] % 100 < 8]), frame(spark, [r for r in rows if r[1] % 100 >= 8])]
    far = frame(spark, [(777, 1, 1_700_000_900_000, "late mark", False)])  # moves the watermark on, so that open calls are given out
    stream = files(spark, [*parts, far, frame(spark, [(778, 1, 1_700_000_901_000, None, False)])], str(tmp_path / "in"), DELTAS)
    got = [r for r in run(T.coalesce_stream(stream), "pieces", tmp_path) if r[0] < 700]
    assert sorted(got) == plain(rows)


def test_an_idle_key_is_told_once(spark, store, tmp_path):
    base = 1_700_000_000_000
    beats = lambda *x: spark.createDataFrame([(k, base + ms) for k, ms in x], "key string, ms bigint").select("key", F.timestamp_millis("ms").alias("ts"))
    parts = [beats(("a", 0), ("b", 0), ("a", 3000)), beats(("a", 6000), ("b", 5500)), beats(("c", 60_000)), beats(("c", 61_000))]
    stream = files(spark, parts, str(tmp_path / "in"), "key string, ts timestamp")
    got = sorted((k, round(since.timestamp() * 1000) - base, n) for k, since, n in run(T.idle_stream(stream, 5000), "idle", tmp_path))
    assert got == [("a", 6000, 3), ("b", 0, 1), ("b", 5500, 1)]
    everything = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    batch = T.idle_spells(everything, 5000, F.timestamp_millis(F.lit(base + 61_000)))
    assert sorted((r.key, round(r.since.timestamp() * 1000) - base, r.beats) for r in batch.collect()) == got
