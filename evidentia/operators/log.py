"""Event-log and session operators over ordered rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.catalog import numbered

#: Legal moves of the job state machine, as fixed values.
TRANSITIONS = {
    "queued": ("running", "cancelled"),
    "running": ("done", "failed", "cancel_requested", "interrupted"),
    "cancel_requested": ("cancelled", "done", "failed"),
    "interrupted": ("queued",),
}


def islands(rows: DataFrame, key: str, order: str, starts: Column, name: str) -> DataFrame:
    """Number the runs of each key: a row that starts one opens the next number; rows before the first have 0."""
    running = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(starts.cast("int")).over(running).cast("bigint"))


def budget_prefix(rows: DataFrame, key: str, newest: Column, size: Column, cap: int) -> DataFrame:
    """Newest rows of each key until cap, with take: how much of a row fits; the row that crosses the cap is cut."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(key).orderBy(newest).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).where(F.col("before") < cap).withColumn("take", F.least(size, F.lit(cap) - F.col("before")).cast("bigint")).drop("before")


def fence(events: DataFrame, key: str, token: Column) -> DataFrame:
    """Events whose token is the largest that their key has shown so far: a stale writer's rows go."""
    seen = F.max(token).over(Window.partitionBy(key).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("__seen", seen).where(token == F.col("__seen")).drop("__seen")


def replay_page(events: DataFrame, after: int, size: int = 200) -> DataFrame:
    """The next rows after a cursor; the filter reaches the scan."""
    return events.where(F.col("event_id") > after).orderBy("event_id").limit(size)


def illegal_moves(states: DataFrame, key: str, order: str, state: Column) -> DataFrame:
    """(key, order, before, state) of moves that the state machine forbids."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(order))
    legal = F.lit(False)
    for a, to in TRANSITIONS.items():
        legal = legal | ((F.col("before") == a) & F.col("state").isin(*to))
    return states.select(key, order, before.alias("before"), state.alias("state")).where(F.col("before").isNotNull() & (F.col("before") != F.col("state")) & ~legal)


def quantiles(rows: DataFrame, key: str, value: str, shares: Mapping[str, float]) -> DataFrame:
    """(key, a column for each share): exact quantiles of the values of each key, interpolated between neighbours.

    Values are numbered by ranges, so that a key with many of them is no task's burden; nulls don't count.
    """
    ranked = numbered(rows.where(F.col(value).isNotNull()).select(key, value), key, value, "place")
    sizes = ranked.groupBy(F.col(key).alias("of")).agg(F.max("place").alias("last"))
    at = {n: p * (F.col("last") - 1) + 1 for n, p in shares.items()}
    near = ranked.join(sizes, F.col(key).eqNullSafe(F.col("of"))).where(reduce(Column.__or__, [F.abs(F.col("place") - x) < 1 for x in at.values()]))
    # the two neighbours of a position, each by its nearness; they sum up to 1
    part = lambda x: F.sum(F.when(F.abs(F.col("place") - x) < 1, F.col(value) * (1 - F.abs(F.col("place") - x))))
    return near.groupBy(key).agg(*[part(x).alias(n) for n, x in at.items()])
