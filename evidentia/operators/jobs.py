"""A queue of jobs as tables: submissions decided in order, and the next one to run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States that occupy a session, those that run, and how many jobs may wait or run.
ACTIVE, RUNNING, CAP = ("queued", "running", "cancel_requested"), ("running", "cancel_requested"), 20


def submit(jobs: DataFrame, requests: DataFrame, cap: int = CAP) -> DataFrame:
    """(ord, result) of requests (ord, session_id, request_key, payload) against jobs (session_id, request_key, payload, status).

    A key that is known gives the known job if session and payload are equal (existing), else idempotency_conflict. Of the other keys
    the first request of each counts: in order, while there is room (queue_full), one for each session that isn't busy (conflict), and
    the accepted are queued. Requests that repeat a key find it known if it was queued, and fare like the first if not. The rows that
    decide about room are cap at most.
    """
    known = jobs.groupBy("request_key").agg(F.first(F.struct("session_id", "payload")).alias("known"))
    first = requests.groupBy("request_key").agg(F.min(F.struct("ord", "session_id", "payload")).alias("first"))
    busy = jobs.where(F.col("status").isin(*ACTIVE)).select("session_id").distinct()
    fresh = first.join(known, "request_key", "left_anti").select("first.ord", "first.session_id")
    lead = fresh.groupBy("session_id").agg(F.min("ord").alias("ord")).join(busy, "session_id", "left_anti")
    room = jobs.where(F.col("status").isin(*ACTIVE)).agg(F.greatest(F.lit(cap) - F.count("*"), F.lit(0)).alias("room"))
    best = lead.orderBy("ord").limit(cap).withColumn("place", F.row_number().over(Window.orderBy("ord")))
    taken = best.crossJoin(F.broadcast(room)).where("place <= room").select(F.col("ord").alias("first_ord"), F.lit(True).alias("taken"))
    # behind the last one that fills the queue, it is full before a session is looked at
    last = taken.agg(F.count("*").alias("n"), F.max("first_ord").alias("last")).crossJoin(F.broadcast(room))
    judged = first.withColumn("first_ord", F.col("first.ord")).join(taken, "first_ord", "left")
    rows = requests.join(known, "request_key", "left").join(judged, "request_key").crossJoin(F.broadcast(last))
    original = F.coalesce("known", F.struct("first.session_id", "first.payload"))
    again = F.when(original == F.struct("session_id", "payload"), "existing").otherwise("idempotency_conflict")
    full = (F.col("n") >= F.col("room")) & (F.col("first_ord") > F.coalesce("last", F.lit(-1)))
    fate = F.when(F.col("taken") & (F.col("ord") == F.col("first_ord")), "queued").when(F.col("taken"), again).when(full, "queue_full").otherwise("conflict")
    return rows.select("ord", F.when(F.col("known").isNotNull(), again).otherwise(fate).alias("result"))


def claim(jobs: DataFrame) -> DataFrame:
    """The queued job of (ord, status, ...) that runs next: the oldest, if nothing runs."""
    busy = jobs.where(F.col("status").isin(*RUNNING)).limit(1).agg(F.count("*").alias("busy"))
    return jobs.where("status = 'queued'").orderBy("ord").limit(1).crossJoin(F.broadcast(busy)).where("busy = 0").drop("busy")
