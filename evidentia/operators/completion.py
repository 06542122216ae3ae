"""Research completion: bounded rounds over tables, each of which works on what the last one opened.

A round runs the next open queries against a table of what they return, admits new papers up to its caps, reads them and those that are
worth another attempt, and notes what was done. What new papers ask for opens the queries of the next round. Rounds end early when
nothing is open or nothing was gained.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import review
from evidentia.sources.sinks import materialize


@dataclass(frozen=True)
class Limits:
    """Rounds, and what a round may do: queries, new papers, papers read again; and new papers in all."""

    rounds: int = 2
    queries: int = 6
    new: int = 8
    again: int = 8
    new_in_all: int = 60


@dataclass
class Research:
    """What a run knows. papers (id), profiles (id, error), audits (id, status, mode), planned and opens (ord, query and, of opens, the id
    whose admission asks for it), executed (query), requested (ord, id)."""

    papers: DataFrame
    profiles: DataFrame
    audits: DataFrame
    planned: DataFrame
    executed: DataFrame
    requested: DataFrame
    opens: DataFrame


def complete(given: Research, results: DataFrame, readable: DataFrame, limits: Limits | None = None) -> tuple[Research, DataFrame]:
    """The research after its rounds, and the log (round, action, what, n): search (with the number of records a query returned),
    admit, again, and, for each paper read, read or failed.

    results: (query, ord, id) has what each query returns, readable: (id) which papers can be read. A query runs once, a paper is
    read again once; a reading that fails doesn't take the place of an earlier profile. Bounded: a round's queries and papers are
    at most the limits' numbers. Empty tables give no log.
    """
    limits = limits or Limits()
    spark = given.papers.sparkSession
    papers, profiles, executed, planned = (materialize(x, "research") for x in (given.papers.select("id"), given.profiles.select("id", "error"), given.executed.select("query"), given.planned.select("ord", "query")))
    attempted = papers.limit(0)
    logs, admitted_in_all = [], 0
    for number in range(1, limits.rounds + 1):
        pending = materialize(review.pending_material(papers, profiles, given.audits), "pending")
        queries = materialize(review.next_queries(planned, executed, limits.queries), "queries")
        if pending.isEmpty() and queries.isEmpty():
            break
        got = results.join(F.broadcast(queries.select("query", F.col("ord").alias("asked"))), "query")  # limits.queries rows
        returned = queries.select("query").join(got.groupBy("query").agg(F.count("*").alias("n")), "query", "left")
        room = max(0, min(limits.new, limits.new_in_all - admitted_in_all))
        fresh = got.join(papers, "id", "left_anti").groupBy("id").agg(F.min(F.struct("asked", "ord")).alias("at"))
        found = materialize(fresh.orderBy("at", "id").limit(room).select("id"), "found")
        failed = profiles.groupBy("id").agg(F.bool_and(F.col("error").isNotNull()).alias("bad")).where("bad").select("id")
        again = materialize(review.retry_selection(papers.unionByName(found), given.requested, failed, pending.select("id"), attempted, limits.again).select("id"), "again")
        targets = found.unionByName(again).distinct()
        read = materialize(targets.join(readable.select("id").distinct().withColumn("ok", F.lit(True)), "id", "left").select("id", F.coalesce("ok", F.lit(False)).alias("ok")), "read")
        entry = lambda df, action, what, n: df.select(F.lit(number).alias("round"), F.lit(action).alias("action"), F.col(what).cast("string").alias("what"), n.cast("bigint").alias("n"))  # noqa: B023, E731
        one = F.lit(1)
        logs += [entry(returned, "search", "query", F.coalesce("n", F.lit(0))), entry(found, "admit", "id", one), entry(again, "again", "id", one), entry(read.where("ok"), "read", "id", one), entry(read.where("NOT ok"), "failed", "id", one)]
        # a good reading replaces what was there, a failed one only fills a gap
        good = read.where("ok").select("id", F.lit(None).cast("string").alias("error"))
        bad = read.where("NOT ok").select("id", F.lit("unreadable").alias("error")).join(profiles.select("id"), "id", "left_anti")
        profiles = materialize(profiles.join(good.select("id"), "id", "left_anti").unionByName(good).unionByName(bad), "research")
        papers, executed, attempted = materialize(papers.unionByName(found), "research"), materialize(executed.unionByName(queries.select("query")), "research"), materialize(attempted.unionByName(again), "research")
        asked = given.opens.join(F.broadcast(found), "id", "left_semi").select("ord", "query")
        planned = materialize(planned.unionByName(asked), "research")
        gained, tried = found.count(), again.count()
        admitted_in_all += gained
        if not gained and not tried:
            break
    log = spark.createDataFrame([], "round int, action string, what string, n bigint")
    for part in logs:
        log = log.unionByName(part)
    return Research(papers, profiles, given.audits, planned, executed, given.requested, given.opens), log


def still_open(research: Research) -> DataFrame:
    """(kind, what): the papers that are not read to the end and the queries that were not run."""
    pending = review.pending_material(research.papers, research.profiles, research.audits)
    queries = research.planned.where(F.trim("query") != "").select("query").distinct().join(research.executed, "query", "left_anti")
    return pending.select(F.col("reason").alias("kind"), F.col("id").cast("string").alias("what")).unionByName(queries.select(F.lit("query").alias("kind"), F.col("query").alias("what")))

