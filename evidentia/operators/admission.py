"""Admission to a bounded set in which a stronger newcomer takes the place of the weakest member that may go.

Newcomers are taken in order, so what happens to one depends on all before it. The state is small, though: of the members that may be
replaced, in the order in which they would go, the next one. A stretch of newcomers is summed up by where it leads from each state, the
sums are chained, and every stretch is then followed from its own start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.sources.sinks import materialize

#: The relevance of a record that has none.
UNKNOWN = 0.5
#: Members at most; the state, and what a stretch is summed up by, are as large as that.
MOST = 10_000


def summary(scores: np.ndarray, weakest: np.ndarray) -> np.ndarray:
    """The state after a stretch, from each state before it; weakest has the scores of those who may go, ascending."""
    now = np.arange(len(weakest) + 1)
    bar = np.append(weakest, np.inf)
    for s in scores[scores > bar[0]] if len(bar) else ():
        now += bar[now] < s
    return now


def admit(members: DataFrame, newcomers: DataFrame, cap: int) -> DataFrame:
    """(id, ord, replaced) of the newcomers that are admitted to at most cap members, in their order; replaced is the member that went.

    members: (id, ord, score, fixed); newcomers: (id, ord, score), ord telling them apart. While there is room everyone is
    admitted. Then a newcomer takes the place of the weakest member that is not fixed (of equal ones the first by ord), if it is
    stronger; newcomers of the same call are not replaced. A null score counts as UNKNOWN. cap is MOST at most.
    """
    if cap > MOST:
        raise ValueError(f"{cap} members, {MOST} at most")
    kind = newcomers.schema["id"].dataType
    own = members.select("id", "ord", F.coalesce("score", F.lit(UNKNOWN)).alias("score"), F.coalesce("fixed", F.lit(False)).alias("fixed"))
    n = own.count()
    if n > MOST:
        raise ValueError(f"{n} members, {MOST} at most")
    goes = own.where("NOT fixed").orderBy("score", "ord").collect()  # MOST at most
    weakest = np.array([r["score"] for r in goes], np.float64)
    names = [r["id"] for r in goes]
    room = max(0, cap - n)
    queue = newcomers.select("id", "ord", F.coalesce("score", F.lit(UNKNOWN)).cast("double").alias("score"))
    first = queue.orderBy("ord").limit(room).select("id", "ord", F.lit(None).cast(members.schema["id"].dataType).alias("replaced"))
    last = first.agg(F.max("ord"), F.count("*")).first() if room else (None, 0)
    if last[1] < room or not names:
        return first
    rest = queue.where(F.col("ord") > last[0]) if room else queue
    ranged = materialize(rest.repartitionByRange("ord").withColumn("part", F.spark_partition_id()), "newcomers")

    def stretches(batches) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
        """Rows of one part after the other; a part's rows may come in several batches."""
        for batch in batches:
            parts = np.asarray(batch.column(3))
            for a, b in zip(edges := [0, *(np.flatnonzero(np.diff(parts)) + 1), len(parts)], edges[1:]):
                if b > a:
                    yield int(parts[a]), batch.slice(a, b - a)

    def summed(batches):
        sums: dict[int, np.ndarray] = {}
        for part, rows in stretches(batches):
            then = summary(np.asarray(rows.column(2)), weakest)
            sums[part] = then[sums[part]] if part in sums else then
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], ["part", "leads"])

    ordered = lambda: ranged.repartition("part").sortWithinPartitions("part", "ord").select("id", "ord", "score", "part")
    leads = ordered().mapInArrow(summed, "part int, leads array<bigint>").orderBy("part").collect()  # a row a range
    start, state = {}, 0
    for r in leads:
        start[r["part"]], state = state, r["leads"][state]
    gone = to_arrow_type(members.schema["id"].dataType)

    def followed(batches):
        now: dict[int, int] = {}
        for part, rows in stretches(batches):
            at = now.get(part, start[part])
            taken, replaced = [], []
            for k, s in enumerate(np.asarray(rows.column(2)).tolist()):
                if at < len(weakest) and s > weakest[at]:
                    taken.append(k)
                    replaced.append(names[at])
                    at += 1
            now[part] = at
            keep = pa.array(taken, pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(keep), rows.column(1).take(keep), pa.array(replaced, gone)], ["id", "ord", "replaced"])

    schema = f"id {kind.simpleString()}, ord {newcomers.schema['ord'].dataType.simpleString()}, replaced {members.schema['id'].dataType.simpleString()}"
    return first.unionByName(ordered().mapInArrow(followed, schema))


def admitted_set(members: DataFrame, admitted: DataFrame) -> DataFrame:
    """(id) of the members that stay and of the admitted."""
    return members.select("id").join(admitted.where("replaced IS NOT NULL").select(F.col("replaced").alias("id")), "id", "left_anti").unionByName(admitted.select("id"))

