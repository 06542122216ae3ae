"""A stored vector index: a coarse quantiser, a folder for each of its cells, and searches that read the nearest cells.

The quantiser is trained by spherical k-means on a bounded sample of the vectors, chosen by a hash of the id; every vector is then
assigned to its nearest centre. How many cells a search reads is measured when the index is built: as many as a sample of queries,
compared with brute force over all rows, needs for the wanted recall. Distances are exact; reading all cells is an exact search.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import retrieval
from evidentia.sources import versions
from evidentia.sources.sinks import materialize

#: Vectors of the training sample, cells at most (their centres are broadcast), rounds of k-means, queries that measure recall, their
#: neighbours, and the recall that is asked of them.
SAMPLE, MOST_CELLS, ROUNDS, QUERIES, NEIGHBOURS, RECALL = 20_000, 4096, 8, 64, 40, 0.95


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means on unit vectors; the first centres are spread over the sample's order, an empty cell keeps its centre."""
    now = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        near = (sample @ now.T).argmax(axis=1)
        total = np.zeros_like(now)
        np.add.at(total, near, sample)
        held = np.bincount(near, minlength=cells) > 0
        now = np.where(held[:, None], _unit(total), now)
    return now


def _sampled(usable: DataFrame, n: int, size: int, salt: int) -> DataFrame:
    """About size rows by a hash threshold, so that no more than that many leave their tasks."""
    share = min(1.0, size / max(n, 1))
    return usable.where(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)


def build(vectors: DataFrame, folder: str, cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> dict[str, float]:
    """Write an index of (id, vector, ...), with its further columns, as a new version: {"cells": n, "probes": n, "recall": measured}.

    Null, zero and non-finite vectors are left out. cells is about the root of the number of vectors if not given. ids needn't be
    distinct.
    """
    spark = vectors.sparkSession
    real = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    usable = vectors.where(real)
    n = usable.count()
    picked = [r[0] for r in _sampled(usable, n, sample, 1).orderBy(F.xxhash64("id", F.lit(1)), "id").select("vector").limit(sample).collect()]
    asked = [r[0] for r in _sampled(usable, n, QUERIES, 2).orderBy("id").select("vector").limit(QUERIES).collect()] if n else []
    trained = _unit(np.array(picked, np.float64)) if picked else np.zeros((1, 1))
    k = max(1, min(cells or round(n**0.5), MOST_CELLS, len(trained)))
    middle = centres(trained, k)
    near = spark.sparkContext.broadcast(middle)  # MOST_CELLS vectors at most

    def assigned(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows = np.array(part.column(part.schema.names.index("vector")).to_pylist(), np.float64).reshape(part.num_rows, -1)
                cell = (_unit(rows) @ near.value.T).argmax(axis=1) if part.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32())], [*part.schema.names, "cell"])

    path = f"{folder}/cells-{uuid.uuid4().hex}"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema), "cell int"])
    dealt = usable.mapInArrow(assigned, schema)
    dealt.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(path)
    probes, measured = _calibrated(spark.read.schema(schema).parquet(path), middle, asked, recall) if asked else (1, 1.0)
    # the centres go beside the cells; a version names both
    spark.createDataFrame([(i, list(map(float, c))) for i, c in enumerate(middle)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}-centres")
    versions.commit(spark, folder, versions.latest(spark, folder), {"path": path, "schema": schema, "n": n, "cells": k, "probes": probes, "recall": measured})
    return {"cells": k, "probes": probes, "recall": measured}


def _calibrated(stored: DataFrame, middle: np.ndarray, asked: list, recall: float) -> tuple[int, float]:
    """The fewest nearest cells that hold the wanted share of the neighbours of the asked vectors, found over all rows; and the share."""
    queries = _unit(np.array(asked, np.float64))

    def best(batches):
        top: list[np.ndarray] = []
        for batch in batches:
            rows = _unit(np.array(batch.column(0).to_pylist(), np.float64).reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, queries.shape[1]))
            cell = np.array(batch.column(1).to_pylist(), np.int64)
            close = queries @ rows.T
            for q in range(len(queries)):
                order = np.argsort(-close[q], kind="stable")[:NEIGHBOURS]
                now = np.column_stack([close[q][order], cell[order]])
                now = now if len(top) <= q else np.concatenate([top[q], now])
                now = now[np.argsort(-now[:, 0], kind="stable")[:NEIGHBOURS]]
                top[q : q + 1] = [now]
        for q, rows in enumerate(top):
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(rows), pa.int32()), pa.array(rows[:, 0]), pa.array(rows[:, 1].astype(np.int32))], ["q", "close", "cell"])

    found = stored.select("vector", "cell").mapInArrow(best, "q int, close double, cell int")
    ranked = found.groupBy("q").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("close", "cell")))), 1, NEIGHBOURS).alias("top")).collect()  # NEIGHBOURS rows a task and query
    places = np.argsort(np.argsort(-(queries @ middle.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort([places[r["q"]][x["cell"]] + 1 for r in ranked for x in r["top"]])
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
    return probes, float((needed <= probes).mean())


def search(spark: SparkSession, folder: str, probe: Sequence[float], probes: int | None = None, exact: bool = False, scope: DataFrame | None = None) -> DataFrame:
    """(id, ..., distance) of the rows in the cells nearest to probe, in probes of them (as many as were measured if not given) or, if
    exact is set, in all. scope, if given, has the ids that may be found; a zero probe finds nothing."""
    state = versions.latest(spark, folder).state
    rows = spark.read.schema(state["schema"]).parquet(state["path"])
    if not exact and state["n"]:  # an empty index has no centres
        known = spark.read.parquet(f"{state['path']}-centres").collect()  # MOST_CELLS at most
        close = np.array([r["centre"] for r in known]) @ np.asarray(probe, np.float64)
        cells = [known[i]["cell"] for i in np.argsort(-close, kind="stable")[: probes or state["probes"]]]
        rows = rows.where(F.col("cell").isin(cells))
    if scope is not None:
        rows = rows.join(scope.select("id").distinct(), "id", "left_semi")
    return rows.withColumn("distance", retrieval.cosine_distance(F.col("vector"), list(map(float, probe)))).where("distance IS NOT NULL").drop("vector", "cell")


def measured_recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the ids of truth that found has too."""
    n = truth.select("id").distinct()
    return n.join(materialize(found.select("id").distinct(), "found"), "id", "left_semi").count() / max(1, n.count())
