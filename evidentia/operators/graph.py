"""Connected components over an edge table, as joins and min-aggregations, and joins on keys of which some are frequent."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.sources.sinks import materialize

def spanning_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest (member, smallest member) pairs that connect what the given pairs connect."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hooking and pointer jumping on arrays
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = np.minimum(new, new[new])
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches):
    """Each block of edges becomes a spanning forest of itself before anything is shuffled."""
    for pdf in batches:
        if len(pdf):
            u, v = spanning_pairs(pdf["u"].to_numpy(), pdf["v"].to_numpy())
            yield pd.DataFrame({"u": u, "v": v})


def _settle(batches):
    """(node, component_id) of all edges of one task."""
    parts = [pdf for pdf in batches if len(pdf)]
    if parts:
        node, low = spanning_pairs(*(np.concatenate([pdf[x].to_numpy() for pdf in parts]) for x in ("u", "v")))
        yield pd.DataFrame({"node": node, "component_id": low})


def hot_join(rows: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """rows joined left to one, which has a single row a key, where some keys may have a large share of rows.

    one is written first. So both sides of the join are plain shuffles, or one is broadcast if it proves small, and Spark splits
    the rows of a frequent key over tasks; an aggregation right below the join would keep them together.
    """
    return rows.join(materialize(one, "one"), key, "left")


def components(edges: DataFrame, max_rounds: int = 60, alone: int = 0) -> DataFrame:
    """(u, v) bigint edges -> (node, component_id): the smallest node reachable, for every node that reaches a smaller one.

    Up to `alone` edges are settled in one task, where rounds over all tasks would mostly wait for each other.

    Alternates large-star and small-star steps. A round shuffles rows on the order of the edges, each step a min-aggregation
    (combined before the shuffle) and one join, in which large stars are split. Each step is written as a table, so that the next
    one is planned on its true size. Rounds end when no edge changes; their number grows with the logarithm of the longest path,
    and max_rounds guards against a fault only.
    """
    contracted = edges.select("u", "v").where("u <> v").mapInPandas(_contract, "u bigint, v bigint")
    now = materialize(contracted.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if alone and now.count() <= alone:
        return materialize(now.coalesce(1).mapInPandas(_settle, "node bigint, component_id bigint"), "components")
    state = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(hot_join(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = hot_join(large, low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "edges")
        # a sum of edge hashes that wraps nowhere: decimal
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
