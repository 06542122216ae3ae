"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its NEAREST reference points of PIVOTS, in the order of nearness. Pairs that share SHARED of them meet
in the inverted list of each shared combination of that many pivots; the pair counts only in the list of its lowest shared
pivots, so that it counts once. In a list, all rows of which lie in one task, the cosines are verified by blocks, in double
precision; a list of over BLOCK vectors is dealt over tasks by pairs of its blocks. What leaves a list is a row per linked
vector (its number of links and the lowest vector it is linked with, directly or not), never the pairs. Equal vectors of a
label are one class, with a multiplicity.

The reference points are vectors of the smallest hashes (SAMPLE rows at most are fetched), one of each tight group, filled up by
seeded directions. Pairs at a cosine of just 0.98 are found with a probability of 0.995 (64 random dimensions), nearer ones more.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import materialize, pick, table
from evidentia.operators.graph import components, spanning_pairs

LEAST = 0.98
PIVOTS = 256
NEAREST = 6
SHARED = 3
BLOCK = 2048
SAMPLE = 2048
#: Reference points of one tight group would be ranked by noise, so one stands for it.
SPREAD = 0.8
SEED = 11


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def reference_points(vectors: list[list[float]], dim: int, n: int = PIVOTS) -> np.ndarray:
    """The first vectors that lie at a cosine of SPREAD or less to all chosen before, then seeded directions."""
    chosen = np.zeros((0, dim))
    for x in _unit(np.array(vectors, np.float64).reshape(-1, dim)) if vectors else []:
        if len(chosen) < n and not (chosen @ x > SPREAD).any():
            chosen = np.concatenate([chosen, x[None]])
    return np.concatenate([chosen, _unit(np.random.default_rng([SEED, dim]).standard_normal((n - len(chosen), dim)))]) if len(chosen) < n else chosen


def nearest(unit: np.ndarray, points: np.ndarray, k: int = NEAREST) -> np.ndarray:
    """The k nearest reference points of each vector, nearest first; ties by number."""
    return np.argsort(-(unit @ points.T), axis=1, kind="stable")[:, :k]


def _describe(batches, points: dict[int, np.ndarray]):
    combos = np.array(list(combinations(range(NEAREST), SHARED)))
    for batch in batches:
        dims = batch.column(1).to_numpy()
        flat, ends = batch.column(2).flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
        near = np.zeros((len(dims), NEAREST), np.int32)
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            own = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
            near[rows] = nearest(_unit(own), points[dim] if dim in points else reference_points([], dim))
        ranked = np.sort(near, axis=1)
        keys = ranked[:, combos]
        keys = (keys[:, :, 0] * PIVOTS + keys[:, :, 1]) * PIVOTS + keys[:, :, 2]
        lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.int32).ravel()), x.shape[1]).cast(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(near), lists(keys)], ["node", "near", "keys"])


def _linked(x: np.ndarray, near: np.ndarray, node: np.ndarray, copies: np.ndarray, key: int, i: np.ndarray, p: int, q: int, least: float):
    """Links within block p of one list, or between its blocks p and q, that count here."""
    upto = key % PIVOTS + 1
    has = np.zeros((len(x), PIVOTS), np.float32)
    np.put_along_axis(has, near, 1, axis=1)
    has, unit = has[:, :upto], _unit(x)
    a, b = np.flatnonzero(i == p), np.flatnonzero(i == q)
    out = []
    for at in range(0, len(a), BLOCK):
        rows = a[at : at + BLOCK]
        link = (unit[rows] @ unit[b].T >= least) & (has[rows] @ has[b].T == SHARED)
        link &= rows[:, None] < b if p == q else True
        u, v = np.nonzero(link)
        if len(u):
            out.append((rows[u], b[v]))
    if not out:
        return None
    u, v = (np.concatenate(x) for x in zip(*out))
    n = np.bincount(u, copies[v], len(x)) + np.bincount(v, copies[u], len(x))
    member, low = spanning_pairs(node[u], node[v])
    order = np.argsort(node)
    root = node.copy()
    root[order[np.searchsorted(node, member, sorter=order)]] = low
    hit = np.flatnonzero(n)
    return node[hit], root[hit], n[hit].astype(np.int64)


def _verify(batches, least: float):
    """Rows come sorted by list; those of one are held, two blocks at most."""
    names = ["node", "root", "n"]
    key, held = None, []

    def flush():
        x, near, node, copies, i = (np.concatenate(c) for c in zip(*held))
        return _linked(x, near, node, copies, *key[2:3], i, *key[3:], least) if len(node) > 1 else None

    def made(found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        keys = np.column_stack([cols[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("label", "dim", "key", "p", "q")])
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
        flat, ends = cols["embedding"].flatten().to_numpy(zero_copy_only=False), np.cumsum(keys[:, 1])
        near = cols["near"].flatten().to_numpy().reshape(len(keys), NEAREST).astype(np.int64)
        node, copies, i = (cols[n].to_numpy() for n in ("node", "copies", "i"))
        found = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            now = tuple(keys[a].tolist())
            if now != key:
                if held and (got := flush()) is not None:
                    found.append(got)
                key, held = now, []
            if b - a > 1 or a == 0 or b == len(keys):
                dim = now[1]
                held.append((flat[ends[a] - dim : ends[b - 1]].reshape(-1, dim), near[a:b], node[a:b], copies[a:b], i[a:b]))
        if found:
            yield made(found)
    if held and (got := flush()) is not None:
        yield made([got])


def near_duplicates(vectors: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id bigint, embedding array<float or double>, label int).

    Rows link if their labels are equal and their cosine is least or more; equal vectors of a label link. Rows with a null
    label, id or vector, or whose vector is empty, zero or holds null or non-finite components, link with nothing: they have 0
    links and are their own component (null for a null id, which isn't kept). Vectors of different lengths don't link. Rows
    that share an id count one by one. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, "vec_id", "embedding", "label").withColumn("label", F.col("label").cast("bigint"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    sound = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    classes = rows.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()), "vectors")

    first = classes.select("dim", "embedding").orderBy(F.xxhash64("embedding"), "label").limit(SAMPLE).collect()
    by_dim: dict[int, list[list[float]]] = {}
    for r in first:
        by_dim.setdefault(r["dim"], []).append(r["embedding"])
    points = {dim: reference_points(x, dim) for dim, x in by_dim.items()}

    described = materialize(classes.select("node", "dim", "embedding").mapInArrow(lambda b: _describe(b, points), "node bigint, near array<int>, keys array<int>"), "pivots")
    lists = described.join(classes.select("node", "label", "dim"), "node").select("node", "label", "dim", F.explode("keys").alias("key"))
    large = lists.groupBy("label", "dim", "key").count().where(F.col("count") > block).select("label", "dim", "key", F.ceil(F.col("count") / block).cast("int").alias("n"))
    split = lists.join(large, ["label", "dim", "key"], "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("i", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = split.select("node", "label", "dim", "key", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j")).select("node", "label", "dim", "key", "i", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"))
    whole = described.select("node", "near").join(classes.select("node", "embedding", "copies"), "node")
    placed = dealt.join(whole, "node").repartition("label", "dim", "key", "p", "q").sortWithinPartitions("label", "dim", "key", "p", "q")
    found = placed.select("label", "dim", "key", "p", "q", "i", "node", "near", "copies", "embedding").mapInArrow(lambda b: _verify(b, least), "node bigint, root bigint, n bigint")
    found = materialize(found, "links")

    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    names = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    rooted = classes.select("node", "low", "label", "embedding", "copies").join(names, "node", "left").withColumn("root", F.coalesce("component_id", "node")).drop("component_id")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    known = rooted.join(lowest, "root").join(counts, "node", "left").select("label", "embedding", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    linked = rows.where("sound").join(known, ["label", "embedding"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs of a label and their components; the vectors of the tables that this is run on are few.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
c AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT p.u, c.root FROM c JOIN p ON p.w = c.id),
low AS (SELECT id, min(root) AS component_id FROM c GROUP BY id),
n AS (SELECT u AS id, count(*) AS n_links FROM p GROUP BY u)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       coalesce(coalesce(component_id, e.vec_id) = e.vec_id, false) AS kept
FROM embeddings e LEFT JOIN low ON low.id = e.vec_id LEFT JOIN n ON n.id = e.vec_id
"""
