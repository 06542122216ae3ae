"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks.

A source's documents are ordered by a seeded hash and fall into blocks of equal hash ranges. A source draws every block once
for each whole time that its size fits in its target, then blocks in a permuted order until the target is met; the last block
gives only the first of its documents, and the last of those may be cut. The tree deals each source's exact number of draws
over the output shards: a node splits its quotas between its halves by a multivariate hypergeometric draw. Each shard takes
its own range of the permuted draws, so that shards are disjoint, and orders its documents by another hash.

The plan is metadata of bounded size (max_blocks blocks and max_sources sources at most; more sources are refused) and is made on
the driver; texts aren't shuffled until the shards are written. There is a shard for every SHARD_WORDS words, as long as their
number fits max_blocks and CELLS (shards times sources); beyond, shards grow.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm.common import WORD, materialize, pick, table

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3
SHARD_WORDS = 100_000
CELLS = 10_000_000


def fill(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Targets in proportion to the weights that sum to all sizes; none is above most times its size."""
    targets, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if unit * weights[i] > most * sizes[i]}
        for i in sorted(over or free):
            targets[i] = float(most * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        left = float(sum(sizes)) - sum(t for i, t in enumerate(targets) if i not in free or i in over)
        free -= over
    return targets


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of each source (columns) for each shard (rows); rows differ by one draw in total at most."""
    out = np.zeros((shards, len(quotas)), np.int64)
    base, extra = divmod(int(quotas.sum()), shards)
    fixed = np.array([base + (j < extra) for j in range(shards)], np.int64)
    stack = [(0, shards, quotas.astype(np.int64))]
    while stack:
        lo, hi, own = stack.pop()
        if hi - lo == 1:
            out[lo] = own
            continue
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(own, int(fixed[lo:mid].sum()), method="marginals")
        stack += [(lo, mid, left), (mid, hi, own - left)]
    return out


@dataclass
class Plan:
    sources: pd.DataFrame
    draws: pd.DataFrame
    quotas: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))


def _keys(source: Column) -> list[Column]:
    return [source.isNull().alias("missing"), F.coalesce(source, F.lit("")).alias("src")]


def _block(h: str = "h", n: str = "n_blocks") -> Column:
    return F.least(F.floor((F.col(h) / F.lit(2.0**64) + 0.5) * F.col(n)), F.col(n) - 1).cast("int")


def _sized(docs: DataFrame, seed: int) -> list[Column]:
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")
    return [size, F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"]).alias("h")]


def make_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int | None = None, seed: int = 17, min_block_words: int = 20_000, max_blocks: int = 1 << 16, max_sources: int = 100_000) -> Plan:
    """The targets, cuts and draws for docs. Equal input gives an equal plan, however it is partitioned.

    shards is their number; by default it follows the words.
    """
    spark = docs.sparkSession
    sized = materialize(docs.select(*_keys(docs["source"]), *_sized(docs, seed)), "mix-sizes")
    found = sized.groupBy("missing", "src").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"over {max_sources} sources")
    found.sort(key=lambda r: (r["missing"], r["src"]))  # str sorts by code point
    sizes = [r["n"] for r in found]
    targets = fill(sizes, [weights[i % len(weights)] for i in range(len(found))])
    shards = shards or max(1, min(-(-sum(sizes) // SHARD_WORDS), max_blocks, CELLS // max(1, len(found))))
    block_words = max(min_block_words, -(-sum(sizes) // max_blocks))
    src = pd.DataFrame(
        {
            "missing": [bool(r["missing"]) for r in found],
            "src": [r["src"] for r in found],
            "s": np.arange(len(found), dtype=np.int32),
            "source_size": np.array(sizes, np.int64),
            "target": np.array(targets, float),
            "n_blocks": np.array([max(1, -(-n // block_words)) for n in sizes], np.int32),
        }
    )
    src["passes"] = [min(MOST, int(t / n + 1e-12)) if n else 0 for n, t in zip(sizes, targets)]
    head = "missing boolean, src string, s int, source_size bigint, target double, n_blocks int, passes bigint"
    known = F.broadcast(spark.createDataFrame(list(src.itertuples(index=False, name=None)), head))
    sums = sized.join(known, ["missing", "src"]).groupBy("s", _block().alias("block")).agg(F.sum("size").alias("n")).collect()
    of: dict[int, dict[int, int]] = {}
    for r in sums:
        of.setdefault(r["s"], {})[r["block"]] = r["n"]
    quotas, order, limits = [], [], []
    for r in src.itertuples():
        n, rng = int(r.n_blocks), np.random.default_rng([seed, r.s])
        drawn = [(p, int(b)) for p in range(r.passes) for b in rng.permutation(n)]
        left, cut = max(0, round(r.target - r.passes * r.source_size)) if r.passes < MOST else 0, (-1, 0)
        for b in rng.permutation(n).tolist():
            if left <= 0:
                break
            got = of.get(r.s, {}).get(b, 0)
            drawn.append((r.passes, b))
            if got > left:
                cut = (b, left)
            left -= got
        order.append(drawn)
        quotas.append(len(drawn))
        limits.append(cut)
    src["cut_block"], src["cut_words"] = [c[0] for c in limits], [c[1] for c in limits]
    src["cut_block"] = src["cut_block"].astype(np.int32)
    ends = F.broadcast(spark.createDataFrame(list(src[["missing", "src", "s", "n_blocks", "cut_block", "cut_words"]].itertuples(index=False, name=None)), "missing boolean, src string, s int, n_blocks int, cut_block int, cut_words bigint").where("cut_block >= 0"))
    cuts = {}
    if (src["cut_block"] >= 0).any():
        # a cut block's documents in hash order; equal rows share a hash and are cut alike
        at = sized.join(ends, ["missing", "src"]).where(_block() == F.col("cut_block")).groupBy("s", "h", "cut_words").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
        upto = F.sum("w").over(Window.partitionBy("s").orderBy("h"))
        hit = at.withColumn("upto", upto).where("upto >= cut_words AND upto - w < cut_words").collect()
        cuts = {r["s"]: (r["h"], (r["cut_words"] - r["upto"] + r["w"]) // r["n"]) for r in hit}
    src["cut_h"] = np.array([cuts.get(s, (0, 0))[0] for s in src["s"]], np.int64)
    src["cut_take"] = np.array([cuts.get(s, (0, 0))[1] for s in src["s"]], np.int64)
    per_shard = split(np.array(quotas, np.int64), shards, seed) if quotas else np.zeros((shards, 0), np.int64)
    rows: dict[tuple[int, int], list[list[int]]] = {}
    for s, drawn in enumerate(order):
        homes = np.repeat(np.arange(shards), per_shard[:, s])
        for (p, b), home in zip(drawn, homes.tolist()):
            got = rows.setdefault((s, b), [[], []])
            got[0].append(p)
            got[1].append(home)
    draws = pd.DataFrame([(s, b, p, j) for (s, b), (p, j) in rows.items()], columns=["s", "block", "passes_in", "shards_in"])
    return Plan(src, draws, per_shard)


def _drawn(docs: DataFrame, plan: Plan, seed: int) -> DataFrame:
    """(row struct of all columns of docs, size, source_size, target, draws array<struct<pass, block, shard, words>>, h)."""
    spark = docs.sparkSession
    src = plan.sources[["missing", "src", "s", "source_size", "target", "n_blocks", "passes", "cut_block", "cut_h", "cut_take"]]
    known = spark.createDataFrame(list(src.itertuples(index=False, name=None)), "missing boolean, src string, s int, source_size bigint, target double, n_blocks int, passes bigint, cut_block int, cut_h bigint, cut_take bigint")
    drawn = spark.createDataFrame(list(plan.draws.itertuples(index=False, name=None)), "s int, block int, passes_in array<int>, shards_in array<int>")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *_keys(docs["source"]), *_sized(docs, seed))
    rows = rows.join(F.broadcast(known), ["missing", "src"]).withColumn("block", _block()).join(F.broadcast(drawn), ["s", "block"], "left")
    cut = F.when(F.col("h") < F.col("cut_h"), F.col("size")).when(F.col("h") == F.col("cut_h"), F.col("cut_take")).otherwise(F.lit(0))
    last = lambda p: (p == F.col("passes")) & (F.col("block") == F.col("cut_block"))
    one = lambda p, j: F.struct(p.alias("pass"), F.col("block").alias("block"), j.alias("shard"), F.when(last(p), cut).otherwise(F.col("size")).cast("bigint").alias("words"))
    none = F.array().cast("array<int>")
    draws = F.filter(F.zip_with(F.coalesce("passes_in", none), F.coalesce("shards_in", none), one), lambda d: d["words"] > 0)
    return rows.select("row", "size", "source_size", "target", draws.alias("draws"), "h")


def mix(docs: DataFrame, plan: Plan | None = None, seed: int = 17, **options) -> DataFrame:
    """docs with one more column, mix: struct<size, source_size, target, taken, draws array<struct<pass, block, shard, words>>>.

    Any column of docs but mix may have any name. A null text has size 0 and is never taken; a null source is a source of its
    own, the last; equal rows are taken alike. An empty table gives no rows.
    """
    rows = _drawn(docs, plan or make_plan(docs, seed=seed, **options), seed)
    taken = F.aggregate("draws", F.lit(0).cast("bigint"), lambda n, d: n + d["words"])
    return rows.select("row.*", F.struct("size", "source_size", "target", taken.alias("taken"), "draws").alias("mix"))


def shards(docs: DataFrame, n: int | None = None, seed: int = 17, **options) -> DataFrame:
    """The mixed documents, a row for each time that one is taken, in shards and shuffled within each.

    Documents stay whole: one that the last block cuts is taken if at least half of it fits. All columns of docs are kept,
    whatever their names. An empty table gives no rows.
    """
    plan = make_plan(docs, seed=seed, shards=n, **options)
    rows = _drawn(docs, plan, seed)
    taken = rows.select("row", "size", "h", F.explode("draws").alias("draw")).where("2 * draw.words >= size")
    placed = taken.select("row", F.col("draw.shard").alias("shard"), F.xxhash64(F.lit(seed), F.col("draw.pass"), F.col("draw.shard"), F.col("h")).alias("turn"))
    # a task holds several shards, one after the other; Spark sets the number of tasks by size
    return placed.repartition("shard").sortWithinPartitions("shard", "turn").select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mix(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", F.expr("mix.draws.shard").alias("shards"), F.get("mix.draws.block", F.lit(0)).alias("block"))
