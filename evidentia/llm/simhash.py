"""SimHash near-dedup: 64-bit fingerprints, linked by BK-trees at a Hamming distance of 4 or less.

Two fingerprints that differ in at most 4 bits agree in at least 2 of 6 bands. So each distinct fingerprint goes to one
bucket for each of the 15 pairs of bands, and each bucket holds a BK-tree over its members. The buckets are the shards:
their trees stay in the tasks that build them, as trees over all fingerprints grow with the corpus and can't be broadcast.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm.common import materialize, pick, slices, table
from evidentia.operators.graph import components, hot_join

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Widths of the bands, low bits first; RADIUS + 2 bands, so that 2 stay equal.
BANDS = (11, 11, 11, 11, 10, 10)
#: Members of one tree; a larger bucket is dealt over several trees.
TREE_SIZE = 4096


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of one text; no words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    ends, starts = ends.tolist(), [0, *(ends[:-1] + 1).tolist()]
    last = min(SHINGLE_WORDS, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[last:])], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    major = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(major, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fp bigint, text_hash bigint) of every row; a null text counts as empty."""

    def stamp(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], ["doc_id", "fp", "text_hash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = pick(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return source.mapInArrow(stamp, f"doc_id {kind}, fp bigint, text_hash bigint")


class BKTree:
    """Children are keyed by their distance to the parent; a search follows the edges within the radius."""

    def __init__(self):
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        at = 0 if self.nodes else None
        self.nodes.append(x)
        self.children.append({})
        new = len(self.nodes) - 1
        while at is not None:
            d = (x ^ self.nodes[at]).bit_count()
            nearer = self.children[at].get(d)
            if nearer is None:
                self.children[at][d] = new
            at = nearer

    def within(self, x: int, radius: int = RADIUS):
        stack = [0] if self.nodes else []
        while stack:
            at = stack.pop()
            d = (x ^ self.nodes[at]).bit_count()
            if d <= radius:
                yield self.nodes[at]
            stack += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]


def _links(members: list[int], guests: list[int]) -> list[tuple[int, int]]:
    """Links among members and from guests to members, without those that other links of the list imply."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    found, tree = [], BKTree()
    for x, member in [*((x, True) for x in members), *((x, False) for x in guests)]:
        for y in tree.within(x):
            a, b = root(x), root(y)
            if a != b:
                parent[a] = b
                found.append((x, y))
        if member:
            tree.add(x)
    return found


def _search(batches):
    """Rows come sorted by bucket; one bucket's members are held at a time, TREE_SIZE at most, its guests in blocks."""
    key, held = None, []

    def flush():
        rows = np.concatenate(held)
        own = rows[:, 0] == 1
        found = _links(rows[own, 1].view(np.uint64).tolist(), rows[~own, 1].view(np.uint64).tolist())
        return np.array(found, np.uint64).view(np.int64)

    for pdf in batches:
        if not len(pdf):
            continue
        out = []
        keys = pdf[["c", "k", "s"]].to_numpy()
        rows = np.column_stack([pdf["own"].to_numpy().astype(np.int64), pdf["fp"].to_numpy()])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        # buckets of one row that lie inside the batch link nothing
        busy = (ends - starts > 1) | (starts == 0) | (ends == len(keys))
        for a, b in zip(starts[busy].tolist(), ends[busy].tolist()):
            now = tuple(keys[a])
            if now != key:
                if sum(map(len, held)) > 1:
                    out.append(flush())
                key, held = now, []
            held.append(rows[a:b])
        out = [x for x in out if len(x)]
        if out:
            both = np.concatenate(out)
            yield pd.DataFrame({"u": both[:, 0], "v": both[:, 1]})
    if sum(map(len, held)) > 1 and len(both := flush()):
        yield pd.DataFrame({"u": both[:, 0], "v": both[:, 1]})


def links(fps: DataFrame, tree_size: int = TREE_SIZE) -> DataFrame:
    """Distinct fingerprints (fp bigint) -> (u, v) links that connect all that lie within the radius of each other."""
    low = np.cumsum([0, *BANDS])
    masks = [sum(((1 << BANDS[i]) - 1) << int(low[i]) for i in pair) for pair in combinations(range(len(BANDS)), 2)]
    signed = [int(np.uint64(m).view(np.int64)) for m in masks]
    buckets = F.array(*[F.struct(F.lit(c).cast("int").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for c, m in enumerate(signed)])
    postings = fps.select("fp", F.inline(buckets))
    big = postings.groupBy("c", "k").count().where(F.col("count") > tree_size).select("c", "k", F.ceil(F.col("count") / tree_size).cast("int").alias("n"))
    dealt = (
        postings.join(big, ["c", "k"], "left")
        .withColumn("n", F.coalesce("n", F.lit(1)))
        .withColumn("home", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        .select("c", "k", "fp", "home", F.explode(F.sequence("home", F.col("n") - 1)).alias("s"))
        .select("c", "k", "s", (F.col("s") == F.col("home")).alias("own"), "fp")
    )
    ordered = dealt.repartition("c", "k", "s").sortWithinPartitions("c", "k", "s", F.desc("own"), "fp")
    return ordered.mapInPandas(_search, "u bigint, v bigint")


def groups(fingerprints: DataFrame) -> DataFrame:
    """(fp, root): the fingerprint that stands for all that are linked with fp, itself included."""
    distinct = materialize(fingerprints.select("fp").distinct(), "fingerprints")
    linked = components(links(distinct)).select(F.col("node").alias("fp"), F.col("component_id").alias("root"))
    return distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    A null or empty text has the fingerprint 0 and links like any other. Equal texts share a fingerprint and so a group.
    component_id is the group's smallest doc_id; null ids are no candidates, and a group of null ids alone has null. Columns but
    doc_id and text don't matter; an empty table gives no rows.
    """
    stamped = materialize(with_fingerprint(docs), "simhash")
    lowest = stamped.groupBy("fp").agg(F.min("doc_id").alias("low"))
    rooted = materialize(groups(stamped).join(lowest, "fp"), "rooted")
    names = hot_join(rooted, rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    return hot_join(stamped, names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id (null ids last), then of the smallest text hash.

    Rows that share both are interchangeable, and one of them stays. All columns are kept, whatever their names. Null and empty
    texts are one group. An empty table gives no rows.
    """
    stamped = materialize(with_fingerprint(docs), "simhash")
    key = lambda i, h: F.struct(i.isNull().alias("missing"), i.alias("id"), F.coalesce(h, F.lit(0)).alias("h"))
    rooted = groups(stamped).join(stamped.groupBy("fp").agg(F.min(key(F.col("doc_id"), F.col("text_hash"))).alias("low")), "fp")
    first = rooted.groupBy("root").agg(F.min("low").alias("low")).select("low")
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), key(docs["doc_id"], F.xxhash64(docs["text"])).alias("own"))
    hit = packed.join(first, packed["own"].eqNullSafe(first["low"]), "left_semi")
    turn = F.row_number().over(Window.partitionBy("own").orderBy("own"))
    return hit.withColumn("turn", turn).where("turn = 1").select("row.*")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
