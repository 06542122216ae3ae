"""A stored index of chunks in immutable segments: lexical postings with positions, vectors, and what a hit came from.

A segment is a folder with four Parquet tables: sources (id, sha, n_chunks, dl), chunks (id, ord, start, end, parent_start, parent_end,
section, chunk, dl) in the order in which documents came, postings (gram, block, data, ids, ords, dls, ats), divided by the gram's
bucket, and vectors (id, ord, vector) if an encoder was given. Versions (sources.versions) name the live segments and the tables of dead
ones' ids: a changed or pruned document leaves (seq, id) there, and its new text stands in a new segment. Small segments of like size
are merged; the chunks of the new one are posted anew.

A block is a run of a task's chunks, some BLOCK characters in all. It has a row for each of its trigrams, whose data are the places where
it begins, counted through the block, as differences of a byte or two, and a row of the empty gram with the chunks themselves and where
they begin. Each task writes its own blocks, sorted, into the bucket's folders; neither texts nor postings are shuffled.

A term is found as a substring, case ignored: its trigrams must stand side by side, which the places of the postings tell, so neither
counts nor lengths need a text. All postings of a term are read, as its weight needs the exact number of chunks that hold it; upper
bounds of blocks would spare nothing.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.operators import passages, retrieval
from evidentia.sources import versions
from evidentia.sources.sinks import materialize

GRAM = 3
#: Chunks for which a segment's postings get one more folder, the most folders (each task writes a file into each), and how many
#: segments of like size are merged.
PER_BUCKET, MOST_BUCKETS, FANOUT = 20_000, 16, 4
#: Characters of a block: a task that writes or searches one holds some 100 bytes for each. A longer chunk is a block of its own.
BLOCK = 1 << 21
#: Changed ids that are broadcast, some 50 MB; values of a filter that Parquet compares one by one.
MOST_SENT, IN_FILTER = 1_000_000, 10


def _bucket(gram: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(n)).cast("int")


def _packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the numbers, seven bits in each and the eighth set where more follow, and where each number begins."""
    size = 1 + sum((numbers >= 1 << s).astype(np.int64) for s in (7, 14, 21, 28))
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        more = size > k
        out[start[more] + k] = numbers[more] >> 7 * k & 127 | (size[more] > k + 1) << 7
    return out, start


def _places(data: bytes) -> np.ndarray:
    """The places of a row's data, ascending."""
    given = np.frombuffer(data, np.uint8).astype(np.int64)
    last = np.flatnonzero(given < 128)
    start = np.concatenate([[0], last[:-1] + 1])
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - start).max(initial=0)) + 1):
        more = start + k <= last
        out[more] += (given[start[more] + k] & 127) << 7 * k
    return np.cumsum(out)


def _block(name: str, ids: pa.Array, ords: pa.Array, dls: pa.Array, lows: list[str], schema: pa.Schema) -> pa.RecordBatch:
    """The rows of a block of chunks in lower case: the chunks, then a row for each distinct trigram, by NumPy."""
    sizes = np.array(list(map(len, lows)), np.int64)
    flat = np.frombuffer("".join(lows).encode("utf-32-le"), np.uint32)
    ats = np.cumsum(sizes) - sizes
    known = np.zeros(0x110000, bool)
    known[flat] = True
    signs = np.flatnonzero(known)
    rank = np.zeros(0x110000, np.uint64)
    rank[signs] = np.arange(len(signs))
    place = np.arange(max(len(flat) - (GRAM - 1), 0))
    place = place[place + GRAM <= np.repeat(ats + sizes, sizes)[: len(place)]]
    bits = np.uint64(max(1, int(len(signs) - 1).bit_length()))
    key = rank[flat[place]] << bits + bits | rank[flat[place + 1]] << bits | rank[flat[place + 2]]
    low = np.uint64(max(1, len(flat).bit_length()))
    if 3 * int(bits) + int(low) <= 64:  # key and place in one number sort fastest
        both = np.sort(key << low | place.astype(np.uint64))
        key, place = both >> low, (both & (np.uint64(1) << low) - np.uint64(1)).astype(np.int64)
    else:
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    steps = np.diff(place, prepend=0)
    steps[first] = place[first]
    data, start = _packed(steps)
    ends = np.append(start[first], len(data)).astype(np.int32)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    of = [signs[(key[first] >> s & mask).astype(np.int64)] for s in (bits + bits, bits, np.uint64(0))]
    n = len(first)
    packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)])
    once = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)] + [len(values)] * n, pa.int32()), pa.array(values, kind), mask=pa.array([False] + [True] * n))
    columns = [
        pa.array(["", *map("".join, zip(*(map(chr, x) for x in of)))], pa.string()),
        pa.array([xxhash.xxh64(name.encode()).intdigest() - (1 << 63)] * (n + 1), pa.int64()),
        pa.concat_arrays([pa.array([None], pa.binary()), packed]),
        once(ids, schema.field("ids").type.value_type),
        once(ords, pa.int32()),
        once(dls, pa.float64()),
        once(ats.astype(np.int32), pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _posted(kept: DataFrame, path: str) -> DataFrame:
    """Postings of chunks (id, ord, dl, chunk), in blocks of BLOCK characters of one task."""
    kind = kept.schema["id"].dataType
    schema = pa.schema([("gram", pa.string()), ("block", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(to_arrow_type(kind))), ("ords", pa.list_(pa.int32())), ("dls", pa.list_(pa.float64())), ("ats", pa.list_(pa.int32()))])

    def made(batches):
        held, chars = [], 0

        def close():
            ids, ords, dls = (pa.concat_arrays([x.column(k) for x, _ in held]) for k in range(3))
            return _block(f"{path} {ids[0]} {ords[0]}", ids, ords, dls, [t for _, x in held for t in x], schema)

        for batch in batches:
            lows, begin = batch.column(3).to_pylist(), 0
            for k, text in enumerate(lows):
                chars += len(text)
                if chars >= BLOCK:
                    held.append((batch.slice(begin, k + 1 - begin), lows[begin : k + 1]))
                    yield close()
                    held, chars, begin = [], 0, k + 1
            if begin < len(lows):
                held.append((batch.slice(begin), lows[begin:]))
        if held:
            yield close()

    return kept.select("id", "ord", "dl", F.lower("chunk").alias("low")).mapInArrow(made, POSTINGS.format(kind.simpleString()))


#: Columns of the postings of ids of a type.
POSTINGS = "gram string, block bigint, data binary, ids array<{}>, ords array<int>, dls array<double>, ats array<int>"


def _dead(spark: SparkSession, state: dict, kind: str) -> DataFrame:
    """(seq, id) of what segments hold and should no longer give."""
    schema = f"seq int, id {kind}"
    return spark.read.schema(schema).parquet(*state["dead"]) if state.get("dead") else spark.createDataFrame([], schema)


def _read(spark: SparkSession, state: dict, name: str, where: Callable[[DataFrame, dict], DataFrame] | None = None) -> DataFrame | None:
    """A table of all live segments with seq, without the dead."""
    parts = []
    for s in state.get("segments", ()):
        df = spark.read.parquet(f"{s['path']}/{name}").withColumn("seq", F.lit(s["seq"]))
        parts.append(where(df, s) if where else df)
    if not parts:
        return None
    rows = reduce(DataFrame.unionByName, parts)
    return rows if not state.get("dead") else rows.join(_dead(spark, state, state["kind"]), ["seq", "id"], "left_anti")


def sources(spark: SparkSession, folder: str) -> DataFrame | None:
    """(id, sha, n_chunks, dl, seq) of what the index holds; None if it holds nothing yet."""
    return _read(spark, versions.latest(spark, folder).state, "sources")


def stamped(docs: DataFrame) -> DataFrame:
    """docs with sha, the digest of its text. A catalog that keeps its own stamps needs no such pass over the texts."""
    return docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))


def _write(spark: SparkSession, path: str, chunks: DataFrame, sources_: DataFrame, vectors: Callable[[DataFrame], DataFrame] | None, per_bucket: int) -> tuple[int, int]:
    """Number of chunks and of buckets of a new segment."""
    # a search reads the row groups that may hold its hits' ids, whatever the order of documents
    chunks.write.options(**{"compression": "zstd", "parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.expected.ndv#id": "100000"}).parquet(f"{path}/chunks")
    kept = spark.read.schema(chunks.schema).parquet(f"{path}/chunks")
    n = kept.count()
    buckets = max(1, min(MOST_BUCKETS, -(-n // per_bucket)))
    sizes = kept.groupBy("id").agg(F.count("*").alias("n_chunks"), F.sum("dl").alias("dl"))
    sources_.select("id", "sha").join(sizes, "id", "left").na.fill(0, ["n_chunks"]).na.fill(0.0, ["dl"]).write.parquet(f"{path}/sources")
    posted = _posted(kept, path).withColumn("bucket", _bucket(F.col("gram"), buckets))
    posted.sortWithinPartitions("bucket", "gram").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    if vectors:
        vectors(kept).write.option("compression", "zstd").parquet(f"{path}/vectors")
    return n, buckets


def update(docs: DataFrame, folder: str, prune: bool = False, offsets: Callable[[str], list] = passages.word_offsets, encode: Callable[[list[str]], np.ndarray] | None = None, per_bucket: int = PER_BUCKET, fanout: int = FANOUT) -> dict[str, int]:
    """Bring the index at folder up to docs (id, sha, text): {"reused": n, "indexed": n, "pruned": n}.

    Only texts whose sha the index lacks are read and written, as one new segment; without any there is no new version. prune also
    takes out what docs no longer has. ids are not null and unique. A null or empty text is known but has no chunk. A failing run or
    one that loses to another writer (versions.Conflict) changes nothing.
    """
    spark = docs.sparkSession
    now = versions.latest(spark, folder)
    state = now.state or {"segments": [], "dead": [], "next": 0, "kind": docs.schema["id"].dataType.simpleString()}
    known = _read(spark, state, "sources")
    own = docs.select("id", F.col("sha").alias("new"))
    both = own.join(known.select("id", F.col("sha").alias("old"), "seq"), "id", "full_outer") if known is not None else own.withColumns({"old": F.lit(None).cast("string"), "seq": F.lit(None).cast("int")})
    what = F.when(F.col("new").isNull(), "pruned" if prune else "kept").when(F.col("new") == F.col("old"), "reused").otherwise("indexed")
    changes = materialize(both.select("id", "seq", F.col("new").alias("sha"), what.alias("what")), "changes")
    counts = {r["what"]: r["n"] for r in changes.groupBy("what").agg(F.count("*").alias("n")).collect()}
    told = {k: counts.get(k, 0) for k in ("reused", "indexed", "pruned")}
    if not told["indexed"] + told["pruned"]:
        return told
    segments, dead, seq = list(state["segments"]), list(state["dead"]), state["next"]
    if told["indexed"]:
        path = f"{folder}/segment-{uuid.uuid4().hex}"
        new = changes.where("what = 'indexed'").select("id", "sha")
        some = F.broadcast(new) if told["indexed"] <= MOST_SENT else new
        fresh = docs.join(some.select("id"), "id", "left_semi") if told["reused"] else docs.where("sha IS NOT NULL")
        size = F.greatest(F.length("chunk") - (GRAM - 1), F.lit(0)).cast("double")
        chunks = passages.token_chunks(fresh.select("id", "text"), offsets).withColumn("dl", size)
        n, buckets = _write(spark, path, chunks, new, (lambda kept: embedded(kept, encode)) if encode else None, per_bucket)
        segments.append({"seq": seq, "path": path, "chunks": n, "buckets": buckets, "vectors": encode is not None})
        seq += 1
    replaced = changes.where("what IN ('indexed', 'pruned') AND seq IS NOT NULL").select("seq", "id")
    if not replaced.isEmpty():
        path = f"{folder}/dead-{uuid.uuid4().hex}"
        replaced.write.parquet(path)
        dead.append(path)
    now = _commit(spark, folder, now, state | {"segments": segments, "dead": dead, "next": seq})
    _merge(spark, folder, now, fanout, per_bucket)
    return told


def _commit(spark: SparkSession, folder: str, after: versions.Version, state: dict) -> versions.Version:
    """Commit with the number and the total length of live chunks."""
    live = _read(spark, state, "sources")
    n, total = live.agg(F.sum("n_chunks"), F.sum("dl")).first() if live is not None else (0, 0.0)
    return versions.commit(spark, folder, after, state | {"n": int(n or 0), "total": float(total or 0)})


def embedded(kept: DataFrame, encode: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(id, ord, vector) of chunks."""
    named = retrieval.embedded(kept.select(F.struct("id", "ord").alias("id"), F.col("chunk").alias("text")), encode)
    return named.select("id.id", "id.ord", "vector")


def _merge(spark: SparkSession, folder: str, now: versions.Version, fanout: int, per_bucket: int) -> None:
    """Where fanout segments are of like size, one takes their place, with what is live of them."""
    tiers: dict[int, list[dict]] = {}
    for s in now.state["segments"]:
        tiers.setdefault(int(math.log(max(s["chunks"], 1), fanout)), []).append(s)
    full = next((t for t in sorted(tiers) if len(tiers[t]) >= fanout), None)
    if full is None:
        return
    merged = tiers[full]
    own = now.state | {"segments": merged}
    path = f"{folder}/segment-{uuid.uuid4().hex}"
    has_vectors = all(s["vectors"] for s in merged)
    chunks = _read(spark, own, "chunks").drop("seq")
    n, buckets = _write(spark, path, chunks, _read(spark, own, "sources"), (lambda _: _read(spark, own, "vectors").drop("seq")) if has_vectors else None, per_bucket)
    gone = {s["seq"] for s in merged}
    rest = [s for s in now.state["segments"] if s["seq"] not in gone]
    dead = []
    if now.state["dead"]:
        still = _dead(spark, now.state, now.state["kind"]).where(~F.col("seq").isin(*gone))
        if not still.isEmpty():
            dead = [f"{folder}/dead-{uuid.uuid4().hex}"]
            still.write.parquet(dead[0])
    one = {"seq": now.state["next"], "path": path, "chunks": n, "buckets": buckets, "vectors": has_vectors}
    _merge(spark, folder, _commit(spark, folder, now, now.state | {"segments": [*rest, one], "dead": dead, "next": now.state["next"] + 1}), fanout, per_bucket)


def status(spark: SparkSession, folder: str) -> dict[str, int]:
    """Live documents and chunks, segments and the version."""
    now = versions.latest(spark, folder)
    live = _read(spark, now.state, "sources")
    return {"documents": live.count() if live is not None else 0, "chunks": now.state.get("n", 0), "segments": len(now.state.get("segments", ())), "version": now.number}


def _times(places: np.ndarray, width: int) -> np.ndarray:
    """The ascending places that are taken, each blocking those less than width further on."""
    if (np.diff(places) >= width).all():
        return places
    taken: list[int] = []
    for p in places.tolist():
        if not taken or p >= taken[-1] + width:
            taken.append(p)
    return np.array(taken, np.int64)


def term_counts(spark: SparkSession, folder: str, terms: Sequence[str]) -> DataFrame | None:
    """(id, ord, dl, k, tf) of the live chunks that hold terms[k], from the postings of its trigrams alone; a task takes a block."""
    state = versions.latest(spark, folder).state
    terms = list(terms)
    wanted = sorted({t[i : i + GRAM] for t in terms for i in range(len(t) - GRAM + 1)})
    if not wanted or not state.get("segments"):
        return None
    parts = []
    for s in state["segments"]:
        df = spark.read.schema(f"{POSTINGS.format(state['kind'])}, bucket int").parquet(f"{s['path']}/postings")
        of: dict[int, list[str]] = {}
        for g in ["", *wanted]:
            h = xxhash.xxh64(g.encode(), 42).intdigest()
            of.setdefault((h - (h >> 63 << 64)) % s["buckets"], []).append(g)  # as _bucket has it: signed, seed 42
        for bucket, grams in of.items():  # short lists, so that of a sorted file only the pages of these grams are read
            for at in range(0, len(grams), IN_FILTER):
                own = df.where((F.col("bucket") == bucket) & F.col("gram").isin(grams[at : at + IN_FILTER]))
                parts.append(own.drop("bucket").withColumn("seq", F.lit(s["seq"])))

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        found = {g: _places(data) for g, data in zip(pdf["gram"], pdf["data"]) if g}
        chunks = pdf[pdf["gram"] == ""].iloc[0]
        out = [pd.DataFrame({"seq": [], "id": [], "ord": [], "dl": [], "k": [], "tf": []})]
        for k, term in enumerate(terms):
            grams = [term[i : i + GRAM] for i in range(len(term) - GRAM + 1)]
            if grams and all(g in found for g in grams):
                shifted = [found[g] - i for i, g in enumerate(grams)]
                places = reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), shifted)
                rows, times = np.unique(np.searchsorted(chunks["ats"], _times(places, len(term)), "right") - 1, return_counts=True)
                if len(rows):
                    out.append(pd.DataFrame({"seq": chunks["seq"], "id": chunks["ids"][rows], "ord": chunks["ords"][rows], "dl": chunks["dls"][rows], "k": k, "tf": times}))
        return pd.concat(out[1:] or out)

    kind = state["kind"]
    held = reduce(DataFrame.unionByName, parts).groupBy("seq", "block").applyInPandas(counted, f"seq int, id {kind}, ord int, dl double, k int, tf int")
    live = held.join(_dead(spark, state, kind), ["seq", "id"], "left_anti") if state.get("dead") else held
    return live.drop("seq")


def lexical(spark: SparkSession, folder: str, terms: Sequence[str], scope: DataFrame | None = None) -> DataFrame | None:
    """(id, ord, score) of the chunks that hold a term of three characters or more, as retrieval.bm25 would score all live chunks.

    scope, if given, has the ids that may be found; statistics stay over all. None of an empty index or without such a term.
    """
    terms = [t for t in dict.fromkeys(t.lower() for t in terms) if len(t) >= GRAM]
    found = term_counts(spark, folder, terms)
    if found is None:
        return None
    counted = materialize(found, "terms")
    df = {r["k"]: r["n"] for r in counted.groupBy("k").agg(F.count("*").alias("n")).collect()}  # a row for each term
    state = versions.latest(spark, folder).state
    n, mean = state["n"], state["total"] / max(state["n"], 1)
    idf = [max(math.log((n - df.get(k, 0) + 0.5) / (df.get(k, 0) + 0.5)), retrieval.IDF_FLOOR) if df.get(k) else 0.0 for k in range(len(terms))]
    weight = F.element_at(F.array(*map(F.lit, idf)), F.col("k") + 1)
    part = weight * F.col("tf") * (retrieval.K1 + 1) / (F.col("tf") + retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("dl") / F.lit(mean)))
    scored = counted if scope is None else counted.join(scope.select("id").distinct(), "id", "left_semi")
    return scored.groupBy("id", "ord").agg(F.sum(part).alias("score"))


def semantic(spark: SparkSession, folder: str, probe: Sequence[float], scope: DataFrame | None = None) -> DataFrame | None:
    """(id, ord, distance) of all live chunks with a vector; zero vectors have no distance."""
    state = versions.latest(spark, folder).state
    rows = _read(spark, state | {"segments": [s for s in state.get("segments", ()) if s["vectors"]]}, "vectors")
    if rows is None:
        return None
    near = rows.select("id", "ord", retrieval.cosine_distance(F.col("vector"), list(probe)).alias("distance")).where("distance IS NOT NULL")
    return near if scope is None else near.join(scope.select("id").distinct(), "id", "left_semi")  # no vector is shuffled


HIT = "id, ord, section, chunk, start, end, sha, methods, rrf, rank"


def hybrid(spark: SparkSession, folder: str, question: str, probe: Sequence[float] | None = None, current: DataFrame | None = None, depth: int = 40, top_k: int = 6) -> DataFrame:
    """The top_k parents of fused hits: (id, ord, section, chunk, start, end, sha, methods, rrf, rank).

    Both rankings give their best depth chunks, fused by reciprocal rank; of the chunks of one parent (start to end in the source) the
    best stays. Only those 2 * depth chunks are read with their text. current (id, sha), if given, has the documents that may be
    found, in the version that they have now: what is stale in the index is refused before it is ranked.
    """
    scope = None
    if current is not None:
        live = sources(spark, folder)
        scope = materialize(live.join(current.select("id", "sha"), ["id", "sha"], "left_semi").select("id"), "scope") if live is not None else None
    near = [("text", lexical(spark, folder, retrieval.query_terms(question), scope), F.desc("score"))]
    if probe is not None:
        near.append(("vector", semantic(spark, folder, probe, scope), F.asc("distance")))
    lists = [retrieval.top(df, [order, F.asc("id"), F.asc("ord")], depth).select(F.struct("id", "ord").alias("id"), "rank", F.lit(name).alias("method")) for name, df, order in near if df is not None]
    kind = versions.latest(spark, folder).state.get("kind", "bigint")
    if not lists:
        return spark.createDataFrame([], f"id {kind}, ord int, section string, chunk string, start int, end int, sha string, methods array<string>, rrf double, rank bigint")
    ranked = materialize(reduce(DataFrame.unionByName, lists), "ranked")
    fused = retrieval.reciprocal_rank_fusion(ranked)
    how = ranked.groupBy("id").agg(F.array_sort(F.collect_list("method")).alias("methods"))
    fused = fused.join(how, "id").select("id.id", "id.ord", "rrf", "methods")
    ids = [r[0] for r in fused.select("id").distinct().collect()]  # 2 * depth at most
    state = versions.latest(spark, folder).state
    some = lambda df, _: df.where(F.col("id").isin(ids))
    chunks = _read(spark, state, "chunks", some).select("id", "ord", "section", "chunk", F.col("parent_start").alias("start"), F.col("parent_end").alias("end"))
    stamps = _read(spark, state, "sources", some).select("id", "sha")
    found = chunks.join(F.broadcast(fused), ["id", "ord"]).join(F.broadcast(stamps), "id")
    best = found.groupBy("id", "start", "end").agg(F.min_by(F.struct("ord", "section", "chunk", "sha", "methods", "rrf"), F.struct(-F.col("rrf"), F.col("ord"))).alias("x"))
    hits = best.select("id", "start", "end", "x.*")
    return retrieval.top(hits, [F.desc("rrf"), F.asc("id"), F.asc("ord")], top_k).select(*HIT.split(", "))
