"""Lexical, vector and fused retrieval over document tables."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the ranking function.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
TERM = r"[A-Za-z0-9_]{3,}|[㐀-鿿]+"


def query_terms(query: str, most: int = 24, width: int = 8) -> list[str]:
    """Search terms of a question: word runs of three characters or more and CJK runs, cut to width, most of them at most."""
    return [t[:width] for t in re.findall(TERM, query)][:most]


def query_terms_col(text: Column, most: int = 24, width: int = 8) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]{3,}|[\x{3400}-\x{9fff}]+)"), F.lit(1))
    return F.slice(F.transform(found, lambda t: F.substring(t, 1, width)), 1, most)


def term_count(text: Column, term: str) -> Column:
    """Occurrences of a term as a substring, case ignored, that don't overlap."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(term.lower())))) / len(term)).cast("double")


def bm25_score(terms: int) -> Column:
    """The score of a row with n, avgdl, dl, and for each of the terms its counts in the row (t0, ...) and in how many rows (d0, ...)."""
    idf = lambda k: F.greatest(F.log((F.col("n") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5)), F.lit(IDF_FLOOR))
    part = lambda k: idf(k) * F.col(f"t{k}") * (K1 + 1) / (F.col(f"t{k}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return reduce(lambda a, b: a + b, [part(k) for k in range(terms)], F.lit(0.0))


def bm25(docs: DataFrame, terms: list[str], length: Column | None = None) -> DataFrame:
    """(id, score) of the rows of (id, text) that hold a term of three characters or more; statistics are over all of docs.

    One pass counts, one row of statistics is broadcast, and the score is an expression.
    """
    terms = [t for t in dict.fromkeys(t.lower() for t in terms) if len(t) >= 3]
    size = F.greatest(F.length("text") - 2, F.lit(0)).cast("double") if length is None else length
    counted = docs.select("id", size.alias("dl"), *[term_count(F.col("text"), t).alias(f"t{k}") for k, t in enumerate(terms)])
    stats = counted.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"t{k}") > 0).cast("double")).alias(f"d{k}") for k in range(len(terms))])
    hit = reduce(lambda a, b: a | b, [F.col(f"t{k}") > 0 for k in range(len(terms))], F.lit(False))
    return counted.where(hit).crossJoin(F.broadcast(stats)).select("id", bm25_score(len(terms)).alias("score"))


def cosine_distance(vector: Column, probe: list[float]) -> Column:
    """1 - cosine in double precision, null for a zero vector."""
    x = vector.cast("array<double>")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    dot = total(F.zip_with(x, F.array(*map(F.lit, map(float, probe))), lambda a, b: a * b))
    norm = math.sqrt(math.fsum(float(v) ** 2 for v in probe))
    return 1 - F.try_divide(dot, F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)) * norm)


def embedded(docs: DataFrame, encode: Callable[[list[str]], np.ndarray], batch: int = 256) -> DataFrame:
    """(id, vector) of unit length for (id, text), by any function from texts to rows of numbers, called on batch texts at a time.

    A null text counts as empty; a zero row stays zero. The function must work on executors.
    """

    def run(batches):
        for given in batches:
            for at in range(0, given.num_rows, batch):
                part = given.slice(at, batch)
                rows = np.asarray(encode([t or "" for t in part.column(1).to_pylist()]), np.float32).reshape(part.num_rows, -1)
                rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(rows), pa.list_(pa.float32()))], ["id", "vector"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, vector array<float>")


def top(ranked: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows in order, with rank from 1. Only they reach the one task that numbers them."""
    best = ranked.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def reciprocal_rank_fusion(*ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """(id, rank) lists -> (id, rrf, n_methods): the sum of 1 / (k + rank)."""
    both = reduce(DataFrame.unionByName, [r.select("id", "rank") for r in ranked])
    return both.groupBy("id").agg(F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("rrf"), F.count("*").alias("n_methods"))


def hybrid_search(docs: DataFrame, vectors: DataFrame, question: str, probe: list[float], scope: DataFrame | None = None, depth: int = 40, top_k: int = 8) -> DataFrame:
    """(id, text, parent) and (id, vector) -> the top_k fused hits, one for each parent.

    scope, if given, holds the ids that may be found; statistics stay over all of docs.
    """
    within = (lambda df: df.join(scope.select("id").distinct(), "id", "left_semi")) if scope is not None else (lambda df: df)
    lexical = top(within(bm25(docs, query_terms(question))), [F.desc("score"), F.asc("id")], depth)
    near = within(vectors).select("id", cosine_distance(F.col("vector"), probe).alias("distance")).where("distance IS NOT NULL")
    semantic = top(near, [F.asc("distance"), F.asc("id")], depth)
    fused = reciprocal_rank_fusion(lexical, semantic)
    found = docs.select("id", "parent").join(F.broadcast(fused), "id")  # 2 * depth rows
    one = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("rrf"), "id"))
    return top(found.withColumn("turn", one).where("turn = 1").drop("turn"), [F.desc("rrf"), F.asc("id")], top_k)
