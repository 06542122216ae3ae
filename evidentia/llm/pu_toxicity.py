"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all documents outside the held-out fold, of any kind and as often as they occur, are
the unlabelled rest. A linear classifier over the words and word beginnings that a text holds is trained on the non-negative risk
estimate
    prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)])
with the sigmoid loss l; where the second part is negative, a step climbs it. The prior is the share of toxic rows among the
labelled ones that training may see.

Training is distributed: each task takes Adam steps over its unlabelled rows, beside draws from the positives, and the changes of
all tasks are averaged by their rows; ROUNDS such rounds are taken, the next from the average of the one before. A feature counts
by how much more frequent it is among the positives than among all rows, so that a rare or common word counts little.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import materialize, pick, slices, table, text_or_empty
from evidentia.llm.labelled import held_out, labelled_sample

MODULUS, REMAINDER = 5, 0
#: Labelled documents that training takes at most.
POSITIVES = 4_000
BITS = 20
#: Bytes of a word beginning.
STEM = 5
#: Positives that each frequency is smoothed by, and the scale of a feature that only positives hold.
SMOOTH, GAIN = 6, 6.0
#: Rows of a step, steps of a task at least (it goes over few rows again), rounds.
BATCH, STEPS, ROUNDS = 256, 150, 2
MARKS = b".,;:!?\"'()[]{}&$%#*|<>-_"


def features(text: str) -> np.ndarray:
    """Sorted hashes of the distinct words and word beginnings."""
    words = {w.strip(MARKS) for w in text.lower().encode().split()}
    stems = {w[:STEM] for w in words if len(w) > STEM}
    mask = (1 << BITS) - 1
    return np.unique(np.array([*(zlib.crc32(w) & mask for w in words if w), *(zlib.crc32(w, 1) & mask for w in stems)], np.int32))


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        raw = np.array([self.weights[x].sum() for x in rows], float) + self.bias
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


@dataclass
class Rows:
    """Documents as (document, feature) pairs."""

    n: int
    doc: np.ndarray
    col: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        return cls(len(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64))

    def sigmoid(self, w: np.ndarray, b: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.bincount(self.doc, w[self.col], self.n) + b, -30, 30)))


def gradient(pos: Rows, unl: Rows, w: np.ndarray, b: float, scale: np.ndarray, prior: float) -> np.ndarray:
    """Of the risk estimate of a batch by the weights, scaled as the features are, and by the bias; or of the climb."""
    p, u = pos.sigmoid(w * scale, b), unl.sigmoid(w * scale, b)
    rest = u.mean() - prior * p.mean()
    of_pos, of_unl = prior * p * (1 - p) / pos.n, u * (1 - u) / unl.n
    of_pos, of_unl = (-2 * of_pos, of_unl) if rest >= 0 else (of_pos, -of_unl)
    by = np.bincount(pos.col, of_pos[pos.doc], len(w)) + np.bincount(unl.col, of_unl[unl.doc], len(w))
    return np.append(by * scale, of_pos.sum() + of_unl.sum())


class Trainer:
    """Adam steps from given weights; the last weight is the bias."""

    def __init__(self, w: np.ndarray, pos: list[np.ndarray], scale: np.ndarray, prior: float, seed: int, rate: float, decay: float = 1e-3):
        self.w, self.pos, self.scale, self.prior, self.rate, self.decay = w.copy(), pos, scale, prior, rate, decay
        self.rng, self.steps = np.random.default_rng(seed), 0
        self.m, self.v = np.zeros(len(w)), np.zeros(len(w))

    def step(self, unl: list[np.ndarray]) -> None:
        self.steps += 1
        drawn = Rows.of([self.pos[k] for k in self.rng.integers(0, len(self.pos), min(len(self.pos), 2 * BATCH))])
        g = gradient(drawn, Rows.of(unl), self.w[:-1], self.w[-1], self.scale, self.prior)
        g[:-1] += self.decay * self.w[:-1] / len(self.w)
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        self.w -= self.rate * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.v / (1 - 0.999**self.steps)) + 1e-8)

    def run(self, rows) -> int:
        """One pass over the rows, which are kept while they are few, and then as many more as STEPS needs; their number."""
        held, batch, n = [], [], 0
        for x in rows:
            n += 1
            batch.append(x)
            if n <= STEPS * BATCH:
                held.append(x)
            if len(batch) == BATCH:
                self.step(batch)
                batch = []
        if batch:
            self.step(batch)
        while held and self.steps < STEPS:
            order = self.rng.permutation(len(held))
            for at in range(0, len(order), BATCH):
                self.step([held[k] for k in order[at : at + BATCH]])
        return n


def feature_scale(df_pos: np.ndarray, n_pos: int, df_all: np.ndarray, n_all: int) -> np.ndarray:
    """0 for a feature no more frequent among the positives than among all rows, towards GAIN the more it is."""
    smooth = SMOOTH / n_pos
    lift = (df_pos / n_pos + smooth) / (df_all / max(1, n_all) + smooth)
    return GAIN * (np.maximum(lift - 1, 0) / (lift + 1)) ** 2


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, rounds: int = ROUNDS, rate: float = 0.2) -> Classifier:
    """The classifier of at most positives toxic rows, the bounded sample, and of all unlabelled rows.

    The features of the positives span the space; the unlabelled rows are written as places in it once, and read once for the
    frequencies and in each round. Steps follow the partitions of docs, so another partitioning gives slightly other weights.
    Without positives or rows nothing is toxic.
    """
    open_ = pick(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", MODULUS, REMAINDER))
    shares = open_.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    prior = min(0.9, max(0.01, shares or 0.0))

    def taken(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([features(x).tobytes() for x in batch.column(0).to_pylist()], pa.binary())], ["seen"])

    none = Classifier(np.zeros(1 << BITS, np.float32), -5.0)
    known = labelled_sample(docs, labels, "toxic", MODULUS, REMAINDER, positives, value=1).select("text")
    found = sorted(bytes(r["seen"]) for r in known.mapInArrow(taken, "seen binary").collect())
    pos = [np.frombuffer(x, np.int32) for x in found]
    if not pos:
        return none
    space = np.unique(np.concatenate(pos))
    if not len(space):
        return none
    place = np.full(1 << BITS, -1, np.int32)
    place[space] = np.arange(len(space))
    pos = [place[x] for x in pos]

    def placed(batches):
        for batch in slices(batches):
            rows = [place[features(x)] for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[x >= 0].tobytes() for x in rows], pa.binary())], ["seen"])

    rest = pick(docs, "doc_id", "text").where(~held_out("doc_id", MODULUS, REMAINDER)).select(text_or_empty().alias("text"))
    marks = materialize(rest.mapInArrow(placed, "seen binary"), "pu-features")

    def arrays(batches):
        for batch in slices(batches):
            for x in batch.column(0):
                yield np.frombuffer(x.as_buffer(), np.int32)

    def counted(batches):
        total, n = np.zeros(len(space), np.int64), 0
        for x in arrays(batches):
            total[x] += 1  # places are distinct
            n += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*used, -1], pa.int32()), pa.array([*total[used], n], pa.int64())], ["at", "n"])

    df = np.zeros(len(space) + 1, np.int64)  # the last: rows
    got = marks.mapInArrow(counted, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row a feature
    df[got["at"].to_numpy()] = got["n"].to_numpy()
    if not df[-1]:
        return none
    scale = feature_scale(np.bincount(np.concatenate(pos), minlength=len(space)), len(pos), df[:-1], int(df[-1]))
    w = np.append(np.zeros(len(space)), -1.0)

    def learned(w, rate):
        def run(batches):
            trainer = Trainer(w, pos, scale, prior, TaskContext.get().partitionId(), rate)
            n = trainer.run(arrays(batches))
            if n:
                moved = np.flatnonzero(trainer.w != w)
                yield pa.RecordBatch.from_arrays([pa.array(moved, pa.int32()), pa.array((trainer.w - w)[moved] * n)], ["at", "change"])

        return run

    for k in range(rounds):
        got = marks.mapInArrow(learned(w, rate / (1 + k)), "at int, change double").groupBy("at").agg(F.sum("change").alias("change")).toArrow()
        w = w.copy()
        w[got["at"].to_numpy()] += got["change"].to_numpy() / df[-1]
    weights = np.zeros(1 << BITS, np.float32)
    weights[space] = w[:-1] * scale
    return Classifier(weights, float(w[-1]))


def toxicity_scores(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a null text counts as empty, a null doc_id is never held out.

    Equal texts have equal scores. Further columns of any name don't matter; an empty table gives no rows.
    """

    def scored(batches):
        for batch in slices(batches):
            score = model.score([features(x or "") for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = pick(docs, "doc_id", "text").select("doc_id", held_out("doc_id", MODULUS, REMAINDER).alias("held_out"), "text")
    return rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op10_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
