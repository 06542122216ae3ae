"""Quality by pairwise ranking: a Bradley-Terry model over text figures and words.

Every pair of a good and a bad training document is a preference; the model's score of a document is linear in its features and
the chance that one is preferred is the logistic function of the difference. Features are figures of the text (length, repeats,
signs) and its hashed words, each word by its share of the text's words as a vector of length one. A score quantile of the training
documents, at the share of bad ones, is the threshold: a score of 0.5.

All labelled documents outside the held-out fold train. They are dealt over tasks; each takes Adam steps on the loss of all pairs of
its own rows, and the weights of the tasks are averaged by their rows. Centre, spread and threshold are figures of all training rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm.common import materialize, pick, slices, table
from evidentia.llm.labelled import held_out, labelled
from evidentia.llm.quality_rules import TextStats

MODULUS, REMAINDER = 3, 1
MARKS = b".,;:!?\"'()[]{}&$%#*|<>-_"
#: Training rows of a task, about, and rows of the rarer label that it needs; where that label has no more than FEW rows, each task has
#: them all.
SHARE, LEAST, FEW = 2_000, 64, 512
#: Rows of hashed words, and the weight of the penalty on theirs and on the figures' squares.
WORDS, WORD_RIDGE, RIDGE = 1 << 15, 1e-2, 1e-3


def features(text: str) -> tuple[list[float], np.ndarray, np.ndarray]:
    """Figures of the whole text; rows and values of its distinct words, lower-cased and without marks."""
    s = TextStats(text)
    words, chars, lines = max(1, s.n_words), max(1, s.word_chars), max(1, len(s.lines))
    counts = Counter(s.words)
    top = max(counts.values(), default=0)  # a text of one repeated word
    rows = np.fromiter((zlib.crc32(w.lower().strip(MARKS)) % WORDS for w in counts), np.int32, len(counts))
    values = np.sqrt(np.fromiter(counts.values(), np.float32, len(counts)))
    return _figures(s, words, chars, lines, top, len(counts)), rows, values / max(1.0, float(np.sqrt((values * values).sum())))


def figures(text: str) -> list[float]:
    return features(text)[0]


def _figures(s: TextStats, words: int, chars: int, lines: int, top: int, distinct: int) -> list[float]:
    return [
        np.log1p(s.n_words),
        min(3.0, s.n_symbols / words),
        s.n_upper / chars,
        s.n_dup_lines / lines,
        s.n_repeat_words / words,
        distinct / words,
        min(20.0, s.word_chars / words),
        min(3.0, s.text.count("!") / words),
        min(3.0, s.text.count("|") / words),
        min(1.0, sum(map(s.text.count, "0123456789")) / chars),
        min(1.0, sum(map(s.text.count, ".,;:")) / words),
        top / words,
    ]


@dataclass
class Sparse:
    """Word values of documents as (document, row, value)."""

    n: int
    doc: np.ndarray
    row: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray], values: list[np.ndarray]) -> Sparse:
        none = np.zeros(0, np.float32)
        return cls(len(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate([none.astype(np.int32), *rows]), np.concatenate([none, *values]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, w[self.row] * self.value, self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, g[self.doc] * self.value, WORDS)


@dataclass
class Ranking:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    words: np.ndarray
    threshold: float
    scale: float

    def raw(self, x: np.ndarray, words: Sparse) -> np.ndarray:
        return ((x - self.centre) / self.spread) @ self.weights + words.dot(self.words)

    def score(self, x: np.ndarray, words: Sparse) -> np.ndarray:
        """0 to 1; 0.5 at the threshold."""
        return 1 / (1 + np.exp(-np.clip((self.raw(x, words) - self.threshold) / self.scale, -30, 30)))


def loss_gradient(z: np.ndarray, words: Sparse, w: np.ndarray, v: np.ndarray, better: np.ndarray, worse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients, by the weights of figures and of words, of the mean logistic loss of the pairs' differences and the penalties."""
    raw = z @ w + words.dot(v)
    p = 1 / (1 + np.exp(np.clip(raw[better] - raw[worse], -30, 30))) / len(better)  # the chance given to the wrong order
    g = np.bincount(worse, p, len(z)) - np.bincount(better, p, len(z))
    return g @ z + RIDGE * w, words.back(g) + WORD_RIDGE * v


def train(z: np.ndarray, words: Sparse, good: np.ndarray, rounds: int = 150, rate: float = 0.1) -> np.ndarray:
    """Weights of figures and words after Adam steps on the loss of all pairs of a good and a bad row, of which there are both."""
    dim = z.shape[1]
    better, worse = (x.ravel() for x in np.meshgrid(np.flatnonzero(good), np.flatnonzero(~good)))
    w = np.zeros(dim + WORDS)
    m, q = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, rounds + 1):
        g = np.concatenate(loss_gradient(z, words, w[:dim], w[dim:], better, worse))
        m, q = 0.9 * m + 0.1 * g, 0.99 * q + 0.01 * g * g
        w -= rate * (1 - (t - 1) / rounds) * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.99**t)) + 1e-6)
    return w


def _columns(batches):
    """(figures, rows of words, their values, whether good) of each batch of marks."""
    for batch in batches:
        if batch.num_rows:
            lists = [[x.values.to_numpy(zero_copy_only=False) for x in batch.column(k)] for k in (1, 2, 3)]
            yield np.stack(lists[0]), lists[1], lists[2], batch.column(0).to_numpy() == 1


def _joined(parts) -> tuple[np.ndarray, Sparse, np.ndarray]:
    x, rows, values, good = zip(*parts)
    return np.concatenate(x), Sparse.of(sum(rows, []), sum(values, [])), np.concatenate(good)


def at_ranks(values: DataFrame, col: str, ranks: list[int]) -> list[float]:
    """The values of the given ranks, from 1, in order: equal ones are counted, and ranges of them summed; only the range of a rank is sorted."""
    tallied = materialize(values.groupBy(col).agg(F.count("*").alias("n")).repartitionByRange(col).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = sorted(tuple(r) for r in tallied.groupBy("range").agg(F.sum("n")).collect())
    found = []
    for rank in ranks:
        before = 0
        for own, n in sizes:
            if before + n >= rank:
                break
            before += n
        upto = F.sum("n").over(Window.partitionBy("range").orderBy(col))
        found.append(tallied.where(F.col("range") == own).withColumn("upto", upto).where(F.col("upto") >= rank - before).agg(F.min(col)).first()[0])
    return found


def fit(docs: DataFrame, labels: DataFrame, share: int = SHARE, few: int = FEW) -> Ranking:
    """The model of all labelled rows outside the held-out fold; of several labels of an id the largest counts.

    Features are taken once and written. Without both labels every score is 0.5. Rows are dealt by their order in the table, so another
    partitioning gives slightly other weights where there are several tasks.
    """

    def taken(batches):
        for batch in slices(batches):
            found = [features(x) for x in batch.column(0).to_pylist()]
            columns = zip(*found) if found else ((), (), ())
            kinds = (pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], ["label", "figures", "rows", "values"])

    dim = len(figures(""))
    marks = labelled(docs, labels, "quality", MODULUS, REMAINDER).select("text", "label")
    marks = materialize(marks.mapInArrow(taken, "label int, figures array<double>, rows array<int>, values array<float>"), "quality-features")
    each = [f(F.col("figures")[k]) for f in (F.avg, F.stddev_pop) for k in range(dim)]
    n, n_good, *found = marks.agg(F.count("*"), F.count_if(F.col("label") == 1), *each).first()
    n_bad = n - n_good
    if not (n_good and n_bad):
        return Ranking(np.zeros(dim), np.ones(dim), np.zeros(dim), np.zeros(WORDS), 0.0, 1.0)
    centre, spread = np.array(found[:dim]), np.array(found[dim:]) + 1e-6
    rare, is_rare = min(n_good, n_bad), (F.col("label") == 1) == F.lit(n_good < n_bad)
    all_have = list(_columns(marks.where(is_rare).toArrow().to_batches())) if rare <= few else []
    tasks = max(1, n // share if all_have else min(n // share, rare // LEAST))

    def learned(batches):
        own = list(_columns(batches))
        if own:
            x, words, good = _joined(own + all_have)
            rows = sum(len(p[0]) for p in own)
            w = train((x - centre) / spread, words, good)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*(w[at] * rows), rows], pa.float64())], ["at", "w"])

    dealt = marks.where(~is_rare) if all_have else marks
    got = dealt.repartition(tasks).mapInArrow(learned, "at int, w double").groupBy("at").agg(F.sum("w").alias("w")).toArrow()  # a row a weight
    sums = np.zeros(dim + WORDS + 1)  # the last: rows
    sums[got["at"].to_numpy()] = got["w"].to_numpy()
    model = Ranking(centre, spread, sums[:dim] / sums[-1], sums[dim:-1] / sums[-1], 0.0, 1.0)

    def raw(batches):
        for part in _columns(batches):
            x, words, _ = _joined([part])
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(x, words))], ["raw"])

    raws = materialize(marks.mapInArrow(raw, "raw double"), "quality-raw")
    model.threshold = sum(at_ranks(raws, "raw", [n_bad, n_bad + 1])) / 2
    model.scale = (raws.agg(F.stddev_pop("raw")).first()[0] + 1e-9) / 4
    return model


def quality_scores(docs: DataFrame, model: Ranking) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a null text counts as empty, a null doc_id is never held out.

    Equal texts have equal scores. Further columns of any name don't matter; an empty table gives no rows.
    """

    def scored(batches):
        for batch in slices(batches):
            found = [features(x or "") for x in batch.column(2).to_pylist()]
            x, rows, values = zip(*found) if found else ((), (), ())
            score = model.score(np.array(x, float).reshape(len(found), -1), Sparse.of(list(rows), list(values))) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = pick(docs, "doc_id", "text").select("doc_id", held_out("doc_id", MODULUS, REMAINDER).alias("held_out"), "text")
    return rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op8_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
