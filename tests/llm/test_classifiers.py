import math
import random
import zlib

import numpy as np
import pytest

from evidentia.llm import pairwise_quality, pu_toxicity

DOCS = "doc_id bigint, text string, score int, held_out string"
LABELS = "doc_id bigint, quality int, toxic int, text int"


def corpus(n=900):
    r = random.Random(6)
    vocab = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        words = r.choices(vocab, k=r.randrange(60, 160))
        good, toxic = r.random() < 0.7, r.random() < 0.2
        if not good:
            words = [w + " |&&" for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        if toxic:
            for w in ("vileword", "nastyword"):
                words.insert(r.randrange(len(words)), w)
        docs.append((i, " ".join(words), 1, "x"))
        if i % 4:
            labels.append((i, int(good), int(toxic), 0))
    extra = [(5000, None, 1, "x"), (5001, "", 1, "x"), (None, "no id at all", None, None), docs[3]]
    return docs + extra, labels + [(None, 1, 1, 0), (7, None, None, 0)]


@pytest.mark.parametrize("module,name,column,modulus,remainder", [(pairwise_quality, "quality_scores", 1, 3, 1), (pu_toxicity, "toxicity_scores", 2, 5, 0)])
def test_held_out_accuracy(spark, module, name, column, modulus, remainder):
    docs, labels = corpus()
    model = module.fit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    out = getattr(module, name)(spark.createDataFrame(docs, DOCS), model).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) for r in out)
    truth = {x[0]: x[column] for x in labels if x[0] is not None and x[column] is not None}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


@pytest.mark.parametrize("module,name", [(pairwise_quality, "quality_scores"), (pu_toxicity, "toxicity_scores")])
def test_without_rows_or_labels(spark, module, name):
    docs, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert getattr(module, name)(docs, module.fit(docs, none)).count() == 0
    one = spark.createDataFrame([(1, "a b c", 1, "x")], DOCS)
    assert getattr(module, name)(one, module.fit(one, none)).count() == 1


def plain_risk(pos, unl, w, b, scale, prior):
    """The risk estimate in loops over documents and features; a step descends it, or climbs its second part where that is negative."""
    f = lambda x: b + sum(w[k] * scale[k] for k in x)
    loss = lambda z: 1 / (1 + math.exp(z))
    first = prior * sum(loss(f(x)) for x in pos) / len(pos)
    second = sum(loss(-f(x)) for x in unl) / len(unl) - prior * sum(loss(-f(x)) for x in pos) / len(pos)
    return first + second if second >= 0 else -second


def test_risk_gradient_equals_differences():
    r = np.random.default_rng(3)
    docs = lambda n: [np.sort(r.choice(12, r.integers(0, 6), replace=False)) for _ in range(n)]
    pos, unl = docs(5), docs(9) + [np.array([3, 4])] * 4
    scale = r.random(12)
    for prior, b in ((0.2, -1.0), (0.9, -3.0)):
        w = r.standard_normal(12)
        got = pu_toxicity.gradient(pu_toxicity.Rows.of(pos), pu_toxicity.Rows.of(unl), w, b, scale, prior)
        for k in range(13):
            at = lambda e: plain_risk(pos, unl, w + e * (np.arange(12) == k), b + e * (k == 12), scale, prior)
            assert abs(got[k] - (at(1e-5) - at(-1e-5)) / 2e-5) < 1e-6


def test_trainer_takes_the_plain_steps_and_repeated_rows_count():
    pos, unl = [np.array([0, 1])], [np.array([1, 2])] * 3 + [np.array([0])]
    scale, w = np.ones(3), np.zeros(4)
    t = pu_toxicity.Trainer(w, pos, scale, 0.3, 1, 0.1, decay=0.0)
    assert t.run(iter(unl)) == 4 and t.steps == pu_toxicity.STEPS
    m, v = np.zeros(4), np.zeros(4)
    for k in range(1, pu_toxicity.STEPS + 1):
        eye = np.eye(4)
        g = np.array([(plain_risk(pos, unl, (w + 1e-6 * e)[:3], (w + 1e-6 * e)[3], scale, 0.3) - plain_risk(pos, unl, (w - 1e-6 * e)[:3], (w - 1e-6 * e)[3], scale, 0.3)) / 2e-6 for e in eye])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    assert np.abs(t.w - w).max() < 1e-2
    once = pu_toxicity.Trainer(np.zeros(4), pos, scale, 0.3, 1, 0.1, decay=0.0)
    once.run(iter(unl[2:]))
    assert np.abs(once.w - t.w).max() > 0.05


def test_most_repeated_word_is_sought_in_the_whole_text():
    text = "one two three four five six seven eight " + "late " * 12
    assert pairwise_quality.figures(text)[11] == 12 / 20


def test_pair_gradient_equals_differences_of_plain_loss():
    r = np.random.default_rng(1)
    z, n = r.standard_normal((7, 3)), 7
    rows = [np.sort(r.choice(9, 4, replace=False)).astype(np.int32) for _ in range(n)]
    values = [r.random(4).astype(np.float32) for _ in range(n)]
    better, worse = np.array([0, 1, 2, 0, 0]), np.array([3, 4, 5, 6, 6])
    w, v = r.standard_normal(3), np.zeros(pairwise_quality.WORDS)
    v[:9] = r.standard_normal(9)

    def loss(w, v):
        raw = [sum(a * b for a, b in zip(z[k], w)) + sum(v[i] * x for i, x in zip(rows[k], values[k])) for k in range(n)]
        fit = sum(math.log(1 + math.exp(raw[b] - raw[a])) for a, b in zip(better, worse)) / len(better)
        return fit + pairwise_quality.RIDGE / 2 * (w @ w) + pairwise_quality.WORD_RIDGE / 2 * (v @ v)

    gw, gv = pairwise_quality.loss_gradient(z, pairwise_quality.Sparse.of(rows, values), w, v, better, worse)
    step = lambda x, k: x + 1e-5 * (np.arange(len(x)) == k)
    assert np.allclose(gw, [(loss(step(w, k), v) - loss(w - step(w, k) + w, v)) / 2e-5 for k in range(3)], atol=1e-5)
    assert np.allclose(gv[:9], [(loss(w, step(v, k)) - loss(w, v - step(v, k) + v)) / 2e-5 for k in range(9)], atol=1e-5)


def test_words_alone_can_tell_quality(spark):
    r = random.Random(1)
    text = lambda good: " ".join(r.choices(["fine", "well", "sound", "word", "text"] if good else ["poor", "bad", "vague", "word", "text"], k=80))
    docs = [(i, text(i % 3 > 0), 1, "x") for i in range(600)]
    labels = [(i, int(i % 3 > 0), 0, 0) for i in range(600)]
    df = spark.createDataFrame(docs, DOCS)
    out = pairwise_quality.quality_scores(df, pairwise_quality.fit(df, spark.createDataFrame(labels, LABELS))).collect()
    assert np.mean([x.predicted == int(x.doc_id % 3 > 0) for x in out if x.held_out]) > 0.97


def test_every_labelled_row_trains(spark):
    """Rows dealt over several tasks, the rarer label dealt or known to all: each row is seen, and the threshold is the quantile of all."""
    docs, labels = corpus()
    docs, labels = docs[:900], labels[:-2]
    df = spark.createDataFrame(docs, DOCS)
    truth = {i: q == 1 for i, q, *_ in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    texts = {d[0]: d[1] for d in docs}
    x = np.array([pairwise_quality.figures(texts[i]) for i in truth])
    for few in (0, 512):
        model = pairwise_quality.fit(df.repartition(3), spark.createDataFrame(labels, LABELS), share=100, few=few)
        assert np.allclose(model.centre, x.mean(axis=0)) and np.allclose(model.spread, x.std(axis=0) + 1e-6)
        found = [pairwise_quality.features(texts[i]) for i in truth]
        raw = np.sort(model.raw(x, pairwise_quality.Sparse.of([f[1] for f in found], [f[2] for f in found])))
        bad = sum(not g for g in truth.values())
        assert np.isclose(model.threshold, (raw[bad - 1] + raw[bad]) / 2) and np.isclose(model.scale * 4, raw.std(), atol=1e-6)
        seen = {int(k) for f in found for k in f[1]}
        assert set(np.flatnonzero(model.words)) == seen  # no word of a training row is left out


def test_values_at_ranks_with_ties(spark):
    r = random.Random(2)
    values = [float(r.choice([1, 1, 1, 2, 5, 9, r.random()])) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "raw double").repartition(7)
    ranks = [1, 2, 250, 251, 499, 500]
    assert pairwise_quality.at_ranks(df, "raw", ranks) == [sorted(values)[k - 1] for k in ranks]
