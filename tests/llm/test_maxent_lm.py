import math
import random
import zlib
from collections import Counter

import numpy as np

from evidentia.llm import maxent_lm as lm

DOCS = "doc_id bigint, text string, held string, block int, codes int"


def corpus():
    r = random.Random(9)
    next_of = {k: r.sample(range(60), 3) for k in range(60)}
    rows = []
    for i in range(500):
        k, words = r.randrange(60), []
        for _ in range(r.randrange(5, 90)):
            words.append(f"Word{k}" if r.random() < 0.97 else f"rare{r.randrange(10**6)}")
            k = r.choice(next_of[k])
        rows.append((i, " ".join(words)))
    return rows + [(900, None), (901, ""), (None, "word1 word2"), (3, "again"), (3, "again")]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_base_scores_and_gain(spark, monkeypatch):
    rows = corpus()
    docs = [(i, [w.decode() for w in (t or "").encode().lower().split()] + [None]) for i, t in rows]
    c = Counter(w for i, d in docs if not held(i) for w in d)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(d), sum(c[w] > 0 for w in d), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in d), 6)) for i, d in docs)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)
    out = lm.scores(df.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    away = [r for r in out if r.held_out]
    assert len(away) > 30 and sum(r.score for r in away) > sum(r.base_score for r in away) + 0.1 * sum(r.n_tokens for r in away)


def test_model_is_a_distribution(spark):
    rows = corpus()
    counted = lm.counted_blocks(spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS).repartition(2))
    lex = lm.lexicon(counted)
    w = lm.train(counted, lex)
    p = lm.class_shares(lm.class_bias(lex), w, [np.arange(50)] * 2)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    # within a class: all known words and one unknown
    assert lex.n == lex.class_n.sum() and lex.v == lex.class_v.sum()


def pairs():
    """Texts of pairs: the second word of one suffix class follows from the first."""
    r = random.Random(3)
    return [(i, " ".join(f"a{k}left b{k}ight" for k in r.choices(range(400), k=60))) for i in range(1200)]


def test_words_of_a_class_are_told_apart_by_the_word_before(spark):
    out = lm.scores(spark.createDataFrame([(i, t, "x", 1, 2) for i, t in pairs()], DOCS).repartition(3)).collect()
    away = [r for r in out if r.held_out]
    # each word is one of 400 equally frequent ones, which counts can't tell apart: 2.6 for each of 120 words but the single ones
    assert sum(r.score for r in away) > -300 * len(away)


def test_words_of_a_class_and_its_unknown_add_up_to_one(spark):
    counted = lm.counted_blocks(spark.createDataFrame([(i, t, "x", 1, 2) for i, t in corpus()], DOCS).repartition(2))
    lex = lm.lexicon(counted)
    mass = lm.masses(counted, lex)
    places, mass = lm.balanced(mass, lex.bits)
    weights = lm.learn(counted, lex, places, mass)[1].astype(np.float32)
    n = lex.class_n[lm.SINGLES :] + lex.class_v[lm.SINGLES :] + 1
    assert np.allclose(mass.reshape(lm.SUFFIXES, -1).sum(axis=1), n)
    leaf = np.arange(lm.SUFFIXES << lex.bits)
    word = np.full(len(leaf), 12345)
    p = np.exp(lm.inner_scores(lm.levels(mass, lex.bits), weights, (word, word + 1), leaf))
    assert np.allclose((p * (mass > 0)).reshape(lm.SUFFIXES, -1).sum(axis=1), 1, atol=1e-4)  # no word has an empty leaf


def test_empty_table(spark):
    assert lm.scores(spark.createDataFrame([], DOCS)).count() == 0


def test_inner_step_equals_plain_loops():
    """AdaGrad over the digits of leaves, against loops over digits, templates and tokens."""
    r = np.random.default_rng(4)
    bits, n = 6, 256
    mass = r.integers(0, 3, lm.SUFFIXES << bits).astype(np.float32)
    mass[:: 1 << bits] += 1
    steps = lm.levels(mass, bits)
    assert [(shift, width) for shift, width, *_ in steps] == [(4, 2), (0, 4)]
    leaf = r.choice(np.flatnonzero(mass), 60)
    words = r.integers(0, 9, 60), r.integers(0, 9, 60)
    inner = lm.Inner(n)
    weights, squares = np.zeros((n, 16)), np.zeros(n)
    contexts = lm.inner_contexts(words)
    for _ in range(3):
        for shift, width in ((4, 2), (0, 4)):
            found = []
            for t in range(60):
                node = int(leaf[t]) >> (shift + width)
                own = [mass[((node << width | d) << shift) : ((node << width | d) + 1 << shift)].sum() for d in range(1 << width)]
                if sum(m > 0 for m in own) < 2:
                    continue
                key = ((node << 5 | shift) * 0x9E3779B1) % 2**32
                mixed = [((int(c[t]) ^ key) * 0x85EBCA77) % 2**32 for c in contexts]
                rows = [(x ^ x >> 15) & (n - 1) for x in mixed]
                odds = [m * math.exp(sum(weights[k, d] for k in rows)) for d, m in enumerate(own)]
                g = np.array([o / sum(odds) for o in odds] + [0.0] * (16 - len(odds)))
                g[int(leaf[t]) >> shift & (1 << width) - 1] -= 1
                found.append((rows, g))
            for k in range(3):
                for row in {rows[k] for rows, _ in found}:
                    total = sum(g for rows, g in found if rows[k] == row)
                    squares[row] += (total**2).sum()
                    weights[row] -= 0.4 * total / np.sqrt(squares[row] + 1)
        inner.descend(steps, words, leaf, 0.4)
    assert np.allclose(inner.weights, weights, atol=1e-3) and inner.squares.sum() > 0


def test_a_text_is_scored_as_the_product_of_its_parts(spark):
    """The score of a text from the weights, by loops: class and digits of each token, and its share of its place."""
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS).coalesce(1)
    counted = lm.counted_blocks(df)
    lex = lm.lexicon(counted)
    places, mass = lm.balanced(lm.masses(counted, lex), lex.bits)
    outer, inner = (w.astype(np.float32) for w in lm.learn(counted, lex, places, mass))
    got = {r.doc_id: r.score for r in lm.scores(df).collect()}
    b = next(x for batch in counted.select("doc_ids", "held", "sizes", "codes", "suffix", *lm.DICTIONARY).toArrow().to_batches() for x in lm._rows(batch))
    kind, word, leaf = lex.describe(b, places)
    ends = np.cumsum(b.sizes)
    for k in (4, 40, 77):
        own, total = b.codes[ends[k] - b.sizes[k] : ends[k]], 0.0
        for t, c in enumerate(own):
            w1, w2 = (word[own[t - j]] if t >= j else lm.SUFFIXES for j in (1, 2))
            k1, k2 = (kind[own[t - j]] if t >= j else lm.CLASSES for j in (1, 2))
            context = np.array([(w1 * (lm.CLASSES + 1) + k1) * (lm.CLASSES + 1) + k2])
            z = lm.class_bias(lex) + sum(outer[f[0]] for f in lm.features(context, len(outer)))
            total += z[kind[c]] - math.log(np.exp(z.astype(float)).sum())
            if kind[c] < lm.SINGLES:
                continue
            shift = lex.bits
            contexts = lm.inner_contexts((np.array([w1]), np.array([w2])))[:, 0]
            while shift:
                width = shift % lm.DIGIT or lm.DIGIT
                shift -= width
                node = int(leaf[c]) >> (shift + width)
                own_mass = [mass[((node << width | d) << shift) : ((node << width | d) + 1 << shift)].sum() for d in range(1 << width)]
                mixed = [((int(x) ^ ((node << 5 | shift) * 0x9E3779B1) % 2**32) * 0x85EBCA77) % 2**32 for x in contexts]
                at = [(x ^ x >> 15) & (len(inner) - 1) for x in mixed]
                odds = [float(m) * math.exp(sum(float(inner[a, d]) for a in at)) for d, m in enumerate(own_mass)]
                total += math.log(odds[int(leaf[c]) >> shift & (1 << width) - 1] / sum(odds))
            total += math.log((b.totals[c] + 1) / max(mass[leaf[c]], 1))
        assert abs(got[b.doc_ids[k].as_py()] - total / math.log(10)) < 2e-3 * len(own)


def test_places_follow_the_counts():
    r = np.random.default_rng(6)
    mass = np.concatenate([r.zipf(1.5, 1 << 6).clip(0, 10**6) for _ in range(lm.SUFFIXES)]).astype(np.float32)
    places, own = lm.balanced(mass, 6)
    for k in range(lm.SUFFIXES):
        m = mass[k << 6 : (k + 1) << 6]
        order = sorted(range(len(m)), key=lambda i: (-m[i], i))
        done = 0.0
        for i in order:
            assert places[(k << 6) + i] == (k << 6) + min(63, int((done + m[i] / 2) / m.sum() * 64))
            done += float(m[i])
        assert abs(own[k << 6 : (k + 1) << 6].sum() - m.sum()) < 1e-2 * m.sum()


def test_what_belongs_to_a_row_is_summed_in_its_order():
    r = np.random.default_rng(5)
    rows = np.concatenate([r.integers(0, 40, 300), [1 << 21] * 3, [0]])
    g = r.standard_normal((len(rows), 4)).astype(np.float32)
    g[rows == 7] *= np.float32(10.0) ** r.integers(-6, 6, (rows == 7).sum())[:, None].astype(np.float32)
    own, total = lm.grouped(rows, g)
    assert own.tolist() == sorted(set(rows.tolist()))
    for k, row in enumerate(own):
        assert (total[k] == np.add.reduceat(g[rows == row], [0], axis=0)[0]).all()
