import random
from collections import Counter

import numpy as np

from evidentia.llm import mixing

DOCS = "doc_id bigint, text string, source string, size string, target int"


def corpus():
    r = random.Random(2)
    names = ["b", "a", "Z", None, "é", "tiny", ""]
    rows = []
    for i in range(900):
        name = "a" if i % 3 == 0 else r.choice(names)
        n = 1 if name == "tiny" else r.choice([0, 1, 5, 30, 300])
        rows.append((i, None if i % 97 == 0 else " ".join(["w"] * n), name, "x", 1))
    return rows + [rows[5], rows[5], (None, "no id", "b", None, None)]


def levels(sizes, weights):
    """Targets by bisection of the water level."""
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * s, mid * w) for s, w in zip(sizes, weights)) < sum(sizes) else (lo, mid)
    return [min(3 * s, lo * w) for s, w in zip(sizes, weights)]


def test_targets_and_takes(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df.repartition(5), min_block_words=500, shards=7).collect()
    again = mixing.mix(df.repartition(2), min_block_words=500, shards=7).collect()
    key = lambda r: (str(r.doc_id), str(r.text), r.mix)
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(rows)
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[(s is None, s or "")] += len((t or "").split())
    order = sorted(sizes)
    want = dict(zip(order, levels([sizes[k] for k in order], [1 + i % 3 for i in range(len(order))])))
    taken = Counter()
    for r in out:
        k = (r.source is None, r.source or "")
        assert r.mix.size == len((r.text or "").split()) and r.mix.source_size == sizes[k]
        assert abs(r.mix.target - want[k]) < 1e-6 * max(1, want[k]) and 0 <= r.mix.taken <= 3 * r.mix.size
        taken[k] += r.mix.taken
    assert all(abs(taken[k] - want[k]) <= 3 for k in order)


def test_shards_take_what_the_tree_deals(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    plan = mixing.make_plan(df, min_block_words=500, shards=7)
    names = [(r.missing, r.src) for r in plan.sources.itertuples()]
    seen = {}
    for r in mixing.mix(df, plan).collect():
        for d in r.mix.draws:
            at = (names.index((r.source is None, r.source or "")), d["pass"], d.block)
            assert seen.setdefault(at, d.shard) == d.shard  # a draw of a block goes to one shard
    drawn = np.zeros_like(plan.quotas)
    for (s, _, _), j in seen.items():
        drawn[j, s] += 1
    empty = Counter()  # draws of blocks without words leave no row
    for r in plan.draws.itertuples():
        for p, j in zip(r.passes_in, r.shards_in):
            empty[(j, r.s)] += (r.s, p, r.block) not in seen
    assert (drawn + np.array([[empty[(j, s)] for s in range(len(names))] for j in range(7)]) == plan.quotas).all()
    assert sum(empty.values()) < drawn.sum() / 2


def test_number_of_shards_follows_the_words(spark):
    df = spark.createDataFrame([(k, "w " * 30_000, "ab"[k % 2]) for k in range(90)], "doc_id bigint, text string, source string")
    assert len(mixing.make_plan(df).quotas) == 2_700_000 // mixing.SHARD_WORDS and len(mixing.make_plan(df, max_blocks=2).quotas) == 2


def test_clashing_names_are_kept(spark):
    names = ["size", "draws", "h", "shard", "turn", "row", "block", "s", "missing", "src", "__shard", "__size"]
    df = spark.createDataFrame([(k, "some words here", "a", *range(len(names))) for k in range(20)], "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = mixing.shards(df, n=3, min_block_words=10).collect()
    assert out and all(tuple(r)[3:] == tuple(range(len(names))) for r in out)
    assert all(r.mix.size == 3 for r in mixing.mix(df).collect())


def test_fill_stops_at_three_times():
    got = mixing.fill([10, 1000, 0], [1, 1, 1])
    assert got == [30.0, 980.0, 0.0] and mixing.fill([], []) == [] and mixing.fill([0, 0], [1, 2]) == [0.0, 0.0]


def test_tree_keeps_quotas():
    q = np.array([1000, 3, 0, 250])
    got = mixing.split(q, 6, 1)
    assert (got.sum(axis=0) == q).all() and got.sum(axis=1).max() - got.sum(axis=1).min() <= 1 and (got >= 0).all()


def test_shards_hold_whole_documents(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    out = mixing.shards(df, n=5, min_block_words=500)
    assert out.columns == df.columns
    texts = {(r.doc_id, r.text) for r in df.collect()}
    counts = Counter((r.doc_id, r.text) for r in out.collect())
    assert counts and set(counts) <= texts and max(v for k, v in counts.items() if k[0] != 5) <= 3


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
