"""The pipeline's stages, one after the other, against brute force on each stage's own input."""

import random

import public_tokenizers as P

import corpus_pipeline
from evidentia.llm import byte_bpe
from evidentia.llm.common import materialize
from tests.llm import test_quality_rules, test_simhash, test_substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark):
    r = random.Random(12)
    vocab = [f"w{k}q" for k in range(700)]
    sentence = lambda: " ".join(r.choices(vocab, k=r.randrange(3, 14))).capitalize() + r.choice([". ", ", ", ".\n"])
    passage = "".join(sentence() for _ in range(8))
    rows = []
    for i in range(60):
        text = "".join(sentence() for _ in range(14))
        if i % 6 == 0:
            text = text + "\n" + passage
        if i % 7 == 3:
            text = text.upper()
        rows.append((i, text))
    rows += [(100 + k, rows[k][1].replace("w1q", "other", 1)) for k in range(8)] + [(200, None), (201, ""), (202, rows[1][1])]
    return spark.createDataFrame([(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)


def test_stages(spark):
    docs = corpus(spark)
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "mixing", "byte_bpe"]
    ids = lambda df: sorted(r.doc_id for r in df.collect())

    good = materialize(stages["quality_rules"](spark, docs, ""), "t")
    assert good.columns == COLUMNS and ids(good) == sorted(r.doc_id for r in docs.collect() if test_quality_rules.slow(r.text)[-1])

    single = materialize(stages["simhash_near_dedup"](spark, good, ""), "t")
    groups = test_simhash.brute([(r.doc_id, r.text) for r in good.collect()])
    assert single.columns == COLUMNS and ids(single) == sorted({c for *_, c in groups}) and single.count() < good.count()

    clean = materialize(stages["substring_dedup"](spark, single, ""), "t")
    want = test_substring_dedup.brute([(r.doc_id, r.text) for r in single.collect()])
    assert clean.columns == COLUMNS and {r.doc_id: r.text for r in clean.collect()} == want
    assert all(r.n_chars == len(r.text) for r in clean.collect()) and want != {r.doc_id: r.text for r in single.collect()}

    mixed = materialize(stages["mixing"](spark, clean, ""), "t")
    known = {r.doc_id: r.text for r in clean.collect()}
    assert mixed.columns == COLUMNS and all(known[r.doc_id] == r.text for r in mixed.collect())
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert abs(words(mixed) - words(clean)) < 0.1 * words(clean)

    encoder = byte_bpe._encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)[0]
    out = stages["byte_bpe"](spark, mixed, "").collect()
    assert sorted(r.doc_id for r in out) == ids(mixed)
    assert all(r.ids == encoder.encode_ordinary(known[r.doc_id]) and r.n_tokens == len(r.ids) for r in out)


def test_empty_documents(spark):
    docs = corpus(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
