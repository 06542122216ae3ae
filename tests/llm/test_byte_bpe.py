import hashlib
import random

import public_tokenizers as P
import tiktoken
import numpy as np

from evidentia.llm import byte_bpe

DOCS = "doc_id bigint, text string, h string, k int, ids string"


def expected(text):
    ids = byte_bpe._encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)[0].encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def texts():
    r = random.Random(1)
    odd = ["word", "don't", "we'll", "  ", "\n\n", "\t \n", "über", "naïve", "日本語", "1234", "!?", "...", "😀", "'s", " x", " ", "é", "_"]
    made = ["".join(r.choice(odd) + r.choice(["", " ", " "]) for _ in range(n)) for n in (1, 5, 40, 90, 200, 400, 800)]
    return made + [None, "", "a" * 500, " " * 300, "a " * 150 + " " * 90 + "b" * 100, "ab " * 400, "\n\n" * 70 + "x"]


def test_stitched_chunks_equal_whole_texts(spark):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts())]
    rows += [rows[5], (None, texts()[6], None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for chunk, overlap, deal in ((64, 16, 400), (50, 49, 90), (1 << 14, 512, 1 << 16), (16, 12, 64)):
        out = byte_bpe.encode(df, keep_ids=True, chunk=chunk, overlap=overlap, deal=deal, deal_overlap=overlap)
        got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()), key=str)
        assert got == sorted(((i, *expected(t)) for i, t, *_ in rows), key=str)
        many = {r.doc_id: r.n_chunks for r in out.collect()}
        assert many[0] == 1 and (many[6] > 5) == (chunk < 100)
    raw = {r.doc_id: bytes(r.raw) for r in byte_bpe.decode(out).collect()}
    assert all(raw[i] == (t or "").encode() for i, t, *_ in rows)


def test_ordinary_long_texts_come_in_chunks(spark):
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choices("abcdefghi", k=r.randrange(1, 9))) + r.choice(["", ",", ".", "\n"]) for _ in range(n))
    rows = [(k, prose(n)) for k, n in enumerate((50, 3000, 30_000, 200_000))]
    out = {x.doc_id: x for x in byte_bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k, text in rows:
        assert (out[k].n_tokens, out[k].ids_sha256, out[k].decoded_sha256) == expected(text)
        assert abs(out[k].n_chunks - max(1, len(text) / byte_bpe.CHUNK)) <= 1 + len(text) / byte_bpe.DEAL


def test_empty_table(spark):
    assert byte_bpe.encode(spark.createDataFrame([], DOCS)).count() == 0
