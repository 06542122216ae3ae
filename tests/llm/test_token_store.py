import random

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from evidentia.llm import token_store as ts

DOCS = "doc_id bigint, text string, ids string, shard int, n_tokens bigint"


def texts():
    r = random.Random(8)
    words = ["the", "The,", "nasıl", "Straße.", "don't", "we'll", "x1y2", "İstanbul", "été", "日本語", "<|endoftext|>", "<|startoftext|>", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", "<|STARTOFTEXT|>", "&&&", "a|b", "ΑΣ", "ﬁ", " nb sp ", "1234", "!!", "ẞ", "…", "re-do"]
    made = [(i, " ".join(r.choices(words, k=r.randrange(60))).replace(" ", r.choice([" ", "\n", "\t "]))) for i in range(120)]
    return made + [(500, None), (501, ""), (7, "tie"), (7, "tie"), (None, "no id")]


def test_round_trip_equals_the_library(spark, tmp_path):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = texts()
    df = spark.createDataFrame([(i, x, "z", 1, 2) for i, x in rows], DOCS).repartition(4)
    ts.write_store(ts.tokenize(df), str(tmp_path / "store"), segment=200, block=16)
    out = ts.read_store(spark, str(tmp_path / "store"), block=16).collect()
    want = sorted((str(i), tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for i, x in rows)
    assert sorted((str(r.doc_id), tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(bytes(r.ids)) // 4
        at += r.n_tokens
    order = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)


def test_lengths_are_optimal_and_limited():
    r = np.random.default_rng(0)
    counts = np.concatenate([r.integers(0, 50, 200), [1 << k for k in range(30)]])
    for limit in (9, 12, 20):
        n = ts.code_lengths(counts, limit).astype(int)
        assert ((n > 0) == (counts > 0)).all() and n.max() <= limit
        assert sum(2.0**-x for x in n if x) <= 1
    import heapq

    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        total += (x := heapq.heappop(heap) + heapq.heappop(heap))
        heapq.heappush(heap, x)
    assert int((ts.code_lengths(counts, 31).astype(int) * counts).sum()) == total


def test_packing_of_one_id_and_none():
    lengths = np.zeros(10, np.uint8)
    lengths[4] = 1
    payload, marks = ts.pack(np.full(700, 4), lengths, ts.canonical(lengths)[1])
    assert (ts.unpack(payload, marks, 700, *ts.decode_table(lengths)) == 4).all() and len(marks) == 3
    assert ts.pack(np.zeros(0, int), lengths, ts.canonical(lengths)[1])[0] == b""


def test_empty_table(spark, tmp_path):
    ts.write_store(ts.tokenize(spark.createDataFrame([], DOCS)), str(tmp_path / "store"))
    assert ts.read_store(spark, str(tmp_path / "store")).count() == 0


def test_special_tokens_as_the_library_takes_them():
    text = "hello <|endoftext|> world x<|startoftext|>y"
    want = Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids
    ids, n = ts._WordEncoder(P.path("word_bpe_49k.json")).texts([text])
    assert 49407 in want and 49406 in want and ids.tolist() == want + [2] and n.tolist() == [len(want) + 1]


def test_ids_of_four_bytes_and_a_very_long_text(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(k, r.integers(0, 200_000, n).astype("<u4").tobytes()) for k, n in enumerate((1, 700_000, 0, 50))]
    ts.write_store(spark.createDataFrame(rows, "doc_id bigint, ids binary"), str(tmp_path / "store"), width=4)
    assert {(x.doc_id, bytes(x.ids)) for x in ts.read_store(spark, str(tmp_path / "store")).collect()} == set(rows)
