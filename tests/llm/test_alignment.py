import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from evidentia.llm import alignment as A

SCHEMA = "doc_id bigint, text string, h string, copies int, pairs string"


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def tokens(text, tokenizers):
    """(end, id) of both sides by the libraries on the whole text; none where the bytes differ."""
    a, b = tokenizers
    of = A.byte_chars()
    ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
    raw_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    said = (" " + (text or "")).encode()
    if not text or b"".join(raw_a) != said or b"".join(raw_b) != said:
        return [], []
    ends = lambda raw: [sum(map(len, raw[: k + 1])) for k in range(len(raw))]
    return list(zip(ends(raw_a), ids_a)), list(zip(ends(raw_b), ids_b))


def plain(rows, tokenizers):
    found, total = [], Counter()
    for doc, text, *_ in rows:
        a, b = tokens(text, tokenizers)
        links, start_a = [], 0
        for end_a, i in a:
            start_b = 0
            for end_b, j in b:
                if start_a < end_b and start_b < end_a:
                    links.append((i, j))
                start_b = end_b
            start_a = end_a
        shared = sorted({e for e, _ in a} & {e for e, _ in b})
        groups = [",".join(str(i) for e, i in a if lo < e <= hi) + "|" + ",".join(str(i) for e, i in b if lo < e <= hi) for lo, hi in zip([0, *shared], shared)]
        found.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        total.update(links)
    top = Counter()
    for (_, j), n in total.items():
        top[j] = max(top[j], n)
    return [(doc, na, nb, ng, len(ls), sum(total[x] == top[x[1]] for x in ls), sum(total[x] for x in ls), sha) for doc, na, nb, ng, ls, sha in found]


def texts():
    r = random.Random(5)
    odd = ["word", "don't", "we'll", "  ", "\n\n", "\t \n", "über", "naïve", "日本語", "1234", "!?", "...", "😀", "'s", " x", " ", "é", "_", "<s>", "<|endoftext|>", "</s>", "<unk>", "Supercalifragilistic", "▁", "​", "Ａ", "ﬁ", "́", "३४", "　", "\x85"]
    made = ["".join(r.choice(odd) + r.choice(["", " ", " "]) for _ in range(n)) for n in (1, 2, 3, 5, 8, 13, 40, 40, 90, 90, 150)]
    return made + [None, "", " ", "   a", "a   ", "a" * 300, " " * 90, "the cat " * 40, "the cat", "\n", "ab  cd \n ef\n gh \t", "x\x00y"]


def by_key(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("block, most, together", [(8192, 4_000_000, 400_000), (3, 50, 30)])
def test_equals_a_plain_loop_over_whole_texts(spark, tokenizers, monkeypatch, block, most, together):
    monkeypatch.setattr(A, "TOGETHER", together)
    rows = [(k, t, "x", 1, "y") for k, t in enumerate(texts())]
    rows += [rows[6], rows[6], (None, texts()[7], None, None, None), (None, None, None, None, None), rows[11]]
    out = A.align(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block, most_pairs=most)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert by_key(out.collect()) == by_key(plain(rows, tokenizers))


def test_long_texts_in_many_blocks(spark, tokenizers):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefghiéß", k=r.randrange(1, 12))) + r.choice(["", "", ",", ".\n", ".  "])
    rows = [(k, " ".join(word() for _ in range(n)), None, None, None) for k, n in enumerate((10, 30_000, 3000, 90_000))]
    out = {x.doc_id: x for x in A.align(spark.createDataFrame(rows, SCHEMA), block=1000).collect()}
    for k, text, *_ in rows:
        a, b = tokens_fast(text, tokenizers)
        assert (out[k].n_a, out[k].n_b) == (len(a), len(b)) and out[k].n_groups == len(set(a) & set(b)) and out[k].n_links == len(set(a) | set(b))


def tokens_fast(text, tokenizers):
    """Byte ends of both sides."""
    encoder = A._encoder(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    ends = lambda raw, ids: [*__import__("itertools").accumulate(len(raw[i]) for i in ids)]
    return ends(encoder.a.raw, tokenizers[0].encode(" " + text, add_special_tokens=False).ids), ends(encoder.b.raw, tokenizers[1].encode(text))


def test_common_characters_have_the_same_ids_in_both_libraries(tokenizers):
    level = A.ByteLevel(P.path("byte_bpe_50k.json"))
    assert level.fast is not None
    chars = [chr(c) for c in range(0xD800) if A.COMMON.fullmatch(chr(c))]
    for k in range(0, len(chars), 50):
        for form in ("{0}", "a{0}1{0}!{0}", "{0}{0} {0}b", "'{0}s\n{0}"):
            text = " ".join(form.format(c) for c in chars[k : k + 50])
            assert level.fast.encode_ordinary(" " + text) == tokenizers[0].encode(" " + text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert A.align(spark.createDataFrame([], SCHEMA)).count() == 0
