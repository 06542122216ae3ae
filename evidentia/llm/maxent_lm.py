"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

log P(word | history) = log P(class | history) + log P(word | class, history). The SINGLES most frequent words are classes of
their own, all others fall into SUFFIXES classes by a hash of their last bytes. The class softmax is linear in hashed features:
the word before, and the two classes before. Within a class the digits of a word's place, of DIGIT bits, are chosen one after the other, each
by a softmax over its values; its features are the word before, the two words before and the word before the last (a skip), each
paired with the digits so far, and its bias holds the training counts plus one, with one more word for all unknown ones. Places lie
in the order of counts, spaced by them, so that a word has about as many digits as its share of the class asks for, BITS bits at most;
words that share a place go by their counts. Every training word is a context, and the numbers of rows follow the vocabulary, up to
LARGEST weights, beyond which features share rows.

Texts become blocks of whole documents in a dictionary of their own; corpus counts are joined to the dictionaries, not to the
tokens. Trainers run gradient steps over their blocks and their weights are averaged, each row by its visits or by the squares of its
gradients. Another partitioning
of the table makes other blocks and so slightly other scores.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import materialize, pick, slices, table, text_or_empty
from evidentia.llm.labelled import held_out
from evidentia.operators.graph import hot_join

MODULUS, REMAINDER = 7, 2
BLOCK_TOKENS = 4_000_000
SINGLES, SUFFIXES = 16, 16
CLASSES = SINGLES + SUFFIXES
#: Bits of a word's place within its class, at most, and of a digit of it.
BITS, DIGIT = 16, 4
WIDE = 1 << DIGIT
#: Class rows, at least; above, as many as 1 << (bits - 2), and 1 << (bits + 6) weights within classes, 4 * ROWS at least.
ROWS, LARGEST = 1 << 14, 1 << 22
#: Tokens of a gradient step, at most, and steps that a block is divided into at least, where it has tokens enough.
STEP, LEAST_STEPS = 1 << 15, 64
#: Tasks that train side by side, at most; each passes once over its share of all training tokens, SHARE blocks or more, so
#: that what they send stays in proportion to the input.
TRAINERS = 1024
SHARE = 3
PIECES = 64
#: The least probability that 32 bits hold.
LEAST = np.float32(1e-37)
DICTIONARY = ("totals", "lead", "vocab")
#: Hash of the end of a text; no word holds a blank.
END = int(np.uint64(xxhash.xxh64_intdigest(b" ")).view(np.int64))


def _blocks(batches):
    def dictionary():
        """Numbers words as they come; 0 is the end of a text."""
        index = defaultdict(count().__next__)
        index[None]
        return index

    index, codes, ids, held, sizes = dictionary(), array("I"), [], [], []

    def flush():
        each = np.frombuffer(codes, np.uint32)
        raw = [w for w in index if w is not None]
        vocab = np.array([0, *map(xxhash.xxh64_intdigest, raw)], np.uint64).view(np.int64)
        vocab[0] = END
        suffix = np.array([0, *(zlib.crc32(w[-3:]) % SUFFIXES for w in raw)], np.uint8)
        counts = np.bincount(each[np.repeat(~np.array(held, bool), sizes)], minlength=len(vocab))
        one = lambda x, t: pa.array([x], t)
        return pa.RecordBatch.from_arrays([one(ids, pa.list_(pa.int64())), one(held, pa.list_(pa.bool_())), one(sizes, pa.list_(pa.int64())), one(each.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), pa.binary()), one(vocab, pa.list_(pa.int64())), one(counts, pa.list_(pa.int64())), one(suffix.tobytes(), pa.binary())], ["doc_ids", "held", "sizes", "codes", "vocab", "counts", "suffix"])

    for batch in slices(batches):
        for doc_id, out, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            own = text.encode().lower().split()
            codes.extend(map(index.__getitem__, own))
            codes.append(0)
            ids.append(doc_id)
            held.append(out)
            sizes.append(len(own) + 1)
            if len(codes) >= BLOCK_TOKENS:
                yield flush()
                index, codes, ids, held, sizes = dictionary(), array("I"), [], [], []
    if ids:
        yield flush()


def counted_blocks(docs: DataFrame) -> DataFrame:
    """Blocks with known: for each word of the block's dictionary its place, its training count over all documents, whether
    this block is the one that stands for it in sums over distinct words, and 32 bits of its hash."""
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id", MODULUS, REMAINDER).alias("out"), text_or_empty().alias("text"))
    made = rows.mapInArrow(_blocks, "doc_ids array<bigint>, held array<boolean>, sizes array<bigint>, codes binary, vocab array<bigint>, counts array<bigint>, suffix binary")
    blocks = materialize(made.withColumn("block", F.monotonically_increasing_id()), "lm-blocks")
    words = blocks.select("block", "vocab", "counts").mapInArrow(_words, "block bigint, p int, h bigint, n int")
    # a word has one row for each block that holds it; sums of words in several blocks combine early, and the rows of a frequent word
    # are split
    sums = words.groupBy("h").agg(F.sum("n").alias("sum"), F.min("block").alias("first"), F.count("*").alias("blocks")).where("blocks > 1").drop("blocks")
    totals = hot_join(words, sums, "h").select("block", "p", "h", F.coalesce("sum", "n").alias("t"), F.coalesce(F.col("block") == F.col("first"), F.lit(True)).alias("lead"))
    placed = totals.select("block", "p", "t", "lead", F.shiftright("h", 32).cast("int").alias("h")).repartition("block").sortWithinPartitions("block", "p")
    known = placed.select("block", "t", "lead", "h").mapInArrow(_packed, "block bigint, totals binary, lead binary, vocab binary")
    return materialize(blocks.drop("counts", "vocab").join(known, "block"), "lm-counted")


def _words(batches):
    """A row for each word of a block's dictionary."""
    for batch in batches:
        for r in range(batch.num_rows):
            h, n = (batch.column(k)[r].values for k in (1, 2))
            for at in range(0, len(h), 50_000):
                own = h.slice(at, 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch.column(0)[r].as_py(), np.int64)), pa.array(np.arange(at, at + len(own), dtype=np.int32)), own, n.slice(at, 50_000).cast(pa.int32())], ["block", "p", "h", "n"])


def _packed(batches):
    """Rows come sorted by block and place; a block's columns become one row of bytes."""
    key, held = None, []

    def row():
        parts = [np.concatenate(x).tobytes() for x in zip(*held)]
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *(pa.array([x], pa.binary()) for x in parts)], ["block", "totals", "lead", "vocab"])

    for batch in batches:
        blocks, total, lead, hashed = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if blocks[a] != key:
                if held:
                    yield row()
                key, held = int(blocks[a]), []
            held.append((total[a:b].astype("<i8"), lead[a:b].astype(np.uint8), hashed[a:b].astype("<i4")))
    if held:
        yield row()


@dataclass
class Block:
    """One row of counted blocks as arrays."""

    doc_ids: pa.Array
    held: np.ndarray
    sizes: np.ndarray
    codes: np.ndarray
    vocab: np.ndarray
    suffix: np.ndarray
    totals: np.ndarray
    lead: np.ndarray


def _rows(batch: pa.RecordBatch):
    for r in range(batch.num_rows):
        get = {n: batch.column(k)[r] for k, n in enumerate(batch.schema.names)}
        raw = lambda name, kind: np.frombuffer(get[name].as_buffer(), kind)
        yield Block(get["doc_ids"].values, get["held"].values.to_numpy(zero_copy_only=False), get["sizes"].values.to_numpy(), np.ascontiguousarray(raw("codes", np.uint8).reshape(4, -1).T).view("<u4").ravel(), raw("vocab", "<u4"), raw("suffix", np.uint8), raw("totals", "<i8"), raw("lead", np.uint8).astype(bool))


@dataclass
class Lexicon:
    """Figures of the corpus: N, V, hashes and counts of the most frequent words by rank, class counts."""

    n: int
    v: int
    hashes: np.ndarray
    counts: np.ndarray
    class_n: np.ndarray
    class_v: np.ndarray

    @property
    def bits(self) -> int:
        """Binary digits of a word's place in its class."""
        return min(BITS, max(1, (self.v // SUFFIXES).bit_length()))

    def describe(self, b: Block, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, context number and place of each word of a block's dictionary; a class's unknown words have its first hashed leaf.
        Without places, the hashed leaves."""
        kind = SINGLES + b.suffix.astype(np.int32)
        for rank, (h, n) in enumerate(zip(self.hashes, self.counts)):
            kind[(b.vocab == h) & (b.totals == n)] = rank
        word = np.where(b.totals > 0, b.vocab.astype(np.int64) + SUFFIXES + 1, b.suffix)
        hashed = leaves(b, self.bits)
        return kind, word, hashed if places is None else places[hashed].astype(np.int64)


def leaves(b: Block, bits: int) -> np.ndarray:
    place = (b.vocab.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    return (b.suffix.astype(np.int64) << bits) + np.where(b.totals > 0, place.astype(np.int64), 0)


def lexicon(counted: DataFrame) -> Lexicon:
    def sums(batches):
        for batch in batches:
            for b in _rows(batch):
                own = b.lead & (b.totals > 0)
                n = np.bincount(b.suffix[own], b.totals[own], SUFFIXES).astype(np.int64)
                v = np.bincount(b.suffix[own], minlength=SUFFIXES)
                top = np.flatnonzero(own)
                top = top[np.lexsort((b.vocab[top], -b.totals[top]))[:SINGLES]]
                yield pa.RecordBatch.from_arrays([pa.array([True] * SUFFIXES + [False] * len(top)), pa.array(np.concatenate([np.arange(SUFFIXES), b.suffix[top]]).astype(np.int32)), pa.array(np.concatenate([np.zeros(SUFFIXES, np.int64), b.vocab[top].astype(np.int64)])), pa.array(np.concatenate([n, b.totals[top]])), pa.array(np.concatenate([v, np.ones(len(top), np.int64)]))], ["sums", "suffix", "h", "n", "v"])

    rows = counted.select("doc_ids", "held", "sizes", F.lit(b"").alias("codes"), "suffix", *DICTIONARY).mapInArrow(sums, "sums boolean, suffix int, h bigint, n bigint, v bigint")
    rows = materialize(rows, "lm-sums")
    by_suffix = rows.where("sums").groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    top = rows.where("NOT sums").orderBy(F.desc("n"), "h").limit(SINGLES).collect()
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in by_suffix:
        n[SINGLES + r["suffix"]], v[SINGLES + r["suffix"]] = r["n"], r["v"]
    total, distinct = int(n.sum()), int(v.sum())
    for k, r in enumerate(top):
        n[k], v[k] = r["n"], 1
        n[SINGLES + r["suffix"]] -= r["n"]
        v[SINGLES + r["suffix"]] -= 1
    return Lexicon(total, distinct, np.array([r["h"] for r in top], np.uint32), np.array([r["n"] for r in top], np.int64), n, v)


def masses(counted: DataFrame, lex: Lexicon) -> np.ndarray:
    """Training counts plus one of the words of each hashed leaf, without the single ones; a class's first also has its unknown."""

    def sums(batches):
        for batch in batches:
            for b in _rows(batch):
                kind, _, leaf = lex.describe(b)
                own = b.lead & (b.totals > 0) & (kind >= SINGLES)
                at, of = np.unique(leaf[own], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bincount(of, b.totals[own] + 1.0, len(at)).astype(float))], ["leaf", "mass"])

    rows = counted.select("doc_ids", "held", "sizes", F.lit(b"").alias("codes"), "suffix", *DICTIONARY).mapInArrow(sums, "leaf bigint, mass double")
    found = rows.groupBy("leaf").agg(F.sum("mass").alias("mass")).toArrow()
    mass = np.zeros(SUFFIXES << lex.bits, np.float32)
    mass[found["leaf"].to_numpy()] = found["mass"].to_numpy()
    mass[:: 1 << lex.bits] += 1
    return mass


def balanced(mass: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each hashed leaf, by class: the share of its class that more frequent leaves and half of its own have, in bits
    binary digits; and the masses of the places."""
    own = mass.reshape(SUFFIXES, -1).astype(np.float64)
    order = np.argsort(-own, axis=1, kind="stable")
    ranked = np.take_along_axis(own, order, axis=1)
    upto = np.cumsum(ranked, axis=1)
    place = np.minimum(((upto - ranked / 2) / upto[:, -1:] * (1 << bits)).astype(np.int64), (1 << bits) - 1)
    table = np.empty_like(place)
    np.put_along_axis(table, order, place, axis=1)
    table += np.arange(SUFFIXES)[:, None] << bits
    return table.ravel().astype(np.int32), np.bincount(table.ravel(), own.ravel(), len(mass)).astype(np.float32)


def levels(mass: np.ndarray, bits: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each digit of a place, the first having the bits that are left over: how far right it lies, its bits, the log shares of its
    values at each node, and whether two or more of them have words."""
    out, shift = [], bits
    for width in [bits % DIGIT] * (bits % DIGIT > 0) + [DIGIT] * (bits // DIGIT):
        shift -= width
        own = mass.reshape(-1, 1 << width, 1 << shift).sum(axis=2, dtype=np.float32)
        share = np.full((len(own), WIDE), -1e9, np.float32)
        share[:, : 1 << width] = np.where(own > 0, np.log(np.maximum(own, 1e-9)) - np.log(np.maximum(own.sum(axis=1, keepdims=True), 1e-9)), -1e9)
        out.append((shift, width, share, (own > 0).sum(axis=1) > 1))
    return out


def _row(template: int, n: int, *parts: np.ndarray) -> np.ndarray:
    """Row numbers below n, a power of 2; or the mixed numbers themselves for an n of 0."""
    mixed = np.full(len(parts[0]), template + 1, np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            mixed = (mixed + p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return (mixed & np.uint64(n - 1)).astype(np.int64) if n else mixed


def _runs(kind: np.ndarray, word: np.ndarray, leaf: np.ndarray, codes: np.ndarray, sizes: np.ndarray, step: int = STEP):
    """(first token, class, class context, the last two words, leaf) of step tokens each; a text begins with no history."""
    place = np.arange(len(codes), dtype=np.int32)
    place -= np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    for at in range(0, len(codes), step):
        lo = max(0, at - 2)
        own, deep = codes[lo : at + step], place[at : at + step]

        def back(x, k, none):
            out = np.full(len(deep) + at - lo, none, np.int64)
            out[k:] = x[own[:-k]]
            return np.where(deep >= k, out[at - lo :], none)

        w1, w2, k1, k2 = back(word, 1, SUFFIXES), back(word, 2, SUFFIXES), back(kind, 1, CLASSES), back(kind, 2, CLASSES)
        here = own[at - lo :]
        yield at, kind[here], (w1 * (CLASSES + 1) + k1) * (CLASSES + 1) + k2, (w1, w2), leaf[here]


def features(context: np.ndarray, n: int) -> list[np.ndarray]:
    """A row number for each context and template: the word before, and both classes before."""
    rest, k2 = np.divmod(context, CLASSES + 1)
    r1, k1 = np.divmod(rest, CLASSES + 1)
    return [_row(0, n, r1), _row(1, n, k2, k1)]


def inner_contexts(words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A number for each template (rows) within a class and token: the word before, both before, the one before the last (a skip)."""
    return np.stack([(x >> np.uint64(32)).astype(np.uint32) for x in (_row(3, 0, words[0]), _row(4, 0, *words), _row(5, 0, words[1]))])


def inner_choices(steps: list, contexts: np.ndarray, leaf: np.ndarray, weights: np.ndarray):
    """(tokens, flat place of each one's digit, powers of the sums of its values, their totals, row of each template) for each digit that
    leaves a choice."""
    mask, leaf = np.uint32(len(weights) - 1), leaf.astype(np.int64)
    for shift, width, share, choice in steps:
        parent = leaf >> (shift + width)
        at = np.flatnonzero(choice.take(parent, mode="clip"))
        if not len(at):
            continue
        parent = parent.take(at, mode="clip")
        node = (parent << 5 | shift).astype(np.uint32) * np.uint32(0x9E3779B1)
        rows = []
        for own in contexts:
            mixed = (own.take(at, mode="clip") ^ node) * np.uint32(0x85EBCA77)
            rows.append(((mixed ^ mixed >> np.uint32(15)) & mask).astype(np.int64))
        powers, totals = summed(taken(share, parent), weights, rows)
        digit = leaf.take(at, mode="clip") >> shift & ((1 << width) - 1)
        yield at, np.arange(0, len(at) * WIDE, WIDE) + digit, powers, totals, rows


def taken(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of a table by numbers that are known to be in it."""
    return table.take(rows, axis=0, mode="clip")


def summed(z: np.ndarray, weights: np.ndarray, rows) -> tuple[np.ndarray, np.ndarray]:
    """The powers of z plus the weights of all rows, and their totals; z is overwritten. Sums stay below 60, where a power still fits
    32 bits."""
    for r in rows:
        z += taken(weights, r)
    np.minimum(z, 60, out=z)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], np.float32)


def class_shares(bias: np.ndarray, weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """The probability of each class, by context."""
    powers, totals = summed(np.repeat(bias[None], len(rows[0]), axis=0), weights, rows)
    powers /= totals[:, None]
    return powers


def class_bias(lex: Lexicon) -> np.ndarray:
    return np.log((lex.class_n + 1) / (lex.class_n.sum() + CLASSES)).astype(np.float32)


def _step(weights: np.ndarray, squares: np.ndarray, visits: np.ndarray, rows: list[np.ndarray], g: np.ndarray, n: np.ndarray, rate: float) -> None:
    """One AdaGrad step."""
    for r in rows:
        visits += np.bincount(r, n, len(visits)).astype(np.float32)
        _adagrad(weights, squares, *grouped(r, g), rate)


def _descend(state: tuple[np.ndarray, np.ndarray, np.ndarray], bias: np.ndarray, context: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One step on the log loss of classes of a run of tokens; equal contexts are worked out once."""
    distinct, of, n = np.unique(context, return_inverse=True, return_counts=True)
    rows = features(distinct, len(state[0]))
    g = class_shares(bias, state[0], rows)
    g *= n[:, None].astype(np.float32)
    np.subtract.at(g.reshape(-1), of * CLASSES + target, np.float32(1))
    _step(*state, rows, g, n, rate)


class Inner:
    """AdaGrad over the weights within classes, WIDE a row."""

    def __init__(self, n: int):
        self.weights, self.squares = np.zeros((n, WIDE), np.float32), np.zeros(n, np.float32)

    def descend(self, steps: list, words: tuple[np.ndarray, np.ndarray], leaf: np.ndarray, rate: float) -> None:
        """A step on the log loss of each digit of a run of tokens, the first digit first; within it, for one template after the other."""
        for _, digit, g, totals, rows in inner_choices(steps, inner_contexts(words), leaf, self.weights):
            g /= totals[:, None]
            g.reshape(-1)[digit] -= 1
            for r in rows:
                _adagrad(self.weights, self.squares, *grouped(r, g), rate)


def grouped(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sum of what belongs to each, in its order; most rows come once. Row and place are sorted as one number,
    which takes less than half the time of an argsort."""
    bits = len(rows).bit_length()
    packed = np.sort(rows << bits | np.arange(len(rows)))
    sorted_, order = packed >> bits, packed & ((1 << bits) - 1)
    first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    cut = np.flatnonzero(first)
    total = taken(g, order[cut])
    size = np.diff(np.append(cut, len(rows)))
    many = np.flatnonzero(size > 1)
    if len(many):
        inside = np.repeat(size > 1, size)
        starts = np.cumsum(size[many]) - size[many]
        total[many] = np.add.reduceat(taken(g, order[inside]), starts, axis=0)
    return sorted_[cut], total


def put_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """table[rows] = values for contiguous rows, each written as one piece of bytes."""
    piece = f"V{table.shape[1] * table.itemsize}"
    table.view(piece).ravel()[rows] = np.ascontiguousarray(values).view(piece).ravel()


def _adagrad(weights: np.ndarray, squares: np.ndarray, own: np.ndarray, total: np.ndarray, rate: float) -> None:
    """One step on the rows of own; each row has one sum of squares."""
    seen = squares.take(own, mode="clip") + np.einsum("ij,ij->i", total, total)
    squares[own] = seen
    total *= (-rate / np.sqrt(seen + 1))[:, None]
    total += taken(weights, own)
    put_rows(weights, own, total)


def _many(lex: Lexicon) -> tuple[int, int]:
    """Class rows and rows within classes."""
    return max(ROWS, 1 << max(0, lex.bits - 2)), min(LARGEST, max(4 * ROWS, 1 << (lex.bits + 6))) // WIDE


def learn(counted: DataFrame, lex: Lexicon, places: np.ndarray, mass: np.ndarray, trainers: int = TRAINERS, rate: float = 0.4) -> tuple[np.ndarray, np.ndarray]:
    """Weights of classes, rows x CLASSES, and within classes, rows x WIDE, from one pass over all training tokens."""
    bias, many = class_bias(lex), _many(lex)
    shared = counted.sparkSession.sparkContext.broadcast((places, mass))

    def learned(batches):
        outer, inner = (np.zeros((many[0], CLASSES), np.float32), np.zeros(many[0], np.float32), np.zeros(many[0], np.float32)), Inner(many[1])
        places, mass = shared.value
        steps = levels(mass, lex.bits)
        for batch in batches:
            for b in _rows(batch):
                described = lex.describe(b, places)
                codes = b.codes[np.repeat(~b.held, b.sizes)]
                for _, of, context, words, leaf in _runs(*described, codes, b.sizes[~b.held], min(STEP, max(256, len(codes) // LEAST_STEPS))):
                    _descend(outer, bias, context, of, rate)
                    deep = of >= SINGLES
                    if deep.any():
                        inner.descend(steps, (words[0][deep], words[1][deep]), leaf[deep], rate)
        if outer[2].any():
            parts = [x.reshape(PIECES, -1) for x in (outer[0].astype("<f2"), outer[2], inner.weights.astype("<f2"), inner.squares)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES, dtype=np.int32)), *(pa.array([x.tobytes() for x in p], pa.binary()) for p in parts)], ["piece", "w0", "n0", "w1", "n1"])

    def averaged(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                piece, *parts = (batch.column(k)[r] for k in range(5))
                own = sums.setdefault(piece.as_py(), [0, 0, 0, 0])
                for k in (0, 2):
                    n = np.frombuffer(parts[k + 1].as_buffer(), "<f4")[:, None]
                    own[k] = own[k] + np.frombuffer(parts[k].as_buffer(), "<f2").astype(np.float32).reshape(len(n), -1) * n
                    own[k + 1] = own[k + 1] + n
        if sums:
            means = [[(x[k] / np.maximum(x[k + 1], 1)).astype("<f2").tobytes() for x in sums.values()] for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *(pa.array(m, pa.binary()) for m in means)], ["piece", "w0", "w1"])

    parts = counted.drop("doc_ids").select(F.array().cast("array<bigint>").alias("doc_ids"), "held", "sizes", "codes", "suffix", *DICTIONARY)
    tasks = max(1, min(trainers, max(8, counted.count() // SHARE)))
    found = parts.coalesce(tasks).mapInArrow(learned, "piece int, w0 binary, n0 binary, w1 binary, n1 binary").repartition(PIECES, "piece").mapInArrow(averaged, "piece int, w0 binary, w1 binary").collect()
    weights = [np.zeros((PIECES, m // PIECES * k), np.float16) for m, k in zip(many, (CLASSES, WIDE))]
    for r in found:
        for k in range(2):
            weights[k][r["piece"]] = np.frombuffer(r[f"w{k}"], "<f2")
    return weights[0].reshape(-1, CLASSES), weights[1].reshape(-1, WIDE)


def train(counted: DataFrame, lex: Lexicon, trainers: int = TRAINERS, rate: float = 0.4) -> np.ndarray:
    """Class weights alone."""
    return learn(counted, lex, *balanced(masses(counted, lex), lex.bits), trainers, rate)[0].astype(np.float32)


def inner_scores(steps: list, weights: np.ndarray, words: tuple[np.ndarray, np.ndarray], leaf: np.ndarray) -> np.ndarray:
    """Natural log P(leaf | class, history)."""
    out = np.zeros(len(leaf))
    for at, digit, powers, totals, _ in inner_choices(steps, inner_contexts(words), leaf, weights):
        out[at] += np.log(np.maximum(powers.reshape(-1).take(digit, mode="clip") / totals, LEAST))
    return out


def scores(docs: DataFrame, trainers: int = TRAINERS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    A null text counts as empty: one token, its end. Columns but doc_id and text don't matter; an empty table gives no rows. A null doc_id is never held out; repeated rows count as often as they
    occur. base_score is the unigram model with counts plus one. Without training rows all words are unknown to both models.
    """
    spark = docs.sparkSession
    counted = counted_blocks(docs)
    lex = lexicon(counted)
    known = balanced(masses(counted, lex), lex.bits)
    bias, shared = class_bias(lex), spark.sparkContext.broadcast((*known, *learn(counted, lex, *known, trainers)))

    def scored(batches):
        places, mass, *weights = shared.value
        outer, inner = (w.astype(np.float32) for w in weights)
        steps = levels(mass, lex.bits)
        for batch in batches:
            for b in _rows(batch):
                kind, word, leaf = lex.describe(b, places)
                base = np.log10((b.totals + 1) / (lex.n + lex.v + 1))
                rest = np.where(kind < SINGLES, 0.0, np.log10((b.totals + 1) / np.maximum(mass[leaf], 1)))
                model = rest[b.codes]
                for at, of, context, words, place in _runs(kind, word, leaf, b.codes, b.sizes):
                    distinct, which = np.unique(context, return_inverse=True)
                    gained = np.log(np.maximum(class_shares(bias, outer, features(distinct, len(outer))).reshape(-1).take(which * CLASSES + of, mode="clip"), LEAST)).astype(np.float64)
                    deep = of >= SINGLES
                    if deep.any():
                        gained[deep] += inner_scores(steps, inner, (words[0][deep], words[1][deep]), place[deep])
                    model[at : at + len(of)] += gained / np.log(10)
                first = np.cumsum(b.sizes) - b.sizes
                add = lambda x: np.add.reduceat(x, first)
                known = add((b.totals > 0)[b.codes].astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.doc_ids, pa.array(b.held), pa.array(b.sizes), pa.array(known), pa.array(np.full(len(first), lex.n)), pa.array(add(base[b.codes])), pa.array(add(model))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.select("doc_ids", "held", "sizes", "codes", "suffix", *DICTIONARY).mapInArrow(scored, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
