"""Cross-tokenizer alignment by an event sweep over the byte ends of two tokenisations.

Each document gives end events of tokenizer A and of tokenizer B. They are united, repartitioned by document, sorted by offset and
streamed through a machine with constant state: at an event, the A token and the B token that cover the bytes before it overlap (a
link), and where both end, a group closes. Events travel in blocks: the ids of one side from a given word of a document on. As a
token's length follows from its id, offsets are counted up from a block's start, and a slice of blocks is swept by NumPy at once.

Both tokenizers start anew at a space between two visible characters, so each distinct word is encoded once a worker, and blocks end
at such places, where both sides end.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.llm.common import materialize, pick, slices, table, text_or_empty

#: Words of a block, words that a worker's cache may hold (some 150 MB) and the longest one it takes, ids that are swept together, and
#: id pairs whose counts are sent to the workers at once.
BLOCK, CACHE, CACHED, TOGETHER, PAIRS = 8192, 400_000, 64, 400_000, 4_000_000
#: Characters on whose classes the two byte-level libraries agree; words with others go through the tokenizer's own one.
COMMON = re.compile("[\x00-ɏ‐-‧‰-⁞€、-〃ぁ-ゖァ-ヺ一-龥가-힣]*")
WORDS = re.compile(r"(?<=\S) (?=\S)")
ODD = re.compile(r" \s|\s |^\s|\s$")


def default_a() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_b() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_chars() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: visible Latin-1 stands for itself, the others follow from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b and b != 173]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A: a byte-level BPE file of the tokenizers library. Where its merges are in the order of their ids, common words are
    merged by tiktoken, whose results are the same."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special, of = {t["content"] for t in spec.get("added_tokens", ())}, byte_chars()
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        raw = {bytes(of[c] for c in t): i for t, i in vocab.items()}
        self.raw = [b""] * (max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", ()))]) + 1)
        for token, i in raw.items():
            self.raw[i] = token
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ordered = [vocab.get("".join(p)) for p in pairs] == list(range(256, 256 + len(pairs))) and spec.get("normalizer") is None
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=raw, special_tokens={}) if ordered and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"] else None

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of a space and each word."""
        quick = self.fast and self.fast.encode_ordinary
        return [quick(" " + w) if quick and COMMON.fullmatch(w) else self.slow.encode(" " + w, add_special_tokens=False).ids for w in words]


class Pieces:
    """Tokenizer B: a sentencepiece model that adds a space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        name = self.model.id_to_piece
        self.raw = [bytes([int(name(i)[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i) else name(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]
        #: Whether a piece holds a space behind another character; then words can't be encoded one by one.
        self.crosses = any(re.search(rb"[^ ] ", r) for r in self.raw)

    def encode(self, words: list[str]) -> list[list[int]]:
        return self.model.encode(words, num_threads=1)


class Encoder:
    """Both tokenizers, with the ids of words seen before."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), Pieces(b)
        if max(len(self.a.raw), len(self.b.raw)) > 1 << 16:
            raise ValueError("vocabularies of 65,536 ids at most")
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def words(self, words: set[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Ids of a space and each word that isn't known, as bytes; None where a side's bytes are not those of the word."""
        new = list(words)
        made = {}
        for w, a, b in zip(new, self.a.encode(new), self.b.encode(new)):
            said = b" " + w.encode()
            exact = b"".join(map(self.a.raw.__getitem__, a)) == said and b"".join(map(self.b.raw.__getitem__, b)) == said
            made[w] = (np.array(a, "<u2").tobytes(), np.array(b, "<u2").tobytes()) if exact else None
        for w in made if len(self.known) < CACHE else ():
            if len(w) <= CACHED:
                self.known[w] = made[w]
        return made

    def texts(self, texts: list[str], block: int) -> list[list[tuple[bytes, bytes]]]:
        """For each text the ids of both sides in blocks of words; none for a text that has no tokens."""
        split = [(WORDS.split(x) if ODD.search(x) or self.b.crosses else x.split(" ")) if x and not self.b.crosses else [x] if x else [] for x in texts]
        made = self.words({w for ws in split for w in ws} - self.known.keys())
        get, out = self.known.get, []
        for ws in split:
            found = [get(w) or made.get(w) for w in ws]
            whole = None not in found
            out.append([(b"".join([f[0] for f in found[k : k + block]]), b"".join([f[1] for f in found[k : k + block]])) for k in range(0, len(found), block)] if whole else [])
        return out


@lru_cache(1)
def _encoder(a: str, b: str) -> Encoder:
    return Encoder(a, b)


@lru_cache(1)
def _tables(a: str, b: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Byte lengths of both sides' tokens, and each number as text before a comma, a bar, a semicolon and nothing."""
    encoder = _encoder(a, b)
    lengths = [np.array(list(map(len, raw)), np.int64) for raw in (encoder.a.raw, encoder.b.raw)]
    most = max(map(len, lengths))
    return *lengths, [b"%d%s" % (i, mark) for i in range(most) for mark in (b",", b"|", b";", b"")]


def sweep(a: np.ndarray, b: np.ndarray, ends: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The events of stretches that lie one after the other, ends (n, 2) being their last A and B places plus one.

    Returns for each event the places of the linked A and B token and whether a group closes, each stretch's last event plus one, and
    the group of every A and of every B token.
    """
    at_a, at_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    marks = np.zeros(int(at_a[-1]) + 1 if len(at_a) else 1, np.uint8)
    marks[at_a] = 1
    marks[at_b] |= 2
    at = np.flatnonzero(marks)
    kind = marks[at]
    is_a, is_b, both = kind & 1, kind >> 1, kind == 3
    link_a, link_b = np.cumsum(is_a, dtype=np.int64) - is_a, np.cumsum(is_b, dtype=np.int64) - is_b
    group = np.cumsum(both, dtype=np.int64) - both
    return link_a, link_b, both, np.searchsorted(at, at_a[ends[:, 0] - 1]) + 1, group[is_a > 0], group[is_b > 0]


def written(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number and mark of every token in the order of a1,a2|b1;a3|b2: four times the id, plus 0 to 3 for comma, bar, semicolon and the
    end of a stretch."""
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    upto_a, upto_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=groups))]) for g in (group_a, group_b))
    k_a, k_b = np.arange(len(a)), np.arange(len(b))
    last_a, last_b = k_a + 1 == upto_a[group_a + 1], k_b + 1 == upto_b[group_b + 1]
    out = np.empty(len(a) + len(b), np.int64)
    out[k_a + upto_b[group_a]] = 4 * a.astype(np.int64) + last_a
    out[k_b + upto_a[group_b + 1]] = 4 * b.astype(np.int64) + 2 * last_b
    out[ends.sum(axis=1) - 1] += 1
    return out


def _packed(x: np.ndarray) -> bytes:
    """Numbers with their bytes in planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def _unpacked(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, len(flat) // width).T).view(kind).reshape(-1)


def events(docs: DataFrame, a: str, b: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, h, block, side, copies, ids): the end events of both sides in blocks of words. h is a hash of the text; equal rows that
    are read together are one, with their number in copies. A text without tokens has one block without ids."""
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    rows = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64(text_or_empty()).alias("h"), text_or_empty().alias("text"))

    def run(batches):
        for part in slices(batches, 200):
            seen = Counter(zip(*(c.to_pylist() for c in part.columns)))
            out = []
            for ((doc, h, _), n), blocks in zip(seen.items(), _encoder(a, b).texts([x for _, _, x in seen], block)):
                for k, both in enumerate(blocks or [(b"", b"")]):
                    out += [(doc, h, k, side, n, _packed(np.frombuffer(ids, "<u2"))) for side, ids in enumerate(both)]
            types = (arrow, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], ["doc_id", "h", "block", "side", "copies", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, h bigint, block int, side int, copies bigint, ids binary")


_STRETCH = ["doc_id", "h", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]


def swept(blocks: DataFrame, a: str, b: str) -> DataFrame:
    """Stretches of documents: (doc_id, h, copies, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times). pairs are the stretch's
    distinct linked ids, A's above B's 16 bits, times how often each is linked; the digest stands at a document's last stretch."""
    kind = blocks.schema["doc_id"].dataType
    types = (to_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary())

    def run(batches):
        key, copies, digest, held, size, seen = object(), 0, None, [], 0, None

        def flush():
            """Sweep the held stretches: (key, copies, digest, ids of both sides, whether the document ends)."""
            nonlocal held, size
            length_a, length_b, names = _tables(a, b)
            full = [s for s in held if len(s[3])]
            ids_a, ids_b = (np.concatenate([s[k] for s in full]) if full else np.zeros(0, "<u2") for k in (3, 4))
            ends = np.cumsum([(len(s[3]), len(s[4])) for s in full], axis=0).reshape(-1, 2)
            link_a, link_b, both, upto, group_a, group_b = sweep(ids_a, ids_b, ends, length_a, length_b)
            texts = written(ids_a, ids_b, group_a, group_b, ends)
            stretch = np.repeat(np.arange(len(full), dtype=np.uint64), np.diff(upto, prepend=0))
            pairs, times = np.unique(stretch << np.uint64(32) | ids_a[link_a].astype(np.uint64) << np.uint64(16) | ids_b[link_b], return_counts=True)
            cut = np.searchsorted(pairs >> np.uint64(32), np.arange(len(full) + 1))
            closed, k, out = np.concatenate([[0], np.cumsum(both)]), 0, []
            for own, n, sha, x, y, ended in held:
                row = (*own, n, len(x), len(y), 0, 0, None, None, None)
                if len(x):
                    lo, hi = (ends[k - 1].sum() if k else 0), ends[k].sum()
                    if sha[1]:
                        sha[0].update(b";")
                    sha[0].update(b"".join([names[i] for i in texts[lo:hi].tolist()]))
                    sha[1] = True
                    first, last = (upto[k - 1] if k else 0), upto[k]
                    found = slice(cut[k], cut[k + 1])
                    row = (*row[:5], int(closed[last] - closed[first]), int(last - first), None, _packed(pairs[found].astype("<u4")), _packed(times[found].astype("<u4")))
                    k += 1
                if ended:
                    row = (*row[:7], sha[0].hexdigest() if sha[1] else "", *row[8:])
                out.append(row)
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 10, types)], _STRETCH)

        def close():
            if held and held[-1][0] == key:
                held[-1][5] = True
            elif digest is not None:
                held.append([key, copies, digest, np.zeros(0, "<u2"), np.zeros(0, "<u2"), True])

        left = None
        for part in slices(batches, 500):
            for doc, h, k, side, n, ids in zip(*(c.to_pylist() for c in part.columns)):
                if (doc, h) != key:
                    if size >= TOGETHER or len(held) >= 2000:
                        close()
                        yield flush()
                    else:
                        close()
                    key, copies, digest, seen = (doc, h), 0, [hashlib.sha256(), False], None
                if k == 0 and side == 0:
                    copies += n
                if (k, side) == seen:  # an equal row, read elsewhere
                    continue
                seen = (k, side)
                if side == 0:
                    left = _unpacked(ids, "<u2")
                    continue
                held.append([key, copies, digest, left, _unpacked(ids, "<u2"), False])
                size += len(left) + len(held[-1][4])
                if size >= 4 * TOGETHER:  # within a long document
                    yield flush()
        close()
        yield flush()

    keys = blocks.select("doc_id", "h", "block", "side", "copies", "ids").repartition("doc_id", "h").sortWithinPartitions("doc_id", "h", "block", "side")
    return keys.mapInArrow(run, f"doc_id {kind.simpleString()}, h bigint, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary")


def pair_counts(stretches: DataFrame) -> DataFrame:
    """(pair, n) over the links of all documents, repeated rows counted as often as they occur."""

    def run(batches):
        for batch in batches:
            pairs, n = [], []
            for part in slices([batch], 1000):
                for copies, p, t in zip(*(c.to_pylist() for c in part.columns)):
                    pairs.append(_unpacked(p, "<u4"))
                    n.append(_unpacked(t, "<u4").astype(np.int64) * copies)
            if pairs:
                found, at = np.unique(np.concatenate(pairs), return_inverse=True)
                total = np.zeros(len(found), np.int64)
                np.add.at(total, at, np.concatenate(n))
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total)], ["pair", "n"])

    linked = stretches.where("pairs IS NOT NULL").select("copies", "pairs", "times")
    return linked.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _scored(stretches: DataFrame, known) -> DataFrame:
    """Each stretch's best links and sum of counts, as far as the pairs are known: (sorted pairs, counts, whether the best)."""
    kind = stretches.schema["doc_id"].dataType

    def run(batches):
        at, count, best = known.value
        for part in slices(batches, 500):
            sums = []
            for p, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                pairs, times = _unpacked(p, "<u4"), _unpacked(t, "<u4").astype(np.int64)
                k = np.minimum(np.searchsorted(at, pairs), len(at) - 1)
                times = times * (at[k] == pairs)
                sums.append((int(times[best[k]].sum()), int((times * count[k]).sum())))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(list(c), pa.int64()) for c in (zip(*sums) if sums else [[], []]))], ["doc_id", "h", "n_best", "count_sum"])

    return stretches.where("pairs IS NOT NULL").select("doc_id", "h", "pairs", "times").mapInArrow(run, f"doc_id {kind.simpleString()}, h bigint, n_best bigint, count_sum bigint")


def align(docs: DataFrame, a: str | None = None, b: str | None = None, block: int = BLOCK, most_pairs: int = PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs.

    Null and empty texts, and those whose bytes a side doesn't give back, have no tokens: zeros and an empty digest. Equal rows are
    swept once, counted as often as they occur and returned as often; null and tied doc_ids don't matter, nor do further columns of
    any name; an empty table gives no rows. a and b name the tokenizers' files on every machine; ids are below 65,536. Counts of
    most_pairs id pairs are sent to the workers at once; of more, one part after the other, each over all links.
    """
    a, b = a or default_a(), b or default_b()
    spark = docs.sparkSession
    stretches = materialize(swept(events(docs, a, b, block), a, b), "alignment")
    counts = pair_counts(stretches)
    counts = materialize(counts, "pairs")
    tops = counts.groupBy((F.col("pair") % 65536).alias("b")).agg(F.max("n").alias("top"))  # a row for each id of B
    parts = max(1, -(-counts.count() // most_pairs))
    sums = []
    for k in range(parts):
        own = counts.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == k).withColumn("b", F.col("pair") % 65536)
        got = own.join(F.broadcast(tops), "b").select(F.col("pair"), "n", (F.col("n") == F.col("top")).alias("best")).toArrow()
        got = got.take(pa.compute.sort_indices(got, [("pair", "ascending")]))
        if not got.num_rows:
            continue
        known = spark.sparkContext.broadcast((got["pair"].to_numpy().astype(np.uint32), got["n"].to_numpy(), got["best"].to_numpy(zero_copy_only=False)))
        scored = _scored(stretches, known)
        sums.append(materialize(scored, "scores") if parts > 1 else scored)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    zero = F.lit(0).cast("bigint")
    both = stretches.select("doc_id", "h", "copies", *names[:4], zero.alias("n_best"), zero.alias("count_sum"), "groups_sha256")
    for s in sums:
        both = both.unionByName(s.select("doc_id", "h", zero.alias("copies"), *[zero.alias(n) for n in names[:4]], "n_best", "count_sum", F.lit(None).cast("string").alias("groups_sha256")))
    done = both.groupBy("doc_id", "h").agg(F.max("copies").alias("copies"), *[F.sum(n).alias(n) for n in names], F.max("groups_sha256").alias("groups_sha256"))
    return done.select("doc_id", *names, "groups_sha256", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
