"""Token ids in files of canonical length-limited Huffman codes.

A store is a folder with two Parquet tables. codebook has (id, n_bits) of every id in use; the codes are canonical: in order of
(n_bits, id), each the next number of its length. segments has rows of whole documents in ascending doc_id order:
shard and segment (their place in that order), first (ids before it in its shard), doc_ids and n_tokens of its documents,
payload (codes, first bit highest, as bytes) and checkpoints (bit offset of every block of BLOCK ids, as little-endian unsigned
64-bit integers). A block is decoded by itself, from its checkpoint on, by one table that maps the next max_bits bits to an id
and a length; all blocks of a segment advance together.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm.common import materialize, pick, slices, table, text_or_empty, work_dir

END = 2
MAX_BITS = 20
BLOCK = 256
SEGMENT = 1 << 19
#: Entries that a worker's cache of encoded letter runs may hold: some 140 MB.
CACHE = 700_000
#: A line: precomposed Latin letters in lower case, which no normalisation changes, then marks, two pre-tokens of the tokeniser
#: at most; or anything else.
PLAIN = re.compile(r"(?:([a-zß-öø-įı-ɏ]+)([.,;:!?&$%#*|]*)(?=\n)|(.*))\n")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(4)
def id_bytes(path: str) -> int:
    """Bytes of an id of the tokeniser: 2, or 4 for larger vocabularies."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab().values()) < 1 << 16 else 4


class _WordEncoder:
    """The tokeniser drops white space, so a text's ids are those of its words in order; each distinct word is encoded once.

    Distinct letter runs are sent to the tokeniser many at a time, and its word-end tokens tell them apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype(f"<u{id_bytes(path)}")
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def runs(self, wanted: set[str]) -> dict[str, bytes]:
        """The ids of those runs that the cache lacks; the cache takes them up while it has room."""
        new, made = list(wanted - self.known.keys()), {}
        for k in range(0, len(new), 512):
            part = new[k : k + 512]
            ids = self.ids(" ".join(part))
            cuts = (self.dtype.itemsize * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                made |= {run: raw[a:b] for run, a, b in zip(part, [0, *cuts], cuts)}
            else:
                made |= {run: self.ids(run).tobytes() for run in part}
        if len(self.known) < CACHE:
            self.known |= made
        return made

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes. A word that holds a special token is no letter run and goes to the tokeniser whole."""
        split = PLAIN.findall(b"\n".join([*words, b""]).decode().lower())
        made = self.runs({x for a, b, _ in split if a for x in (a, b)} - {""})
        get, out = self.known.get, []
        for w, (a, b, _) in zip(words, split):
            if not a:
                out.append(self.ids(w.decode()).tobytes())
            elif b:
                out.append((get(a) or made[a]) + (get(b) or made[b]))
            else:
                out.append(get(a) or made[a])
        return out

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, END after each text, and the number of ids of each."""
        words: list[bytes | None] = []
        counts = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            words += text.encode().split()
            words.append(None)
            counts[k + 1] = len(words)
        codes, distinct = pd.factorize(np.array(words, object))
        encoded = [*self.words(list(distinct)), np.array([END], self.dtype).tobytes()]
        lengths = np.array([len(x) // self.dtype.itemsize for x in encoded], np.int64)
        flat, starts = np.frombuffer(b"".join(encoded), self.dtype), np.cumsum(lengths) - lengths
        codes[codes < 0] = len(encoded) - 1
        each = lengths[codes]
        upto = np.cumsum(each)
        ids = flat[np.repeat(starts[codes] - upto + each, each) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.concatenate([[0], upto])[counts]
        return ids, np.diff(ends)


@lru_cache(1)
def _encoder(path: str) -> _WordEncoder:
    return _WordEncoder(path)


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids binary of little-endian unsigned integers of id_bytes bytes), END after each text.

    A null text counts as empty: END alone. Special tokens that a text spells out are encoded as the library encodes them. Rows
    may repeat, doc_ids may be null or tie, further columns of any name don't matter; an empty table gives no rows.
    """
    path = path or default_tokenizer()

    def encoded(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                ids, lengths = _encoder(path).texts(part.column(1).to_pylist())
                cuts = np.cumsum(lengths)[:-1]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in np.split(ids, cuts)], pa.binary())], ["doc_id", "ids"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(encoded, "doc_id bigint, ids binary")


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of each id by package-merge, 0 for a count of 0: the least total with no length above max_bits."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, leaf_before = leaves, []
    for _ in range(max_bits - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, packages])
        by = np.argsort(merged, kind="stable")
        leaf_before.append(np.concatenate([[0], np.cumsum(by < len(leaves))]))
        level = merged[by]
    take = 2 * len(leaves) - 2
    for before in [*reversed(leaf_before), None]:
        n = int(before[take]) if before is not None else take
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in code order, and the code of every id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    for i in order.tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i], last, code = code, n, code + 1
    return order, codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """Payload and checkpoints of the ids."""
    if not len(ids):
        return b"", np.zeros(0, "<u8")
    n, code = lengths[ids].astype(np.int64), codes[ids]
    ends = np.cumsum(n)
    at = ends - n
    word, room = at >> 6, 64 - (at & 63) - n
    high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(int(ends[-1] + 63 >> 6), np.uint64)
    out[word[first]] = np.bitwise_or.reduceat(high, first)
    over = np.flatnonzero(room < 0)
    out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: int(ends[-1] + 7 >> 3)], at[::block].astype("<u8")


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Entry of the next bits: id * 32 + length; and the number of bits looked up."""
    order, _ = canonical(lengths)
    bits = int(lengths.max()) if len(order) else 1
    own = lengths[order].astype(np.int64)
    entries = np.repeat(order.astype(np.uint32) << np.uint32(5) | own.astype(np.uint32), 1 << (bits - own))
    return np.concatenate([entries, np.zeros((1 << bits) - len(entries), np.uint32)]), bits


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, entries: np.ndarray, bits: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of a payload; every block is followed from its checkpoint."""
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, last = checkpoints.astype(np.int64), len(window) - 1
    out = np.empty((block, len(at)), np.uint16 if len(entries) and int(entries.max()) >> 5 < 1 << 16 else np.uint32)
    for k in range(block):
        seen = window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32) >> np.uint32(32 - bits)
        got = entries[seen]
        out[k] = got >> 5
        at += got & 31
    return out.T.reshape(-1)[:n]


def write_store(tokens: DataFrame, path: str, max_bits: int = MAX_BITS, segment: int = SEGMENT, block: int = BLOCK, width: int = 2) -> None:
    """(doc_id, ids binary of integers of width bytes) -> a store at path. tokens is read twice: for counts over all ids, and to
    write.

    Null doc_ids come first and ties are ordered by their ids. A segment holds whole documents. An empty table gives an empty
    store.
    """

    def counted(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in slices([batch]):
                seen = np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), f"<u{width}"), minlength=len(total))
                total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)]) + seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    spark = tokens.sparkSession
    found = tokens.select("ids").mapInArrow(counted, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row an id
    counts = np.zeros(1 + max((r["id"] for r in found), default=0), np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, max_bits)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, n_bits int").coalesce(1).write.parquet(f"{path}/codebook")

    def packed(batches):
        codes, shard, number, first = canonical(lengths)[1], TaskContext.get().partitionId(), 0, 0
        names, sizes, held, n = [], [], [], 0

        def flush():
            payload, checkpoints = pack(np.concatenate(held), lengths, codes, block)
            one = lambda x, t: pa.array([x], t)
            return pa.RecordBatch.from_arrays([one(shard, pa.int32()), one(number, pa.int32()), one(first, pa.int64()), one(names, pa.list_(pa.int64())), one(sizes, pa.list_(pa.int64())), one(payload, pa.binary()), one(checkpoints.tobytes(), pa.binary())], ["shard", "segment", "first", "doc_ids", "n_tokens", "payload", "checkpoints"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(np.frombuffer(ids.as_buffer(), f"<u{width}"))
                names.append(doc_id)
                sizes.append(len(held[-1]))
                n += sizes[-1]
                if n >= segment:
                    yield flush()
                    number, first = number + 1, first + n
                    names, sizes, held, n = [], [], [], 0
        if held:
            yield flush()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    rows = ordered.mapInArrow(packed, "shard int, segment int, first bigint, doc_ids array<bigint>, n_tokens array<bigint>, payload binary, checkpoints binary")
    rows.write.option("compression", "none").parquet(f"{path}/segments")


def read_store(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of little-endian unsigned 32-bit integers) of every document of a store."""
    known = spark.read.parquet(f"{path}/codebook").collect()  # one row an id
    lengths = np.zeros(1 + max((r["id"] for r in known), default=0), np.uint8)
    for r in known:
        lengths[r["id"]] = r["n_bits"]

    def decoded(batches):
        entries, bits = decode_table(lengths)
        for batch in batches:
            for r in range(batch.num_rows):
                shard, first, names, sizes, payload, checkpoints = (batch.column(k)[r] for k in range(6))
                sizes = np.array(sizes.as_py(), np.int64)
                ids = unpack(payload.as_py(), np.frombuffer(checkpoints.as_py(), "<u8"), int(sizes.sum()), entries, bits, block)
                ends = np.cumsum(sizes)
                parts = [x.astype("<u4").tobytes() for x in np.split(ids, ends[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()] * len(sizes), pa.int32()), names.values, pa.array(ends - sizes + first.as_py()), pa.array(sizes), pa.array(parts, pa.binary())], ["shard", "doc_id", "start", "n_tokens", "ids"])

    segments = spark.read.parquet(f"{path}/segments")
    total = F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    # one row of two numbers for each writing task: some MB at a million tasks
    shards = segments.groupBy("shard").agg(F.max(F.col("first") + total).alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    docs = segments.select("shard", "first", "doc_ids", "n_tokens", "payload", "checkpoints").mapInArrow(decoded, "shard int, doc_id bigint, start bigint, n_tokens bigint, ids binary")
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_dir(spark)}/token-store-{uuid.uuid4().hex}"
    write_store(materialize(tokenize(table(spark, sf_dir, "documents")), "tokens"), path, width=id_bytes(default_tokenizer()))
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
