"""Byte-level BPE encoding by overlapping chunks, and decoding by concatenating raw bytes.

A text longer than a chunk is cut into overlapping chunks, each pre-tokenised by itself. Neighbours are stitched at the first
position of their overlap where both start a pre-token, the pieces between stitches are encoded, and their ids are chained in
order. Matching is memoryless, so from a shared start on both chunks agree. Chunks of CHUNK characters stay in the task that reads
their text; a text of over DEAL characters is first cut, in the same way, into chunks of DEAL characters that are dealt over the
cluster. What has an overlap that shares no start (a long run of white space or of one kind of sign) is encoded in one piece.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import materialize, pick, slices, table, text_or_empty

CHUNK, OVERLAP = 4096, 256
#: Characters of a chunk that is dealt to another task, and of its overlap with the next.
DEAL, DEAL_OVERLAP = 1 << 16, 512


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(2)
def _encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    raw = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        raw[rank] = token
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), raw


@lru_cache(2)
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def encode_piece(text: str, path: str, pattern: str) -> np.ndarray:
    return np.asarray(_encoder(path, pattern)[0].encode_to_numpy(text, disallowed_special=()), "<u4")


def decode_piece(ids: np.ndarray, path: str, pattern: str) -> bytes:
    return b"".join(map(_encoder(path, pattern)[1].__getitem__, ids.tolist()))


def shared_starts(text: str, chunk: int, overlap: int, pattern: str) -> tuple[list[int], list[int]]:
    """Where pre-tokens of one chunk start: below overlap, and from chunk on below chunk + overlap, counted from there.

    Only starts right after a character that isn't white space count: a piece that ends before one is split in itself as it is
    within the text. The last two positions of the text given don't count, as its end may have cut a match there.
    """
    found = [m.start() for m in _compiled(pattern).finditer(text)]
    sound = lambda lo, hi: [x for x in found[bisect_left(found, lo) : bisect_left(found, min(hi, len(text) - 2))] if not text[x - 1].isspace()]
    return sound(1, overlap), [x - chunk for x in sound(chunk + 1, chunk + overlap)]


def stitched(text: str, chunk: int, overlap: int, pattern: str) -> list[str]:
    """Pieces of a text, cut where its neighbouring chunks agree; the text itself if an overlap shares no start."""
    firsts = [0, *range(chunk, len(text) - overlap, chunk)]
    if len(firsts) == 1:
        return [text]
    marks = [shared_starts(text[a : a + chunk + overlap + 2], chunk, overlap, pattern) for a in firsts]
    cuts = [0]
    for at, (_, tail), (head, _) in zip(firsts[1:], marks, marks[1:]):
        agreed = set(tail).intersection(head)
        if not agreed:
            return [text]
        cuts.append(at + min(agreed))
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def _cut(batches, chunk: int, overlap: int):
    for batch in batches:
        for h, text in zip(batch.column(0), batch.column(1).to_pylist()):
            for first in range(0, len(text), 64 * chunk):
                at = list(range(first, min(len(text), first + 64 * chunk), chunk))
                yield pa.RecordBatch.from_arrays([pa.array([h.as_py()] * len(at)), pa.array([x // chunk for x in at], pa.int64()), pa.array([text[x : x + chunk + overlap] for x in at])], ["h", "k", "chunk"])


def _edges(batches, chunk: int, overlap: int, pattern: str):
    for batch in slices(batches, 50):
        heads, tails = zip(*(shared_starts(x, chunk, overlap, pattern) for x in batch.column(2).to_pylist())) if batch.num_rows else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], ["h", "k", "head", "tail"])


def _pieces(batches, path: str, pattern: str, chunk: int, overlap: int):
    for batch in slices(batches, 50):
        parts = [stitched(x, chunk, overlap, pattern) for x in batch.column(2).to_pylist()]
        ids = [b"".join(encode_piece(x, path, pattern).tobytes() for x in p) for p in parts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(list(map(len, parts)), pa.int64())], ["h", "k", "ids", "n"])


_FOUND = ["n_tokens", "ids_sha256", "decoded_sha256", "n_chunks", "ids"]


class _Digest:
    def __init__(self, keep: bool):
        self.n, self.chunks, self.of_ids, self.of_raw, self.ids = 0, 0, hashlib.sha256(), hashlib.sha256(), [] if keep else None

    def add(self, ids: np.ndarray, path: str, pattern: str, chunks: int = 1) -> _Digest:
        self.n += len(ids)
        self.chunks += chunks
        self.of_ids.update(ids.tobytes())
        self.of_raw.update(decode_piece(ids, path, pattern))
        if self.ids is not None:
            self.ids.append(ids)
        return self

    def row(self) -> tuple:
        return self.n, self.of_ids.hexdigest(), self.of_raw.hexdigest(), self.chunks, None if self.ids is None else np.concatenate(self.ids).astype(np.int32)


def _batch(key: pa.Array, rows: list[tuple], name: str) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()))
    columns = zip(*rows) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([key, *(pa.array(list(c), t) for c, t in zip(columns, kinds))], [name, *_FOUND])


def _chained(batches, path: str, pattern: str, keep: bool):
    """Pieces come sorted by text and number; a text's pieces may lie in several batches."""
    key, digest = None, None
    for batch in slices(batches, 50):
        keys, rows = [], []
        for h, ids, n in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
            if h != key:
                if digest is not None:
                    keys.append(key)
                    rows.append(digest.row())
                key, digest = h, _Digest(keep)
            digest.add(np.frombuffer(ids, "<u4"), path, pattern, n)
        yield _batch(pa.array(keys, pa.string()), rows, "h")
    if digest is not None:
        yield _batch(pa.array([key]), [digest.row()], "h")


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP, deal: int = DEAL, deal_overlap: int = DEAL_OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_chunks, ids array<int>) of every row of docs; ids is null unless kept.

    ids_sha256 is taken over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the decoded bytes; n_chunks is
    the number of pieces that the text was encoded in. A null text counts as empty and has no ids. Rows may repeat and doc_ids may
    be null or tie: texts of over deal characters are encoded once for each distinct text. Further columns of any name don't
    matter; an empty table gives no rows. path names the rank file on every machine.
    """
    path, pattern = path or default_ranks(), pattern or default_pattern()
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_chunks bigint, ids array<int>"
    rows = pick(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))

    def whole(batches):
        for batch in slices(batches):
            done = []
            for text in batch.column(1).to_pylist():
                digest = _Digest(keep_ids)
                for piece in stitched(text, chunk, overlap, pattern):
                    digest.add(encode_piece(piece, path, pattern), path, pattern)
                done.append(digest.row())
            yield _batch(batch.column(0), done, "doc_id")

    short = rows.where(F.length("text") <= deal).mapInArrow(whole, f"doc_id {kind}, {found}")

    keyed = rows.where(F.length("text") > deal).withColumn("h", F.sha2("text", 256))
    cut = keyed.select("h", "text").mapInArrow(lambda b: _cut(b, deal, deal_overlap), "h string, k bigint, chunk string")
    chunks = materialize(cut.dropDuplicates(["h", "k"]), "bpe-chunks")  # deals the chunks of each text over the tasks
    edges = chunks.mapInArrow(lambda b: _edges(b, deal, deal_overlap, pattern), "h string, k bigint, head array<int>, tail array<int>")
    # what each chunk meets: the stitch in its overlap with the next one, or null where the text or the agreement ends
    left = edges.select("h", "k", "tail")
    right = edges.select("h", (F.col("k") - 1).alias("k"), "head")
    stitches = materialize(left.join(right, ["h", "k"]).select("h", "k", F.array_min(F.array_intersect("tail", "head")).alias("at")), "bpe-stitches")
    failed = stitches.where("at IS NULL").select("h").distinct()
    stitches = stitches.join(failed, "h", "left_anti")
    good = chunks.join(failed, "h", "left_anti")
    pieces = (
        good.join(stitches.select("h", "k", F.col("at").alias("to")), ["h", "k"], "left")
        .join(stitches.select("h", (F.col("k") + 1).alias("k"), F.col("at").alias("from")), ["h", "k"], "left")
        .selectExpr("h", "k", f"substring(chunk, coalesce(from, 0) + 1, coalesce(to + {deal}, length(chunk)) - coalesce(from, 0)) AS piece")
    )
    rest = keyed.select("h", "text").join(failed, "h", "left_semi").dropDuplicates(["h"]).selectExpr("h", "0L AS k", "text AS piece")
    ids = pieces.unionByName(rest).mapInArrow(lambda b: _pieces(b, path, pattern, chunk, overlap), "h string, k bigint, ids binary, n bigint")
    chained = ids.repartition("h").sortWithinPartitions("h", "k").mapInArrow(lambda b: _chained(b, path, pattern, keep_ids), f"h string, {found}")
    long = keyed.select("doc_id", "h").join(chained, "h").drop("h")
    return short.unionByName(long)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) -> (doc_id, raw binary): the bytes of the ids, one after the other; null ids give null."""
    path, pattern = path or default_ranks(), pattern or default_pattern()

    def back(batches):
        for batch in batches:
            raw = [None if x is None else decode_piece(np.asarray(x, np.int64), path, pattern) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return pick(encoded, "doc_id", "ids").mapInArrow(back, f"doc_id {kind}, raw binary")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).drop("ids")
