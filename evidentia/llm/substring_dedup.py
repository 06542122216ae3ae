"""Substring dedup by sliding sentence spans.

A sentence here ends at a full stop, question or exclamation mark, comma, semicolon or colon before white space, or at a line
end; of every WINDOW words in a row that no such end parts, it also ends after the one of least hash (the last of equals). These
cuts depend on the words around only, so passages of 51 equal words share their ends but for WINDOW words at each edge, whatever
sentences they lie in.

From every sentence on, and up to every sentence, a span runs over the fewest consecutive sentences that are several: SEVERAL of
them, or fewer, two at least, that hold MIN_WORDS words. So every run of SEVERAL sentences is hashed, however short they are, and
any longer repeated run is covered from its first sentence to its last. Spans are hashed and joined over all documents; the first
occurrence by (doc_id, position) stays, and sentences that another occurrence covers are removed. Two spans are equal if their
lower-cased words are, whatever the white space and the marks at sentence ends; they are compared by 104 bits of two hashes.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidentia.llm.common import pick, slices, table

MIN_SENTENCES, SEVERAL = 2, 6
MIN_WORDS = 25
CUT = re.compile(r"[.!?,;:]+[\"')\]]*\s+|\n\s*")
WORD = re.compile(r"\S+\s*")
WINDOW = 13
MARKS = ".!?,;:\"')]"
#: Two odd factors, with their inverses modulo 2**64: a hash of a span is a polynomial in one over the sentences' hashes.
FACTORS = tuple((f, pow(f, -1, 1 << 64)) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
#: Bits of the second hash that are kept, below a span's place in one number.
CHECK = 40
#: Frequent spans whose first occurrence a task remembers, at most.
REMEMBERED = 1 << 16


def _inner_ends(text: str, sentences: list[tuple[int, int]]) -> list[int]:
    """Ends, with white space, of the words of least hash in each WINDOW words of a sentence, but for its last word."""
    hashes, ends, of = [], [], []
    for k, (a, b) in enumerate(sentences):
        part = text[a:b]
        words = part.lower().split()
        if len(words) >= WINDOW:
            hashes += [zlib.crc32(w.rstrip(MARKS).encode("utf-8", "surrogatepass")) for w in words]
            ends += [a + m.end() for m in WORD.finditer(part)]
            of += [k] * len(words)
    if not hashes:
        return []
    of = np.array(of)
    windows = np.lib.stride_tricks.sliding_window_view(np.array(hashes, np.uint32), WINDOW)[:, ::-1]
    whole = np.flatnonzero(of[: len(windows)] == of[WINDOW - 1 :])
    least = np.unique(whole + WINDOW - 1 - windows[whole].argmin(axis=1)).tolist()
    return [ends[k] for k in least if k + 1 < len(of) and of[k] == of[k + 1]]


def sentence_bounds(text: str) -> list[int]:
    """0, every sentence's end, with the white space after it; the last is the length of the text."""
    ends = [m.end() for m in CUT.finditer(text)]
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    bounds = [0, *ends]
    inner = _inner_ends(text, [(a, b) for a, b in zip(bounds, ends) if b - a >= 2 * WINDOW - 1])
    return sorted(bounds + inner) if inner else bounds


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def spans(text: str, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, several: int = SEVERAL) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentence bounds; hash, second hash, first sentence and end (exclusive) of every span, in order of place."""
    bounds = sentence_bounds(text)
    digest = xxhash.xxh64_intdigest
    words = [text[a:b].lower().rstrip().rstrip(MARKS).split() for a, b in zip(bounds, bounds[1:])]
    hashes = np.array([digest(" ".join(w).encode()) for w in words], np.uint64)
    upto = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    n, each = len(words), np.arange(len(words))
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + min_words, "left"), each + min_sentences)
    ends = np.minimum(ends, each + several)
    firsts = np.minimum(np.searchsorted(upto, upto[1:] - min_words, "right") - 1, each + 1 - min_sentences)
    firsts = np.maximum(firsts, each + 1 - several)
    both = np.concatenate([(each * (n + 1) + ends)[ends <= n], (firsts * (n + 1) + each + 1)[firsts >= 0]])
    first, end = np.divmod(np.unique(both), n + 1)
    found = []
    with np.errstate(over="ignore"):
        for k, (factor, inverse) in enumerate(FACTORS):
            own = hashes ^ (hashes >> np.uint64(29 * k)) if k else hashes
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * _powers(factor, n), dtype=np.uint64)])
            found.append((sums[end] - sums[first]) * _powers(inverse, n)[first])
    return bounds, found[0].view(np.int64), (found[1] >> np.uint64(64 - CHECK)).view(np.int64), first, end


def _postings(batches, **rule):
    """(span, id, text_hash, place) with place = at << CHECK | second hash; where an earlier occurrence in the task already precedes
    one, place is negative and span any number, so that a frequent span leaves few rows."""
    known: dict[tuple[int, int], tuple[int, int, int]] = {}
    for batch in slices(batches, 2500):
        ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        each = [spans(t, **rule)[1:3] for t in batch.column(2).to_pylist()]
        counts = [len(x) for x, _ in each]
        if not sum(counts):
            continue
        span, check = (np.concatenate(x) for x in zip(*each))
        row, at = np.repeat(np.arange(len(each)), counts), np.concatenate([np.arange(n) for n in counts])
        rank = np.lexsort((hashes, ids)).argsort()  # of rows: by id, then text
        order = np.lexsort((at, rank[row], check, span))
        span, check, row, at = span[order], check[order], row[order], at[order]
        # equal rows hold the same occurrence
        start = np.concatenate([[True], (span[1:] != span[:-1]) | (check[1:] != check[:-1])])
        heads = np.flatnonzero(start)
        head = np.repeat(heads, np.diff([*heads, len(span)]))
        again = (ids[row] != ids[row[head]]) | (hashes[row] != hashes[row[head]]) | (at != at[head])
        repeated = heads[np.logical_or.reduceat(again, heads)]
        if known or len(repeated):
            for k in heads[np.isin(span[heads], np.fromiter((x for x, _ in known), np.int64, len(known)))].tolist() if known else ():
                key, own = (int(span[k]), int(check[k])), (int(ids[row[k]]), int(hashes[row[k]]), int(at[k]))
                if key in known and known[key] < own:
                    again[head == k] = True
                elif key in known:
                    known[key] = own
            for k in repeated.tolist():
                if len(known) >= REMEMBERED:
                    break
                known.setdefault((int(span[k]), int(check[k])), (int(ids[row[k]]), int(hashes[row[k]]), int(at[k])))
        place = at << CHECK | check
        span = np.where(again, (ids[row] * 31 + hashes[row]) ^ place, span)
        yield pa.RecordBatch.from_arrays([pa.array(span), pa.array(ids[row]), pa.array(hashes[row]), pa.array(np.where(again, ~place, place))], ["span", "id", "text_hash", "place"])


def _removed(text: str, at: list[int], **rule) -> list[tuple[int, int]]:
    """Character ranges that the repeated spans from the sentences at cover, joined where they meet."""
    bounds, _, _, first, end = spans(text, **rule)
    out: list[list[int]] = []
    for i in sorted(set(at)):
        a, b = bounds[first[i]], bounds[end[i]]
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def substring_dedup(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, several: int = SEVERAL) -> DataFrame:
    """All rows and columns of docs, the text without repeated spans, and one more column, dedup:
    struct<n_removed_chars bigint, removed array<struct<start int, end int>>> with ranges in the given text.

    A null text stays null and an empty one empty. Null doc_ids come after all others. Rows that share doc_id and text count as
    one document and fare alike; rows that share only doc_id are ordered by a hash of their text. dedup must not be a column of
    docs; other names can't clash. An empty table gives no rows.
    """
    last, rule = F.lit((1 << 63) - 1), {"min_sentences": min_sentences, "min_words": min_words, "several": several}
    source = pick(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("bigint"), last).alias("id"), F.xxhash64("text").alias("text_hash"), "text").where("text IS NOT NULL")
    found = source.mapInArrow(lambda b: _postings(b, **rule), "span bigint, id bigint, text_hash bigint, place bigint")
    same = Window.partitionBy("span", F.col("place").bitwiseAND(F.lit((1 << CHECK) - 1)))
    ranked = found.withColumn("turn", F.rank().over(same.orderBy("id", "text_hash", "place")))
    at = F.shiftright(F.when(F.col("place") < 0, F.bitwise_not("place")).otherwise(F.col("place")), CHECK).cast("int")
    hits = ranked.where("place < 0 OR turn > 1").groupBy("id", "text_hash").agg(F.collect_set(at).alias("at"))

    columns = docs.columns
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("row"), F.coalesce(docs["doc_id"].cast("bigint"), last).alias("id"), F.xxhash64(docs["text"]).alias("text_hash"))
    joined = packed.join(hits, ["id", "text_hash"], "left").select("row", "at")
    place = columns.index("text")

    def cleaned(batches):
        for batch in slices(batches):
            rows = batch.column(0)
            fields = rows.flatten()
            texts = fields[place].to_pylist()
            gone = [_removed(t, at, **rule) if at else [] for t, at in zip(texts, batch.column(1).to_pylist())]
            for k, ranges in enumerate(gone):
                if ranges:
                    t = texts[k]
                    texts[k] = "".join(t[a:b] for a, b in zip([0, *(b for _, b in ranges)], [*(a for a, _ in ranges), len(t)]))
            fields[place] = pa.array(texts, pa.string())
            dedup = pa.array([{"n_removed_chars": sum(b - a for a, b in r), "removed": [{"start": a, "end": b} for a, b in r]} for r in gone], pa.struct([("n_removed_chars", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))
            yield pa.RecordBatch.from_arrays([*fields, dedup], [*columns, "dedup"])

    added = StructType.fromDDL("dedup struct<n_removed_chars: bigint, removed: array<struct<start: int, end: int>>>")
    schema = StructType([*docs.schema.fields, *added.fields])
    return joined.mapInArrow(cleaned, schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(pick(table(spark, sf_dir, "documents"), "doc_id", "text")).select("doc_id", "dedup.n_removed_chars", "dedup.removed", "text")
