"""Quality rules as a short-circuit cascade: rules run in the order of rejections per cost, as a sample shows them."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Sequence
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import pick, slices, table

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


class TextStats:
    """Figures of one text, each computed when a rule or a report first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_upper(self) -> int:
        raw = self.text.encode()
        return len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        times = Counter(windows)
        n, covered = 0, 0  # covered: the first word position that no repeated window has reached
        for i, x in enumerate(windows):
            if times[x] > 1:
                n += i + 3 - max(i, covered)
                covered = i + 3
        return n


#: Name and test of each rule; a text that any test holds for is rejected. The first two are the base rules.
Rule = tuple[str, Callable[[TextStats], bool]]
BASE_RULES: Sequence[Rule] = (
    ("too_few_words", lambda s: s.n_words < 50),
    ("repeated_windows", lambda s: 100 * s.n_repeat_words > 50 * s.n_words),
)
RULES: Sequence[Rule] = (
    *BASE_RULES,
    ("symbols", lambda s: 10 * s.n_symbols > 3 * s.n_words),
    ("duplicate_lines", lambda s: 10 * s.n_dup_lines > 6 * len(s.lines)),
    ("word_length", lambda s: s.n_words > 0 and not 2 * s.n_words <= s.word_chars <= 15 * s.n_words),
    ("upper_case", lambda s: 10 * s.n_upper > 3 * s.word_chars),
)


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 256) -> list[tuple[float, float]]:
    """(seconds a text, share rejected) of each rule over a bounded sample, taken by a hash of the text.

    Each rule is timed on fresh TextStats, so its cost holds the figures it needs. Only sums leave the executors.
    """

    def timed(batches):
        for pdf in batches:
            rows = []
            for k, (_, test) in enumerate(rules):
                for text in pdf["text"]:
                    began = time.perf_counter()
                    rejected = bool(test(TextStats(text)))
                    rows.append((k, time.perf_counter() - began, int(rejected)))
            yield pd.DataFrame(rows, columns=["rule", "cost", "rejected"])

    sample = pick(docs, "text").where("pmod(xxhash64(text), 16) = 0").limit(sample_rows)
    sums = sample.mapInPandas(timed, "rule int, cost double, rejected int").groupBy("rule").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected")).collect()
    found = {r["rule"]: (r["cost"] / r["n"], (r["rejected"] + 0.5) / (r["n"] + 1)) for r in sums}
    return [found.get(k, (1.0, 0.5)) for k in range(len(rules))]


def ordered(rules: Sequence[Rule], figures: Sequence[tuple[float, float]]) -> list[Rule]:
    """Most rejections per second first; ties keep the given order."""
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: -figures[k][1] / max(figures[k][0], 1e-9))]


def quality_filter(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 256) -> DataFrame:
    """The rows of docs that no rule rejects, all columns kept.

    A null text counts as empty and falls to the word-count rule. Rows are judged one by one, so equal rows share their
    fate. The verdict doesn't depend on the order that the sample suggests; only the work does. An empty table stays empty.
    """
    cascade = ordered(rules, measure(docs, rules, sample_rows))

    def kept(batches):
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([not any(test(s) for _, test in cascade) for s in map(TextStats, texts)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 256) -> DataFrame:
    """One row per document with its figures, base_failed and the cascade's verdict, kept.

    The cascade stops at a text's first rejection; the report then fills in the figures that the cascade left out. A null
    text counts as empty, a null doc_id stays null.
    """
    cascade = ordered(rules, measure(docs, rules, sample_rows))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def report(batches):
        for batch in slices(batches, 100):
            stats = [TextStats(x) for x in batch.column(1).to_pylist()]
            kept = [not any(test(s) for _, test in cascade) for s in stats]
            base = [any(test(s) for _, test in BASE_RULES) for s in stats]
            figures = [pa.array([getattr(s, n) for s in stats], pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *figures, pa.array(base, pa.bool_()), pa.array(kept, pa.bool_())], ["doc_id", *names, "base_failed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return pick(docs, "doc_id", "text").mapInArrow(report, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", base_failed boolean, kept boolean")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
        FROM w, unnest(range(1, greatest(len(ws) - 1, 1))) AS u(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 3) AS r(k) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
             len(ls) AS n_lines, len(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 6 * n_lines
            OR (n_words > 0 AND NOT (word_chars BETWEEN 2 * n_words AND 15 * n_words))
            OR 10 * n_upper > 3 * word_chars) AS kept
FROM b
"""
