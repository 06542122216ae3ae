"""A corpus pipeline of five stages, each written as Parquet and reread as the next one's documents.

Every stage takes an empty table to an empty one and keeps further columns, whatever their names, but for the last, which returns
columns of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import byte_bpe, mixing, quality_rules, simhash, substring_dedup
from evidentia.llm.common import materialize, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go. A null or empty text is rejected for its length; equal rows share their fate."""
    return quality_rules.quality_filter(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id; null ids come last, of rows that tie in id and
    text one stays, and null and empty texts are one group."""
    return simhash.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated sentence spans leave the texts; n_chars follows. A null text stays null, equal rows count as one
    document, null ids come last."""
    return substring_dedup.substring_dedup(docs).drop("dedup").withColumn("n_chars", F.length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, a row for each time that the mix takes one, in shuffled shards. A null source is a source of its own; a text
    without words is never taken; equal rows are taken alike."""
    return mixing.shards(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document taken: its ids, their number and the digests of ids and decoded bytes. A null text has no ids; repeated rows
    and null ids stay as they are."""
    return byte_bpe.encode(docs, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", drop_low_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

#: SQL expresses neither the seeded mix nor the tokeniser; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
