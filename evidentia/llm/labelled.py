"""Labelled documents outside a held-out fold, and bounded samples, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import fold, pick, text_or_empty


def held_out(col: str, modulus: int, remainder: int) -> Column:
    """Whether a row is of the fold kept from training; false for a null id."""
    return F.coalesce(fold(col, modulus) == remainder, F.lit(False))


def _smallest(ids: DataFrame, limit: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _known(labels: DataFrame, label: str, modulus: int, remainder: int) -> DataFrame:
    known = pick(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id", modulus, remainder))
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int) -> DataFrame:
    """(doc_id, text, label) of all labelled rows outside the held-out fold.

    Rows with a null id or label are left out. Of several labels of an id the largest counts. Labels grow with the
    documents, so they are never broadcast: the texts outside the fold are shuffled once, whatever the size.
    """
    rows = pick(docs, "doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder))
    return rows.join(_known(labels, label, modulus, remainder).hint("shuffle_hash"), "doc_id").select("doc_id", text_or_empty().alias("text"), "label")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, limit: int, value: int | None = None) -> DataFrame:
    """The same of limit labelled ids, or fewer; only those of the given value if set. The chosen ids, limit at most, are broadcast;
    the limit is their bound.
    """
    known = _known(labels, label, modulus, remainder)
    if value is not None:
        known = known.where(F.col("label") == value)
    chosen = F.broadcast(_smallest(known, limit))
    return pick(docs, "doc_id", "text").join(chosen, "doc_id").select("doc_id", text_or_empty().alias("text"), "label")


def unlabelled_sample(docs: DataFrame, modulus: int, remainder: int, limit: int) -> DataFrame:
    """(doc_id, text) of limit ids outside the held-out fold, or fewer, from all documents."""
    ids = pick(docs, "doc_id").where(F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder)).distinct()
    return pick(docs, "doc_id", "text").join(F.broadcast(_smallest(ids, limit)), "doc_id").select("doc_id", text_or_empty().alias("text"))
