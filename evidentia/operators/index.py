"""A stored lexical index of whole documents: segments of one chunk a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import segments


def whole(text: str) -> list[tuple[int, int]]:
    """The text as its only token."""
    return [(0, len(text))]


def build(docs: DataFrame, folder: str, per_bucket: int = segments.PER_BUCKET) -> dict[str, int]:
    """Bring the index up to (id, text): what is new or changed is written, what is gone no longer found. A null text counts as
    empty. Numbers of reused, indexed and pruned documents."""
    return segments.update(segments.stamped(docs.select("id", "text")), folder, prune=True, offsets=whole, per_bucket=per_bucket)


def stale(docs: DataFrame, folder: str) -> DataFrame:
    """(id, state): what an index has in another version (changed), lacks (missing) or should no longer have (gone)."""
    known = segments.sources(docs.sparkSession, folder).select("id", F.col("sha").alias("old"))
    state = F.when(F.col("old").isNull(), "missing").when(F.col("sha").isNull(), "gone").when(F.col("old") != F.col("sha"), "changed")
    return segments.stamped(docs).select("id", "sha").join(known, "id", "full_outer").select("id", state.alias("state")).where("state IS NOT NULL")


def search(spark: SparkSession, folder: str, terms: list[str], scope: DataFrame | None = None) -> DataFrame:
    """(id, score) of the texts that hold a term of three characters or more, as retrieval.bm25 gives them over all texts.

    Postings are all that is read, those of the terms' own trigrams. scope, if given, limits what is returned; statistics stay over all.
    """
    found = segments.lexical(spark, folder, terms, scope)
    if found is None:
        return segments.sources(spark, folder).select("id", F.lit(0.0).alias("score")).limit(0)
    return found.select("id", "score")
