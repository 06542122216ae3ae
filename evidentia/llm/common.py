"""What the operators of this subpackage share: word rules, table access and intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources.sinks import materialize, work_dir  # noqa: F401

#: A word is a run of characters that are none of the six ASCII white-space characters. bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns only. Further columns of any name, struct or not, can't clash with what an operator adds."""
    return docs.select(*[docs[f"`{n}`"].alias(n) for n in names])


def slices(batches, rows: int = 500):
    """Arrow batches in slices, so that what a task holds of texts doesn't depend on the size of a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def fold(col: str, modulus: int) -> Column:
    """crc32 of the id's decimal digits modulo a number of folds; a null id has no fold and is never held out."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus
