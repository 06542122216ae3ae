"""Writes that can be repeated: append what is new, replace partitions, publish a finished table, keep an intermediate one."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: below spark.checkpoint.dir, which every executor must see.

    Where the setting is missing, a local[*] session (driver and executors are one process) gets a temporary folder; a
    cluster session is refused, as its machines share no temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="evidentia-")
        base = _own_dirs[app]
    return f"{base.rstrip('/')}/evidentia-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    The tables of an application lie in one folder, which may be deleted once its results are written.
    """
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_new(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append rows whose key the table at path lacks; the first of equal keys in rows is kept."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([*keys])
    try:
        fresh = fresh.join(spark.read.parquet(path).select(*keys), [*keys], "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.write.mode("append").parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrite only the partitions that rows has; shrinking ones leave nothing stale."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def publish(rows: DataFrame, folder: str) -> str:
    """Write a generation of its own, then name it in the manifest: readers see the old table or the new one, never a part."""
    path = f"{folder}/generation-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    rows.sparkSession.range(1).select(F.lit(path).alias("path"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return path


def published(spark, folder: str) -> DataFrame:
    """The newest generation."""
    newest = spark.read.parquet(f"{folder}/manifest").agg(F.max_by("path", "at")).first()[0]
    return spark.read.parquet(newest)
