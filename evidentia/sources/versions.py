"""A table whose versions are committed one after the other, by writers that may race.

Folder _log holds a file for each version, made only if it is absent, so of two writers that start from the same version one is
refused. A version names the live files of every bucket; an upsert writes the buckets that it touches anew and leaves the others as
they are, and readers of older versions keep their files. Writers may carry a fencing token: once a commit with a higher one is
there, lower ones are refused. The store must offer exclusive creation of a file, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has committed the version first."""


class Fenced(Exception):
    """A writer with a higher token has taken over."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


@dataclass(frozen=True)
class Version:
    """number (-1: nothing yet), the highest token so far, and what the writers have put down."""

    number: int = -1
    token: int = 0
    state: dict = field(default_factory=dict)


def latest(spark: SparkSession, folder: str) -> Version:
    """The newest version; an absent folder has none."""
    fs, log = _path(spark, f"{folder}/_log")
    if not fs.exists(log):
        return Version()
    names = sorted(s.getPath().getName() for s in fs.listStatus(log) if s.getPath().getName().endswith(".json"))
    return read(spark, folder, int(names[-1][:-5])) if names else Version()


def read(spark: SparkSession, folder: str, number: int) -> Version:
    text = "".join(r[0] for r in spark.read.text(f"{folder}/_log/{number:020d}.json", wholetext=True).collect())
    record = json.loads(text)
    return Version(number, record["token"], record["state"])


def commit(spark: SparkSession, folder: str, after: Version, state: dict, token: int | None = None) -> Version:
    """Make state the version that follows after. Raises Fenced for a token below the one committed, Conflict if the place is taken."""
    if token is not None and token < after.token:
        raise Fenced(f"token {token} is below {after.token}")
    new = Version(after.number + 1, max(after.token, token or 0), state)
    fs, path = _path(spark, f"{folder}/_log/{new.number:020d}.json")
    try:
        out = fs.create(path, False)
    except Exception as fault:
        if fs.exists(path):
            newer = latest(spark, folder)
            if token is not None and token < newer.token:
                raise Fenced(f"token {token} is below {newer.token}") from fault
            raise Conflict(f"version {new.number} is there already") from fault
        raise
    try:
        out.write(bytearray(json.dumps({"token": new.token, "state": state}).encode()))
    finally:
        out.close()
    return new


def bucket_of(keys: Sequence[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def rows_of(spark: SparkSession, folder: str, version: Version | None = None) -> DataFrame | None:
    """The rows of a version, the newest if none is given; None of a table that has no version."""
    v = version or latest(spark, folder)
    if v.number < 0:
        return None
    paths = sorted(p for p in v.state["buckets"].values())
    df = spark.read.schema(v.state["schema"])
    return df.parquet(*paths) if paths else spark.createDataFrame([], v.state["schema"])


def upsert(rows: DataFrame, folder: str, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, buckets: int = 16, token: int | None = None, after: Version | None = None) -> Version:
    """Rows with new keys are added, those with known keys replace the old ones, or go through merge(old, new) if it is given.

    Only the buckets that rows has keys of are written anew. The number of buckets is fixed by the first commit; keys shouldn't repeat
    in rows. after is the version that the writer has seen, the newest if it isn't given.
    """
    spark = rows.sparkSession
    v = after or latest(spark, folder)
    if token is not None and token < v.token:
        raise Fenced(f"token {token} is below {v.token}")
    state = v.state or {"n": buckets, "buckets": {}, "schema": _ddl(rows)}
    dealt = rows.withColumn("__bucket", bucket_of(keys, state["n"]))
    touched = sorted(r[0] for r in dealt.select("__bucket").distinct().collect())  # at most the number of buckets
    known = [state["buckets"][str(b)] for b in touched if str(b) in state["buckets"]]
    made = rows
    if known:
        old = spark.read.schema(state["schema"]).parquet(*known)
        made = merge(old, rows) if merge else old.join(rows.select(*keys), [*keys], "left_anti").unionByName(rows)
    elif merge:
        made = merge(spark.createDataFrame([], state["schema"]), rows)
    home = f"{folder}/data-{uuid.uuid4().hex}"
    made = made.select(*rows.columns).withColumn("__bucket", bucket_of(keys, state["n"]))
    made.repartition(max(1, len(touched)), "__bucket").write.partitionBy("__bucket").parquet(home)
    now = state["buckets"] | {str(b): f"{home}/__bucket={b}" for b in touched}
    return commit(spark, folder, v, state | {"buckets": now}, token)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
