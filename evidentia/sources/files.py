"""Workspace files and metadata payloads as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modified, length) of files below a folder; contents aren't read, as the column is pruned."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def latest(files: DataFrame, n: int = 8) -> DataFrame:
    return files.orderBy(F.desc("modified"), "path").limit(n)


def texts(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(path, text, sha256) of whole text files."""
    rows = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text"), F.sha2("value", 256).alias("sha256"))


def uploads(spark: SparkSession, folder: str, most: int = 50 << 20) -> DataFrame:
    """(path, length, accepted): a PDF by its first bytes, of most bytes at most."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", ((F.col("length") <= most) & (F.substring("content", 1, 5).cast("string") == "%PDF-")).alias("accepted"))


def crossref_records(payload: Column) -> Column:
    """Records of a Crossref answer: array<struct<doi, title, published, abstract>>, dates in the precision given."""
    shape = "struct<message:struct<items:array<struct<DOI:string,title:array<string>,abstract:string,issued:struct<`date-parts`:array<array<int>>>>>>>"
    items = F.from_json(payload, shape)["message"]["items"]
    parts = lambda x: F.transform(x["issued"]["date-parts"][0], lambda n: F.lpad(n.cast("string"), F.when(n > 31, 4).otherwise(2), F.lit("0")))
    return F.transform(items, lambda x: F.struct(x["DOI"].alias("doi"), x["title"][0].alias("title"), F.array_join(parts(x), "-").alias("published"), F.regexp_replace(x["abstract"], r"<[^>]*>", "").alias("abstract")))


def atom_records(payload: Column) -> Column:
    """Entries of an Atom feed: array<struct<id, title, published>>."""
    ids, titles, dates = (F.xpath(payload, F.lit(f"/feed/entry/{n}/text()")) for n in ("id", "title", "published"))
    return F.transform(F.arrays_zip(ids.alias("id"), titles.alias("title"), dates.alias("published")), lambda x: F.struct(x["id"].alias("id"), F.trim(x["title"]).alias("title"), F.left(x["published"], F.lit(10)).alias("published")))
