"""Readers, and the views that map generic tables onto the catalog's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A paper for each document. Every third id ends in a version of another's identifier.
PAPER_COLUMNS = (
    "doc_id AS id",
    "text",
    "split_part(text, chr(10), 1) AS title",
    "CASE WHEN doc_id % 8 < 5 THEN CASE WHEN doc_id % 2 = 0 THEN 'Ann Lee;B. Roe' ELSE 'b roe;Ann LEE' END END AS authors",
    "CASE WHEN doc_id % 11 = 0 THEN concat('S', CAST(doc_id % 900 AS STRING)) WHEN doc_id % 11 = 1 THEN 'Unknown' END AS semantic_id",
    "lang AS category",
    "source AS venue",
    "n_chars",
    "CASE WHEN toxic = 1 THEN 'off_topic' WHEN quality = 1 THEN 'parsed' WHEN quality = 0 THEN 'downloaded' END AS status",
    "CAST(2015 + doc_id % 10 AS INT) AS year",
    "CASE doc_id % 4 WHEN 0 THEN CAST(2015 + doc_id % 10 AS STRING)"
    " WHEN 1 THEN concat(CAST(2015 + doc_id % 10 AS STRING), '-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'))"
    " WHEN 2 THEN concat(CAST(2015 + doc_id % 10 AS STRING), '-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'))"
    " END AS publication_date",
    "CASE WHEN doc_id % 3 = 0 THEN concat('https://doi.org/10.1234/AB.', CAST(doc_id % 500 AS STRING), '.') WHEN doc_id % 3 = 1 THEN 'not a doi' END AS doi",
    "CASE WHEN doc_id % 5 = 0 THEN concat('arXiv:', CAST(2000 + doc_id % 12 + 1 AS STRING), '.', lpad(CAST(doc_id % 700 AS STRING), 5, '0'), 'v', CAST(1 + doc_id % 3 AS STRING)) END AS arxiv_id",
    "CASE WHEN doc_id % 7 = 0 THEN concat('https://arxiv.org/abs/', CAST(1900 + doc_id % 12 + 1 AS STRING), '.', lpad(CAST(doc_id % 300 AS STRING), 5, '0')) WHEN doc_id % 7 = 1 THEN concat('http://host.example/p/', CAST(doc_id AS STRING), '.pdf') END AS url",
    "CASE WHEN doc_id % 2 = 0 THEN concat('fulltext/', CAST(doc_id AS STRING), '.md') END AS fulltext_path",
    "CASE WHEN doc_id % 6 = 0 THEN concat('parsed/', CAST(doc_id AS STRING), '.md') END AS parsed_path",
)


def papers(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, *more: str) -> DataFrame:
    """Catalog rows: documents, or what stands for them, with a status from labels and identifiers from the id, and more columns of docs."""
    docs, labels = table(spark, sf_dir, "documents") if docs is None else docs, table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").selectExpr(*PAPER_COLUMNS, *more)


def organisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, canonical_id, category): equal texts fold onto the smallest id."""
    keyed = table(spark, sf_dir, "documents").selectExpr("doc_id AS paper_id", "sha2(text, 256) AS h", "lang AS category")
    lowest = keyed.groupBy("h").agg({"paper_id": "min"}).withColumnRenamed("min(paper_id)", "canonical_id")
    return keyed.join(lowest, "h").select("paper_id", "canonical_id", "category")


#: The same views for SQL, to stand behind WITH.
PAPERS_SQL = "papers AS (SELECT " + ", ".join(PAPER_COLUMNS) + " FROM (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id))"
ORGANISATION_SQL = "organisation AS (SELECT doc_id AS paper_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical_id, lang AS category FROM documents)"
