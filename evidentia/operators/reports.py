"""Validation of reports and of their revisions by lists of rules, each an expression over the text and what it may cite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least characters, and what must not stand in a text for readers.
LEAST, LEAST_REVISION = 300, 80
INNER = r"(?i)<think|```json|coverage_summary|claim_\d+|evidence_ids|paper_id"
FIELDS = r"(?<![A-Za-z0-9_])(?:execution_summary|included_records|search_records_not_admitted|unexecuted_queries|extraction_failed|not_analyzed|eligible|exhaustive)(?![A-Za-z0-9_])"
INNER_REVISION = r"(?i)<think|```(?:json)?\s*\{|\b(?:paper_id|evidence_ids|exhaustive|execution_summary|candidate_status)\b"
REFERENCES = r"(?im)^##[ \t]+(?:参考文献|References)"
URL, CITED = r"https?://[^\s<>\)]+", r"\[(\d+)\]"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))


def citations(text: Column) -> Column:
    """The numbers that a text cites, each once."""
    return F.array_distinct(F.transform(_all(text, CITED, 1), lambda n: n.try_cast("bigint")))


def headings(text: Column) -> Column:
    """Second-level headings in order."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^##[ \t]+([^\r\n]+)"), F.lit(1))


def body(text: Column) -> Column:
    """What stands before a list of references."""
    return F.rtrim(F.get(F.split(text, REFERENCES + r"[ \t]*\r?$", 2), F.lit(0)))


def _said(rules: Sequence[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules]))


def validate_reports(rows: DataFrame, required: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """rows of (text, sources array<bigint>, ...) with errors, the names of the rules that a report breaks.

    A text of under LEAST characters is too_short and no more. Otherwise: inner_data and inner_fields are marks of the program,
    unknown_citation and no_citation look at the numbers in sources, missing:<heading> and order at the required headings,
    unwanted:<heading> at forbidden ones. Null sources are none.
    """
    text, sources = F.coalesce("text", F.lit("")), F.coalesce("sources", F.array().cast("array<bigint>"))
    found = rows.withColumns({"__cited": citations(text), "__heads": headings(text)})
    heads, cited = F.col("__heads"), F.col("__cited")
    places = F.array(*[F.array_position(heads, h) for h in required]).cast("array<bigint>")
    complete = ~F.array_contains(places, 0)
    rules = [
        ("inner_data", text.rlike(INNER)), ("inner_fields", text.rlike(FIELDS)), ("unknown_citation", F.size(F.array_except(cited, sources)) > 0), ("no_citation", (F.size(sources) > 0) & (F.size(cited) == 0)),
        *((f"missing:{h}", ~F.array_contains(heads, h)) for h in required), ("order", complete & (places != F.array_sort(places))), *((f"unwanted:{h}", F.array_contains(heads, h)) for h in forbidden),
    ]
    short = F.length(F.trim(text)) < LEAST
    return found.withColumn("errors", F.when(short, F.array(F.lit("too_short"))).otherwise(_said(rules))).drop("__cited", "__heads")


def validate_revisions(rows: DataFrame) -> DataFrame:
    """rows of (text, original, ...) with errors: a revision may cite and link only what its original does, must keep a citation if the
    original's body has one, needs a title, and must leave the list of references alone. A text of under LEAST_REVISION characters is
    too_short and no more."""
    text, old = F.coalesce("text", F.lit("")), F.coalesce("original", F.lit(""))
    found = rows.withColumns({"__cited": citations(text), "__allowed": citations(old)})
    rules = [
        ("unknown_citation", F.size(F.array_except("__cited", "__allowed")) > 0), ("lost_citations", body(old).rlike(CITED) & (F.size("__cited") == 0)), ("inner_data", text.rlike(INNER_REVISION)),
        ("no_title", ~text.rlike(r"(?m)^#[ \t]+\S")), ("references", text.rlike(REFERENCES)), ("new_link", F.size(F.array_except(_all(text, URL), _all(old, URL))) > 0),
    ]
    short = F.length(F.trim(text)) < LEAST_REVISION
    return found.withColumn("errors", F.when(short, F.array(F.lit("too_short"))).otherwise(_said(rules))).drop("__cited", "__allowed")
