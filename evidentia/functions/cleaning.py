"""Column expressions for identifiers, labels, status and text hygiene.

The patterns of identifiers, labels, number cells and access pages are fixed values.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: States that a better one outlives.
LOW_CONFIDENCE = ("metadata_only", "missing_fulltext", "parse_failed", "failed")


def merged_status(current: Column, incoming: Column, parsed_path: Column, fulltext_path: Column, exists: Column) -> Column:
    """The status after an update: a weak one never replaces what files or a stronger status prove."""
    new, old = F.coalesce(incoming, F.lit("metadata_only")), F.coalesce(current, F.lit("metadata_only"))
    weak = new.isin(*LOW_CONFIDENCE)
    return (
        F.when(~exists, new)
        .when(weak & parsed_path.isNotNull(), "parsed")
        .when(weak & fulltext_path.isNotNull() & old.isin(*LOW_CONFIDENCE), "downloaded")
        .when(weak & old.isin("off_topic", "parsed", "downloaded"), old)
        .when((old == "parsed") & (new == "downloaded"), old)
        .otherwise(new)
    )


def doi(raw: Column) -> Column:
    bare = F.rtrim(F.lower(F.regexp_replace(F.trim(raw), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")), F.lit(" ."))
    return F.when(bare.rlike(r"^10\.\d+/.+$"), bare)


def arxiv(raw: Column, url: Column) -> Column:
    """An arXiv identifier without its version, from the field or else the address."""
    linked = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)arxiv\.org/(?:abs|pdf)/([^?#]+)", 1)
    x = F.when(F.coalesce(raw, F.lit("")) != "", raw).otherwise(linked)
    for pattern in (r"(?i)^(?:arxiv:|https?://arxiv\.org/(?:abs|pdf)/)", r"(?i)\.pdf$", r"(?i)v\d+$"):
        x = F.regexp_replace(x, pattern, "")
    x = F.lower(F.trim(x))
    return F.when(x.rlike(r"^(?:\d{4}\.\d{4,5}|[a-z][a-z.\-]*/\d{7})$"), x)


def semantic_id(raw: Column) -> Column:
    """A scholar index's identifier; words for "none" are null."""
    x = F.lower(F.trim(raw))
    return F.when(~x.isin("", "unknown", "none", "null", "n/a", "-"), x)


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility forms composed (NFKC) and case folded, for which Spark has no function."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def folded_title(raw: Column) -> Column:
    """A title for comparison: folded, with single blanks and without a full stop at its end."""
    return F.rtrim(F.trim(F.regexp_replace(folded(raw), r"\s+", " ")), F.lit("."))


def bare_name(raw: Column) -> Column:
    """A name's letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(raw), r"[^\p{L}\p{N}]+", "")


def table_label(raw: Column) -> Column:
    """A table cell without citations, bold and code marks."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]", ""), r"\*\*|`", ""), F.lit(" |"))


def bare(raw: Column) -> Column:
    """Word characters only, in lower case."""
    return F.regexp_replace(F.lower(raw), r"[^\p{L}\p{N}_]+", "")


def metric_label(raw: Column) -> Column:
    return bare(F.regexp_replace(table_label(raw), r"(?i)\((?:px|ms|s|fps|%)\)", ""))


def model_label(raw: Column) -> Column:
    return bare(F.regexp_replace(F.regexp_replace(table_label(raw), r"(?i)<br\s*/?>", ""), r"(?i)\s*\((?:ours|our method)\)\s*$", ""))


def numeric_cell(raw: Column) -> Column:
    """The number of a cell that holds one, with a unit and a trailing change in percent at most."""
    cell = F.trim(F.replace(table_label(raw), F.lit("−"), F.lit("-")), F.lit("* "))
    number = F.regexp_extract(cell, r"(?i)^([-+]?\d+(?:\.\d+)?)(?:\s*(?:px|ms|s|fps|%))?(?:\s*\(?[-+]\s*\d+(?:\.\d+)?\s*%\)?)?$", 1)
    return F.when(number != "", number.try_cast("double"))


def access_page(text: Column) -> Column:
    """Why a text is no paper: nothing left without page headers, or a short page that only asks for access."""
    content = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^## Page \d+\s*", ""))
    asks = r"(?i)javascript is disabled|enable javascript to (?:proceed|continue)|checking your browser|verify (?:that )?you are human|access denied|just a moment\.\.\.|captcha verification"
    return F.when(content == "", "empty").when((F.length(content) < 5000) & content.rlike(asks), "access_page").otherwise("")


def scrub(text: Column) -> Column:
    """Keys, tokens and absolute paths out of a text that leaves the system."""
    rules = (
        (r"sk-[A-Za-z0-9_-]{8,}", "[secret]"),
        (r"(?i)(api[_-]?key|token|password)\s*[:=]\s*[^\s,;]+", "$1=[secret]"),
        (r"(?i)bearer\s+[A-Za-z0-9._-]{8,}", "Bearer [secret]"),
        (r"(?:/home|/Users|/root)/[^\s'\"]+", "[path]"),
    )
    return reduce(lambda x, r: F.regexp_replace(x, *r), rules, text)


def coerce_list(raw: Column) -> Column:
    """Items of a free list: cut at line ends, semicolons and commas of either width; null words are none."""
    items = F.transform(F.split(F.coalesce(raw, F.lit("")), r"[\n;,；，]"), lambda x: F.trim(x))
    return F.filter(items, lambda x: ~F.lower(x).isin("", "none", "null", "n/a", "unknown"))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based identifier (version 5) of a name within a namespace, itself an identifier."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1, 1)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))
