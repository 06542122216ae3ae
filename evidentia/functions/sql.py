"""The library's operators as SQL functions of a session: expressions where SQL has them, Python table functions where a text is cut."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from evidentia.operators import passages

#: name(arguments) RETURNS type RETURN expression.
EXPRESSIONS = (
    "term_count(body STRING, term STRING) RETURNS DOUBLE RETURN CAST((length(lower(body)) - length(replace(lower(body), lower(term), ''))) / length(term) AS DOUBLE)",
    "bm25_part(tf DOUBLE, df DOUBLE, n DOUBLE, dl DOUBLE, mean DOUBLE) RETURNS DOUBLE RETURN greatest(ln((n - df + 0.5D) / (df + 0.5D)), 1e-6D) * tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * dl / mean))",
    "content_stamp(body STRING) RETURNS STRING RETURN sha2(coalesce(body, ''), 256)",
)


def _shape(names: dict) -> StructType:
    out = StructType()
    for name, kind in names.items():
        out = out.add(name, kind)
    return out


def _texts(given: dict[str, AnalyzeArgument], *names: str) -> None:
    for name in names:
        if name in given and not isinstance(given[name].dataType, StringType):
            raise ValueError(f"{name} must be a string")


class TokenChunks:
    """token_chunks(body, size => 112, step => 88): (ord, start, end, section, chunk) of a text's windows of white-space words."""

    @staticmethod
    def analyze(body: AnalyzeArgument, size: AnalyzeArgument | None = None, step: AnalyzeArgument | None = None) -> AnalyzeResult:
        _texts({"body": body}, "body")
        for arg in (size, step):
            if arg is not None and not (arg.value and arg.value > 0):
                raise ValueError("size and step must be positive constants")
        return AnalyzeResult(_shape({"ord": IntegerType(), "start": IntegerType(), "end": IntegerType(), "section": StringType(), "chunk": StringType()}))

    def eval(self, body: str, size: int = 112, step: int = 88):
        for k, start, end, _, _, section, chunk in passages.token_windows(body, passages.word_offsets(body), size, step) if body else ():
            yield k, start, end, section, chunk


class MarkdownChunks:
    """markdown_chunks(body): (ord, section, chunk) of a text's sections, packed."""

    @staticmethod
    def analyze(body: AnalyzeArgument) -> AnalyzeResult:
        _texts({"body": body}, "body")
        return AnalyzeResult(_shape({"ord": IntegerType(), "section": StringType(), "chunk": StringType()}))

    def eval(self, body: str):
        for k, (section, chunk) in enumerate(passages.markdown_chunks(body or "")):
            yield k, section, chunk


class QuoteSpan:
    """quote_span(body, quote): (start, end) of the first place where a quote lies, white space aside; no row if it doesn't."""

    @staticmethod
    def analyze(body: AnalyzeArgument, quote: AnalyzeArgument) -> AnalyzeResult:
        _texts({"body": body, "quote": quote}, "body", "quote")
        return AnalyzeResult(_shape({"start": IntegerType(), "end": IntegerType()}))

    def eval(self, body: str, quote: str):
        wanted = "".join((quote or "").split())
        kept = [k for k, c in enumerate(body or "") if not c.isspace()] if len(wanted) >= 12 else []
        at = "".join(body[k] for k in kept).find(wanted) if kept else -1
        if at >= 0:
            yield kept[at], kept[at + len(wanted) - 1] + 1


TABLES = {"token_chunks": TokenChunks, "markdown_chunks": MarkdownChunks, "quote_span": QuoteSpan}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; their names. Registering again replaces them."""
    for made in EXPRESSIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {made}")
    for name, kind in TABLES.items():
        spark.udtf.register(name, udtf(kind))
    return [*(made.split("(")[0] for made in EXPRESSIONS), *TABLES]
