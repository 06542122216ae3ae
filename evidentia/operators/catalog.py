"""Catalog operators: upserts, folding, facets, digests and incremental index maintenance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.cleaning import merged_status
from evidentia.sources.sinks import materialize


def visible(papers: DataFrame, organisation: DataFrame) -> DataFrame:
    """Canonical papers that are neither prior notes nor off topic; a null status is visible."""
    joined = papers.join(organisation.select(F.col("paper_id").alias("id"), "canonical_id"), "id", "left")
    return joined.where("coalesce(status, '') <> 'off_topic' AND (canonical_id IS NULL OR canonical_id = id)").drop("canonical_id")


def keep_latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in the given ascending order, by one aggregation that combines before its shuffle."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], F.struct(*rows.columns).alias("row"))).alias("best"))
    return best.select("best.row.*")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer merge of (id, title, status, fulltext_path, parsed_path): new fields win, paths keep what they had, the status
    never falls to a weaker one."""
    o, n = old.alias("o"), new.alias("n")
    status = merged_status(F.col("o.status"), F.col("n.status"), F.col("o.parsed_path"), F.col("o.fulltext_path"), F.col("o.id").isNotNull())
    return o.join(n, F.col("o.id") == F.col("n.id"), "full_outer").select(
        F.coalesce("n.id", "o.id").alias("id"),
        F.when(F.col("n.id").isNotNull(), F.col("n.title")).otherwise(F.col("o.title")).alias("title"),
        F.when(F.col("n.id").isNull(), F.col("o.status")).otherwise(status).alias("status"),
        F.coalesce("n.fulltext_path", "o.fulltext_path").alias("fulltext_path"),
        F.coalesce("n.parsed_path", "o.parsed_path").alias("parsed_path"),
    )


#: How the names of first-hand date sources begin: fixed value.
FIRST_HAND = "arxiv"


def kept_date(old_date: Column, old_source: Column, new_date: Column, new_source: Column) -> Column:
    """struct<date, source> after an update: what is new counts and what it lacks stays, each by itself. But both stay as they were if
    the old source is first-hand and the new one isn't, or if it is, the old date tells the day and the new one doesn't."""
    given = lambda c: F.nullif(c, F.lit(""))
    first_hand = lambda c: F.coalesce(F.startswith(c, F.lit(FIRST_HAND)), F.lit(False))
    date, source = F.coalesce(given(new_date), given(old_date)), F.coalesce(given(new_source), given(old_source))
    coarser = (F.length(old_date) == 10) & (F.coalesce(F.length(date), F.lit(0)) < 10)
    stays = first_hand(old_source) & (~first_hand(source) | F.coalesce(coarser, F.lit(False)))
    return F.struct(F.when(stays, given(old_date)).otherwise(date).alias("date"), F.when(stays, old_source).otherwise(source).alias("source"))


def upsert_dates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer merge of (id, publication_date, date_source) by kept_date; ids are unique on each side."""
    o, n = old.alias("o"), new.alias("n")
    kept = kept_date(F.col("o.publication_date"), F.col("o.date_source"), F.col("n.publication_date"), F.col("n.date_source"))
    both = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer").select(F.coalesce("n.id", "o.id").alias("id"), kept.alias("kept"))
    return both.select("id", F.col("kept.date").alias("publication_date"), F.col("kept.source").alias("date_source"))


def pending_groups(now: DataFrame, last: DataFrame, key: str) -> DataFrame:
    """The groups of (key, n, digest) that a last run of (key, digest) has not seen, or has seen with other rows."""
    return now.join(last.select(F.col(key), F.col("digest").alias("__last")), key, "left").where(~F.coalesce(F.col("digest") == F.col("__last"), F.lit(False))).drop("__last")


@dataclass(frozen=True)
class FacetRule:
    """A value of a facet, given where pattern matches the title or a tag; exclude speaks against it in either, require_title and
    exclude_title look at the title alone, and only_if_empty waits until no earlier rule has given the facet a value."""

    facet: str
    value: str
    pattern: str
    exclude: str | None = None
    require_title: str | None = None
    exclude_title: str | None = None
    only_if_empty: bool = False


def rule_facets(title: Column, tags: Column, rules: Sequence[FacetRule]) -> dict[str, Column]:
    """For each facet the values whose rule matches, each once, in the order of the rules."""
    name = F.lower(F.coalesce(title, F.lit("")))
    whole = F.concat_ws(" ", name, F.lower(F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")))
    out: dict[str, Column] = {}
    for r in rules:
        known = out.get(r.facet, F.array().cast("array<string>"))
        hit = whole.rlike(r.pattern)
        for text, pattern, wanted in ((whole, r.exclude, False), (name, r.require_title, True), (name, r.exclude_title, False)):
            if pattern is not None:
                hit = hit & (text.rlike(pattern) if wanted else ~text.rlike(pattern))
        if r.only_if_empty:
            hit = hit & (F.size(known) == 0)
        out[r.facet] = F.when(hit, F.array_union(known, F.array(F.lit(r.value)))).otherwise(known)
    return out


def facet_counts(rows: DataFrame, facet: str, vocabulary: Sequence[str], unspecified: str = "unspecified") -> DataFrame:
    """(value, n) for the whole vocabulary and the rows without a value; a row counts for each of its values."""
    spark = rows.sparkSession
    values = rows.select(F.explode(F.when(F.size(facet) > 0, F.col(facet)).otherwise(F.array(F.lit(unspecified)))).alias("value"))
    all_ = spark.createDataFrame([(v,) for v in (*vocabulary, unspecified)], "value string")
    return F.broadcast(all_).join(values.groupBy("value").agg(F.count("*").alias("n")), "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def index_delta(source: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of (id, sha) that the index of (id, sha) lacks in this version."""
    return source.join(index, ["id", "sha"], "left_anti")


def index_outcomes(source: DataFrame, index: DataFrame) -> DataFrame:
    """(outcome, n): reused, indexed, empty or pruned; an empty text also counts among the indexed."""
    both = source.alias("s").join(index.alias("i"), F.col("s.id") == F.col("i.id"), "full_outer")
    outcome = F.when(F.col("s.id").isNull(), "pruned").when(F.col("s.sha") == F.col("i.sha"), "reused").when(F.length("s.text") == 0, "empty").otherwise("indexed")
    return both.select(outcome.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def _row_digest(*columns: str) -> Column:
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint").cast("decimal(38,0)")


def table_digest(rows: DataFrame, *columns: str) -> DataFrame:
    """(n, digest): a digest of the rows in any order, as a sum of row digests modulo 2**60, which needs no sort."""
    return rows.agg(F.count("*").alias("n"), (F.sum(_row_digest(*columns)) % (1 << 60)).cast("bigint").alias("digest"))


def group_digest(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, n, digest): the same for each group; sums combine before the shuffle, so a large group is no task's burden."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), (F.sum(_row_digest(*columns)) % (1 << 60)).cast("bigint").alias("digest"))


def numbered(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """rows with their number, from 1, within key in order. Ranges of (key, order) are numbered side by side and offset by the counts
    of the ranges before, so a key with many rows is spread over tasks. Pairs (key, order) should be distinct."""
    ranged = materialize(rows.repartitionByRange(key, order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(key, "__range").agg(F.count("*").alias("__n"))  # a row for each range and key in it
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__range")) - F.col("__n")
    offsets = counts.select(F.col(key).alias("__key"), F.col("__range").alias("__in"), before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range", key).orderBy(order))
    joined = ranged.withColumn("__own", own).join(offsets, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__in")))
    return joined.withColumn(name, (F.col("__own") + F.col("__before")).cast("bigint")).drop("__range", "__own", "__before", "__key", "__in")


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered table; only the rows up to its end are ordered."""
    return rows.orderBy(*order).limit((number + 1) * size).orderBy(*order).offset(number * size)


def first_by_ordinal(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Ordered distinct: each key with its first ordinal."""
    return rows.groupBy(key).agg(F.min(ordinal).alias(ordinal))


def newest(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__turn", turn).where("__turn = 1").drop("__turn")
