"""Leaderboards with ties, and date scopes of variable precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import cleaning as T


def leaderboard(rows: DataFrame, keys: list[str], value: str, lower_is_better: bool = True) -> DataFrame:
    """All rows that tie for the best value of their key; a join to an aggregate that combines before its shuffle."""
    best = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg((F.min if lower_is_better else F.max)(value).alias("__best"))
    return rows.join(best, keys).where(F.col(value) == F.col("__best")).drop("__best")


def bounds(published: Column, year: Column) -> tuple[Column, Column]:
    """First and last day that a date of year, month or day precision may mean; null where nothing is known."""
    known = F.coalesce(published, F.lit(""))
    whole = F.when(known.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(known))
    month = F.when(known.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(known, F.lit("-01"))))
    only = F.coalesce(year, F.when(known.rlike(r"^\d{4}"), F.substring(known, 1, 4).cast("int")))
    low = F.coalesce(whole, month, F.make_date(only, F.lit(1), F.lit(1)))
    return low, F.coalesce(whole, F.last_day(month), F.make_date(only, F.lit(12), F.lit(31)))


def date_scope(published: Column, year: Column, start: str, end: str) -> Column:
    """in_scope, outside_scope or date_unconfirmed, by interval containment."""
    low, high = bounds(published, year)
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return F.when((high < first) | (low > last), "outside_scope").when((low >= first) & (high <= last), "in_scope").otherwise("date_unconfirmed")


#: What a dataset's and a metric's name may carry without naming another one, and the word for no protocol.
TEST_SET = r"(?i)[（(]\s*(?:test|test(?:ing)?\s+set|测试集)\s*[）)]"
PIXELS = r"(?i)\(\s*px\s*\)"
NO_PROTOCOL = "unstated"


def same_name(label: Column) -> Column:
    """Letters and digits of a label, in lower case."""
    return F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", "")


def reported_best(rows: DataFrame, lower_is_better: bool = True, controlled: bool = False) -> DataFrame:
    """The rows of (grp, dataset, metric, protocol, value, eligible, ...) that report the best value, with ties, and n_eligible of their
    group.

    Values compare within a group, dataset and metric, whatever the notes on test sets and pixels in their names; in a controlled
    comparison also within a protocol. Units of time and percent stay apart. Rows that aren't eligible, or whose value is null or
    no number, are no candidates.
    """
    protocol = F.coalesce(F.nullif(F.trim("protocol"), F.lit("")), F.lit(NO_PROTOCOL)) if controlled else F.lit("")
    parts = {"by_dataset": same_name(F.regexp_replace("dataset", TEST_SET, "")), "by_metric": same_name(F.regexp_replace("metric", PIXELS, "")), "by_protocol": protocol}
    open_ = rows.where(F.col("eligible") & F.col("value").isNotNull() & ~F.isnan("value")).withColumns(parts)
    counts = open_.groupBy("grp").agg(F.count("*").alias("n_eligible"))
    return leaderboard(open_, ["grp", *parts], "value", lower_is_better).join(counts, "grp").drop(*parts)


def eligibility(rows: DataFrame, reviews: DataFrame, groups: list[str], all_time: list[str] = []) -> DataFrame:
    """rows (row_id, source_bound, role, scope, grp, ...) with the group that a review names, reason and eligible.

    The first reason against a row counts: unbound, not_proposed, its scope if that is neither in_scope nor unrestricted (unless its
    group, before or after review, is one for all times), not_reviewed, out_of_scope, group_unverified, unknown_group. reviews has
    (row_id, scope_match, group_verified, grp) with one row an id; a review names a listed group in any spelling.
    """
    known = F.array(*map(F.lit, groups))
    listed = lambda g: F.coalesce(F.get(F.filter(known, lambda k: same_name(k) == same_name(g)), F.lit(0)), g)
    found = rows.join(reviews.select("row_id", "scope_match", "group_verified", F.nullif("grp", F.lit("")).alias("named")), "row_id", "left").withColumn("grp", listed(F.coalesce("named", "grp")))
    timely = F.col("scope").isin("in_scope", "unrestricted") | F.col("grp").isin(all_time)
    reason = (
        F.when(~F.coalesce("source_bound", F.lit(False)), "unbound")
        .when(F.coalesce("role", F.lit("")) != "proposed", "not_proposed")
        .when(~timely, F.col("scope"))
        .when(F.col("scope_match").isNull(), "not_reviewed")
        .when(~F.col("scope_match"), "out_of_scope")
        .when(~F.coalesce("group_verified", F.lit(False)), "group_unverified")
        .when(~F.coalesce(F.array_contains(known, F.col("grp")), F.lit(False)), "unknown_group")
        .otherwise("")
    )
    return found.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "").drop("scope_match", "group_verified", "named")


def resolved_models(models: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, match, n) of (id, model): the smallest of the n titles (id, title) whose whole leading name, before a colon, is the model's.

    Names are compared by their letters and digits, so a name that another one begins with doesn't match. A row for each model that
    is found: titles of one name are counted before the join, so rows don't multiply. An empty name is found nowhere.
    """
    name = lambda c: T.model_label(F.get(F.split(c, "[:：]", 2), F.lit(0)))
    known = titles.select(name(F.col("title")).alias("key"), "id").where("key <> ''").groupBy("key").agg(F.min("id").alias("match"), F.count("*").alias("n"))
    return models.select("id", T.model_label(F.col("model")).alias("key")).where("key <> ''").join(known, "key").select("id", "match", "n")
