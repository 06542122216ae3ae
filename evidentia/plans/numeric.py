"""Numeric tables, leaderboards and date scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import cleaning as T
from evidentia.operators import numeric as N
from evidentia.operators import tables as B
from evidentia.plans.base import query
from evidentia.sources.tables import PAPERS_SQL, papers, table

OBS_SQL = "obs AS (SELECT l_orderkey, l_linenumber, p_brand AS model, p_type AS dataset, l_returnflag AS grp, l_quantity AS value, l_linestatus = 'O' AS eligible FROM lineitem JOIN part ON p_partkey = l_partkey)"


def observations(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("model"), F.col("p_type").alias("dataset"))
    return table(spark, d, "lineitem").join(parts, "l_partkey").select("l_orderkey", "l_linenumber", "model", "dataset", F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("value"), (F.col("l_linestatus") == "O").alias("eligible"))


@query("leaderboard_ties", f"WITH {OBS_SQL} SELECT grp, dataset, model, l_orderkey, l_linenumber, value FROM (SELECT *, min(value) OVER (PARTITION BY grp, dataset) AS best FROM obs WHERE eligible) WHERE value = best")
def leaderboard_ties(spark, d):
    return N.leaderboard(observations(spark, d).where("eligible"), ["grp", "dataset"], "value").select("grp", "dataset", "model", "l_orderkey", "l_linenumber", "value")


@query("baseline_leads", f"WITH {OBS_SQL}, peer AS (SELECT dataset, min(value) AS best FROM obs WHERE eligible AND value > 3 GROUP BY dataset), b AS (SELECT o.model, min(o.value) AS value FROM obs o JOIN peer p ON p.dataset = o.dataset WHERE NOT eligible AND o.value < p.best GROUP BY o.model) SELECT model, value FROM b ORDER BY value, model LIMIT 6")
def baseline_leads(spark, d):
    rows = observations(spark, d)
    peer = rows.where("eligible AND value > 3").groupBy("dataset").agg(F.min("value").alias("best"))
    return rows.where("NOT eligible").join(peer, "dataset").where("value < best").groupBy("model").agg(F.min("value").alias("value")).orderBy("value", "model").limit(6)


@query("label_clean", "SELECT p_partkey, trim(regexp_replace(regexp_replace(x, '\\[\\s*\\d+(?:\\s*,\\s*\\d+)*\\s*\\]', '', 'g'), '\\*\\*|`', '', 'g'), ' |') AS label, regexp_replace(lower(regexp_replace(trim(regexp_replace(regexp_replace(x, '\\[\\s*\\d+(?:\\s*,\\s*\\d+)*\\s*\\]', '', 'g'), '\\*\\*|`', '', 'g'), ' |'), '(?i)\\s*\\((?:ours|our method)\\)\\s*$', '')), '[^\\p{L}\\p{N}_]+', '', 'g') AS model FROM (SELECT p_partkey, concat('| **', p_name, '** [', p_size, ', 2] (Ours) |') AS x FROM part)".replace("\\\\", "\\"))
def label_clean(spark, d):
    x = F.concat(F.lit("| **"), "p_name", F.lit("** ["), "p_size", F.lit(", 2] (Ours) |"))
    return table(spark, d, "part").select("p_partkey", T.table_label(x).alias("label"), T.model_label(x).alias("model"))


@query("numeric_cell", r"SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_retailprice END AS number FROM part")
def numeric_cell(spark, d):
    price = F.format_string("%.2f", "p_retailprice")
    cell = F.when(F.col("p_partkey") % 4 == 0, price).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("**"), price, F.lit("** px"))).when(F.col("p_partkey") % 4 == 2, F.concat(price, F.lit("−25.5%"))).otherwise(F.concat(price, F.lit(" of 7")))
    return table(spark, d, "part").select("p_partkey", T.numeric_cell(cell).alias("number"))


SCOPE_SQL = r"""b AS (SELECT id, year, publication_date, CASE WHEN regexp_matches(coalesce(publication_date, ''), '^\d{4}-\d{2}-\d{2}$') THEN publication_date::DATE WHEN regexp_matches(coalesce(publication_date, ''), '^\d{4}-\d{2}$') THEN concat(publication_date, '-01')::DATE ELSE make_date(year, 1, 1) END AS low,
CASE WHEN regexp_matches(coalesce(publication_date, ''), '^\d{4}-\d{2}-\d{2}$') THEN publication_date::DATE WHEN regexp_matches(coalesce(publication_date, ''), '^\d{4}-\d{2}$') THEN last_day(concat(publication_date, '-01')::DATE) ELSE make_date(year, 12, 31) END AS high FROM papers),
sc AS (SELECT *, CASE WHEN high < DATE '2018-04-10' OR low > DATE '2021-08-31' THEN 'outside_scope' WHEN low >= DATE '2018-04-10' AND high <= DATE '2021-08-31' THEN 'in_scope' ELSE 'date_unconfirmed' END AS scope FROM b)"""
def scope():
    return N.date_scope(F.col("publication_date"), F.col("year"), "2018-04-10", "2021-08-31")


@query("date_scope", f"WITH {PAPERS_SQL}, {SCOPE_SQL} SELECT id, scope FROM sc")
def date_scope(spark, d):
    return papers(spark, d).select("id", scope().alias("scope"))


@query("date_scoped_rows", f"WITH {PAPERS_SQL}, {SCOPE_SQL} SELECT id, scope FROM sc WHERE scope <> 'outside_scope' ORDER BY scope = 'date_unconfirmed', id LIMIT 100")
def date_scoped_rows(spark, d):
    rows = papers(spark, d).select("id", scope().alias("scope")).where("scope <> 'outside_scope'")
    return rows.orderBy(F.col("scope") == "date_unconfirmed", "id").limit(100)


@query("group_scope", f"WITH {PAPERS_SQL}, {SCOPE_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN CASE WHEN coalesce(publication_date, year::VARCHAR) > substr('2021-08-31', 1, length(coalesce(publication_date, year::VARCHAR))) THEN 'outside_scope' ELSE 'unrestricted' END ELSE scope END AS scope FROM sc")
def group_scope(spark, d):
    shown = F.coalesce("publication_date", F.col("year").cast("string"))
    free = F.when(shown > F.left(F.lit("2021-08-31"), F.length(shown)), "outside_scope").otherwise("unrestricted")
    return papers(spark, d).select("id", F.when(F.col("id") % 2 == 0, free).otherwise(scope()).alias("scope"))


@query("arxiv_month", f"WITH {PAPERS_SQL}, x AS (SELECT id, publication_date, regexp_extract(coalesce(arxiv_id, ''), '^arXiv:(\\d{{4}})\\.\\d{{4,5}}(?:v\\d+)?$', 1) AS ym FROM papers) SELECT id, CASE WHEN ym = '' OR substr(ym, 3, 2)::INT NOT BETWEEN 1 AND 12 THEN publication_date WHEN regexp_matches(coalesce(publication_date, ''), '^\\d{{4}}-\\d{{2}}(-\\d{{2}})?$') AND substr(publication_date, 1, 7) < concat('20', substr(ym, 1, 2), '-', substr(ym, 3, 2)) THEN publication_date ELSE concat('20', substr(ym, 1, 2), '-', substr(ym, 3, 2)) END AS published FROM x")
def arxiv_month(spark, d):
    """The month that an identifier certifies replaces coarser or later dates; the day is never invented."""
    rows = papers(spark, d).select("id", "publication_date", F.regexp_extract(F.coalesce("arxiv_id", F.lit("")), r"^arXiv:(\d{4})\.\d{4,5}(?:v\d+)?$", 1).alias("ym"))
    month = F.concat(F.lit("20"), F.substring("ym", 1, 2), F.lit("-"), F.substring("ym", 3, 2))
    none = (F.col("ym") == "") | ~F.substring("ym", 3, 2).try_cast("int").between(1, 12)
    earlier = F.coalesce("publication_date", F.lit("")).rlike(r"^\d{4}-\d{2}(-\d{2})?$") & (F.substring("publication_date", 1, 7) < month)
    return rows.select("id", F.when(none | earlier, F.col("publication_date")).otherwise(month).alias("published"))


@query("relative_window", "SELECT o_orderkey, o_orderdate::DATE AS last, (o_orderdate::DATE - INTERVAL 18 MONTH)::DATE AS first FROM orders")
def relative_window(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", day.alias("last"), F.add_months(day, -18).alias("first"))


@query(
    "leading_name_join",
    "WITH t AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9_]+', '', 'g') AS k, min(p_partkey) AS match, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, match, n FROM part JOIN t ON k = regexp_replace(lower(p_name), '[^a-z0-9_]+', '', 'g')",
)
def leading_name_join(spark, d):
    """Each part's name against titles that begin with a part's name and go on behind a colon."""
    rows = table(spark, d, "part")
    models = rows.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" [3]")).alias("model"))
    titles = rows.select(F.col("p_partkey").alias("id"), F.concat(F.upper("p_name"), F.lit(": "), "p_type").alias("title"))
    return N.resolved_models(models, titles).select(F.col("id").alias("p_partkey"), "match", "n")


ELIGIBLE_SQL = OBS_SQL + """, e AS (SELECT l_orderkey, l_linenumber, model, dataset, value, CASE WHEN l_orderkey % 3 = 0 THEN 'A' ELSE obs.grp END AS grp, CASE WHEN value > 45 THEN 'unbound' WHEN obs.grp = 'R' THEN 'not_proposed' WHEN NOT eligible AND l_orderkey % 3 <> 0 THEN 'outside_scope' WHEN l_orderkey % 3 = 2 THEN 'not_reviewed' WHEN value < 3 THEN 'out_of_scope' WHEN l_orderkey % 3 = 1 AND obs.grp <> 'A' THEN 'unknown_group' ELSE '' END AS reason FROM obs)"""


def eligible(spark, d):
    """Rows with a bound value, a role and a scope, and reviews that name a group in another spelling."""
    rows = observations(spark, d)
    k = F.col("l_orderkey") % 3
    shaped = rows.select(F.concat_ws(":", "l_orderkey", "l_linenumber", "value").alias("row_id"), "l_orderkey", "l_linenumber", "model", "dataset", F.lit("Loss (px)").alias("metric"), F.lit("").alias("protocol"), "grp", "value", (F.col("value") <= 45).alias("source_bound"), F.when(F.col("grp") == "R", "baseline").otherwise("proposed").alias("role"), F.when(F.col("eligible") | (k == 0), "in_scope").otherwise("outside_scope").alias("scope"))
    reviews = shaped.select("row_id", F.when(k != 2, F.col("value") >= 3).alias("scope_match"), F.lit(True).alias("group_verified"), F.when(k == 0, " a ").alias("grp")).dropDuplicates(["row_id"])
    return N.eligibility(shaped, reviews, ["A"])


@query("eligibility", f"WITH {ELIGIBLE_SQL} SELECT l_orderkey, l_linenumber, grp, reason, reason = '' AS ok FROM e")
def eligibility(spark, d):
    return eligible(spark, d).select("l_orderkey", "l_linenumber", "grp", "reason", F.col("eligible").alias("ok"))


@query("reported_best", f"WITH {ELIGIBLE_SQL}, o AS (SELECT *, regexp_replace(lower(dataset), '[^a-z0-9]+', '', 'g') AS s FROM e WHERE reason = '') SELECT l_orderkey, l_linenumber, value, (SELECT count(*) FROM o q WHERE q.grp = p.grp) AS n_eligible FROM (SELECT *, min(value) OVER (PARTITION BY grp, s) AS best FROM o) p WHERE value = best")
def reported_best(spark, d):
    return N.reported_best(eligible(spark, d)).select("l_orderkey", "l_linenumber", "value", "n_eligible")


def quotes(spark, d):
    """A small table in text for each part; every third row claims a value of another column."""
    head, value = F.lit("| Method | Price | Size |\n| --- | --- | --- |\n"), F.format_string("| %s [%d] | %.1f | %d |", "p_name", F.col("p_size"), "p_retailprice", "p_size")
    wrong = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("double")).otherwise(F.round("p_retailprice", 1))
    return table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("model"), wrong.alias("value"), F.lit("Price").alias("metric"), F.concat(head, value).alias("quote"), F.array().cast("array<string>").alias("aliases"))


#: What the generated tables state, by construction.
BOUND_SQL = "b AS (SELECT p_partkey AS row_id, p_name AS model, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE ELSE round(p_retailprice, 1) END AS value, 'Price' AS metric, p_partkey % 3 <> 0 OR p_size = round(p_retailprice, 1) AS source_bound, 2015 + p_partkey % 10 AS year FROM part)"


@query("table_bind", f"WITH {BOUND_SQL} SELECT row_id, source_bound FROM b")
def table_bind(spark, d):
    return B.bind_values(quotes(spark, d)).select("row_id", "source_bound")


@query("numerical_rows", f"WITH {BOUND_SQL} SELECT row_id, model, value, metric, source_bound, CASE WHEN year BETWEEN 2018 AND 2021 THEN 'in_scope' ELSE 'outside_scope' END AS scope FROM b")
def numerical_rows(spark, d):
    year = (F.lit(2015) + F.col("row_id") % 10).cast("int")
    return B.bind_values(quotes(spark, d)).select("row_id", "model", "value", "metric", "source_bound", N.date_scope(F.lit(None).cast("string"), year, "2018-01-01", "2021-12-31").alias("scope"))


@query("own_names", "SELECT p_partkey, p_partkey % 3 = 0 AND p_partkey % 2 = 0 AS own FROM part")
def own_names(spark, d):
    """Only a proposed model whose name begins the title may be called "Ours"."""
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("_2024_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_: a study_"))).otherwise(F.concat(F.lit("On "), F.col("p_name")))
    role = F.when(F.col("p_partkey") % 3 == 0, "proposed").otherwise("baseline")
    return table(spark, d, "part").select("p_partkey", (F.size(B.own_names(F.col("p_name"), title, role)) > 0).alias("own"))


@query("expand_merged", "SELECT p_partkey AS row_id, k AS ord, CASE k WHEN 0 THEN '1|' || p_name ELSE '2|' || p_brand END || '|' || p_type AS line FROM part, (SELECT unnest([0, 1]) AS k)")
def expand_merged(spark, d):
    parts = table(spark, d, "part")
    return B.expand_merged(parts.select(F.col("p_partkey").alias("row_id"), F.concat(F.lit("|1<br>2|"), "p_name", F.lit("<br>"), "p_brand", F.lit("|"), "p_type", F.lit("|")).alias("quote")))
