"""Catalog, maintenance and export queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidentia.functions import cleaning as T
from evidentia.operators import catalog as C
from evidentia.plans.base import query
from evidentia.sources import versions as V
from evidentia.sources.sinks import work_dir
from evidentia.sources.tables import ORGANISATION_SQL, PAPERS_SQL, organisation, papers, table

BOTH_SQL = f"WITH {PAPERS_SQL}, {ORGANISATION_SQL}"
LOW = "('metadata_only', 'missing_fulltext', 'parse_failed', 'failed')"


@query("library_visible", f"{BOTH_SQL} SELECT p.id, p.status FROM papers p LEFT JOIN organisation o ON o.paper_id = p.id WHERE coalesce(status, '') <> 'off_topic' AND (o.canonical_id IS NULL OR o.canonical_id = p.id)")
def library_visible(spark, d):
    return C.visible(papers(spark, d), organisation(spark, d)).select("id", "status")


@query(
    "catalog_search",
    f"{BOTH_SQL}, hit AS (SELECT id FROM papers WHERE text ILIKE '%anhe%' OR venue ILIKE '%src1%') SELECT p.id FROM papers p JOIN organisation o ON o.paper_id = p.id WHERE o.canonical_id = p.id AND coalesce(status, '') <> 'off_topic' AND EXISTS (SELECT 1 FROM organisation a JOIN hit ON hit.id = a.paper_id WHERE a.canonical_id = p.id)",
)
def catalog_search(spark, d):
    hits = papers(spark, d).where(F.col("text").ilike("%anhe%") | F.col("venue").ilike("%src1%")).select("id")
    roots = organisation(spark, d).join(hits, F.col("paper_id") == F.col("id"), "left_semi").select(F.col("canonical_id").alias("id"))
    return C.visible(papers(spark, d), organisation(spark, d)).join(roots, "id", "left_semi").select("id")


RULES = (
    C.FacetRule("style", "symbols", r"&&&|\$\$\$", exclude_title=r"^\$"),
    C.FacetRule("style", "table", r" \| ", exclude="&&&"),
    C.FacetRule("style", "plain", r"the|der|le|el", only_if_empty=True),
    C.FacetRule("licence", "open", r"licensed under", exclude="nc 4"),
    C.FacetRule("licence", "restricted", r"cc by-nc", require_title=r"^this"),
    C.FacetRule("licence", "open", r"src1"),
)
FACETS_SQL = r"""facets AS (SELECT id, CASE WHEN len(s2) = 0 AND regexp_matches(x, 'the|der|le|el') THEN ['plain'] ELSE s2 END AS style, l2 AS licence FROM
(SELECT *, list_filter([CASE WHEN regexp_matches(x, '&&&|\$\$\$') AND NOT regexp_matches(t, '^\$') THEN 'symbols' END, CASE WHEN regexp_matches(x, ' \| ') AND NOT regexp_matches(x, '&&&') THEN 'table' END], lambda v: v IS NOT NULL) AS s2,
list_filter([CASE WHEN regexp_matches(x, 'licensed under') AND NOT regexp_matches(x, 'nc 4') THEN 'open' END, CASE WHEN regexp_matches(x, 'cc by-nc') AND regexp_matches(t, '^this') THEN 'restricted' END, CASE WHEN regexp_matches(x, 'src1') AND NOT (regexp_matches(x, 'licensed under') AND NOT regexp_matches(x, 'nc 4')) THEN 'open' END], lambda v: v IS NOT NULL) AS l2
FROM (SELECT doc_id AS id, lower(text) AS t, concat(lower(text), ' ', lower(source)) AS x FROM documents)))"""


def facets(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), *[c.alias(n) for n, c in C.rule_facets(F.col("text"), F.array("source"), RULES).items()])


@query("facet_rules", f"WITH {FACETS_SQL} SELECT id, array_to_string(style, ',') AS style, array_to_string(licence, ',') AS licence FROM facets")
def facet_rules(spark, d):
    return facets(spark, d).select("id", F.array_join("style", ",").alias("style"), F.array_join("licence", ",").alias("licence"))


@query("facet_filter", f"WITH {FACETS_SQL} SELECT id FROM facets WHERE list_contains(style, 'table') AND len(licence) = 0")
def facet_filter(spark, d):
    return facets(spark, d).where(F.array_contains("style", "table") & (F.size("licence") == 0)).select("id")


@query("facet_counts", f"WITH {FACETS_SQL}, v AS (SELECT unnest(['symbols', 'table', 'plain', 'poetry', 'unspecified']) AS value), e AS (SELECT unnest(CASE WHEN len(style) > 0 THEN style ELSE ['unspecified'] END) AS value FROM facets) SELECT v.value, count(e.value) AS n FROM v LEFT JOIN e ON e.value = v.value GROUP BY v.value")
def facet_counts(spark, d):
    return C.facet_counts(facets(spark, d), "style", ("symbols", "table", "plain", "poetry"))


@query("facet_source", f"WITH {FACETS_SQL}, st AS (SELECT doc_id, CASE WHEN quality = 0 THEN ['noisy'] END AS stored FROM labels) SELECT f.id, array_to_string(coalesce(stored, style), ',') AS style, CASE WHEN stored IS NOT NULL THEN 'stored' ELSE 'rules' END AS source FROM facets f LEFT JOIN st ON st.doc_id = f.id")
def facet_source(spark, d):
    stored = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, F.array(F.lit("noisy"))).alias("stored"))
    joined = facets(spark, d).join(stored, "id", "left")
    return joined.select("id", F.array_join(F.coalesce("stored", "style"), ",").alias("style"), F.when(F.col("stored").isNotNull(), "stored").otherwise("rules").alias("source"))


@query("facet_validate", "SELECT event_id, array_to_string(list_filter(list_distinct_ordered, lambda x: x IN ('click', 'view', 'purchase')), ',') AS kept, len(list_filter(list_distinct_ordered, lambda x: x NOT IN ('click', 'view', 'purchase'))) = 0 AS valid FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN [event_type] WHEN event_type = 'click' THEN ['click'] ELSE [event_type, 'click'] END AS list_distinct_ordered FROM events)")
def facet_validate(spark, d):
    given = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.array("event_type")).otherwise(F.array("event_type", F.lit("click"), F.lit("click"))).alias("v"))
    known = F.array(F.lit("click"), F.lit("view"), F.lit("purchase"))
    distinct = F.array_distinct("v")
    return given.select("event_id", F.array_join(F.array_intersect(distinct, known), ",").alias("kept"), (F.size(F.array_except(distinct, known)) == 0).alias("valid"))


@query("catalog_page", f"{BOTH_SQL}, {FACETS_SQL} SELECT p.id, p.year, p.publication_date FROM papers p JOIN facets f ON f.id = p.id WHERE len(f.style) = 0 ORDER BY p.year DESC, p.publication_date DESC NULLS LAST, p.id LIMIT 20 OFFSET 40")
def catalog_page(spark, d):
    rows = papers(spark, d).join(facets(spark, d).where(F.size("style") == 0), "id", "left_semi").select("id", "year", "publication_date")
    return C.page(rows, [F.desc("year"), F.desc_nulls_last("publication_date"), F.asc("id")], 2, 20)


@query("status_counts", f"WITH {PAPERS_SQL} SELECT count(*) AS n, count_if(status = 'parsed')::BIGINT AS parsed, count_if(coalesce(status, '') <> 'off_topic')::BIGINT AS visible, count_if(fulltext_path IS NOT NULL)::BIGINT AS with_file, count_if(status IS NULL)::BIGINT AS unknown FROM papers")
def status_counts(spark, d):
    return papers(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "parsed").alias("parsed"), F.count_if(F.coalesce("status", F.lit("")) != "off_topic").alias("visible"), F.count_if(F.col("fulltext_path").isNotNull()).alias("with_file"), F.count_if(F.col("status").isNull()).alias("unknown"))


@query("duplicate_count", f"WITH {ORGANISATION_SQL} SELECT canonical_id, count(*) - 1 AS n FROM organisation GROUP BY 1 HAVING count(*) > 1")
def duplicate_count(spark, d):
    return organisation(spark, d).groupBy("canonical_id").agg((F.count("*") - 1).alias("n")).where("n > 0")


@query("duplicate_members", f"{BOTH_SQL} SELECT o.canonical_id, p.id, p.venue FROM organisation o JOIN papers p ON p.id = o.paper_id WHERE o.paper_id <> o.canonical_id")
def duplicate_members(spark, d):
    folded = organisation(spark, d).where("paper_id <> canonical_id").select("canonical_id", F.col("paper_id").alias("id"))
    return folded.join(papers(spark, d), "id").select("canonical_id", "id", "venue")


@query("canonicalize", f"WITH {ORGANISATION_SQL} SELECT l.doc_id, coalesce(o.canonical_id, l.doc_id) AS canonical_id FROM labels l LEFT JOIN (SELECT * FROM organisation WHERE paper_id % 2 = 0) o ON o.paper_id = l.doc_id")
def canonicalize(spark, d):
    known = organisation(spark, d).where("paper_id % 2 = 0").select(F.col("paper_id").alias("doc_id"), "canonical_id")
    return table(spark, d, "labels").join(known, "doc_id", "left").select("doc_id", F.coalesce("canonical_id", "doc_id").alias("canonical_id"))


@query("category_counts", f"{BOTH_SQL} SELECT category, count(*) AS n FROM (SELECT o.category FROM papers p JOIN organisation o ON o.paper_id = p.id WHERE o.canonical_id = o.paper_id AND coalesce(status, '') <> 'off_topic' UNION ALL SELECT 'prior' FROM conversations WHERE turn = 0) GROUP BY category")
def category_counts(spark, d):
    shown = C.visible(papers(spark, d), organisation(spark, d)).select("category")
    prior = table(spark, d, "conversations").where("turn = 0").select(F.lit("prior").alias("category"))
    return shown.unionByName(prior).groupBy("category").agg(F.count("*").alias("n"))


@query("missing_summary", f"{BOTH_SQL} SELECT count(*) AS raw, count_if(o.canonical_id <> p.id)::BIGINT AS folded, count_if(o.canonical_id = p.id)::BIGINT AS missing FROM papers p JOIN organisation o ON o.paper_id = p.id WHERE p.fulltext_path IS NULL AND coalesce(p.status, '') <> 'off_topic'")
def missing_summary(spark, d):
    rows = papers(spark, d).where("fulltext_path IS NULL AND coalesce(status, '') <> 'off_topic'").join(organisation(spark, d).select(F.col("paper_id").alias("id"), "canonical_id"), "id")
    return rows.agg(F.count("*").alias("raw"), F.count_if(F.col("canonical_id") != F.col("id")).alias("folded"), F.count_if(F.col("canonical_id") == F.col("id")).alias("missing"))


@query("missing_page", f"WITH {PAPERS_SQL} SELECT id, status FROM papers WHERE fulltext_path IS NULL ORDER BY CASE WHEN status = 'parsed' THEN 0 WHEN status = 'downloaded' THEN 1 ELSE 2 END, id LIMIT 25 OFFSET 25")
def missing_page(spark, d):
    rows = papers(spark, d).where("fulltext_path IS NULL").select("id", "status")
    return C.page(rows, [F.when(F.col("status") == "parsed", 0).when(F.col("status") == "downloaded", 1).otherwise(2), F.asc("id")], 1, 25)


UPDATES = "doc_id AS id, concat('new ', lang) AS title, CASE doc_id % 4 WHEN 0 THEN 'parse_failed' WHEN 1 THEN 'downloaded' WHEN 2 THEN 'parsed' END AS status, CASE WHEN doc_id % 8 = 0 THEN 'new/path' END AS fulltext_path, CAST(NULL AS STRING) AS parsed_path"
STATUS_SQL = f"CASE WHEN o.id IS NULL THEN coalesce(n.status, 'metadata_only') WHEN o.parsed_path IS NOT NULL AND coalesce(n.status, 'metadata_only') IN {LOW} THEN 'parsed' WHEN o.fulltext_path IS NOT NULL AND coalesce(o.status, 'metadata_only') IN {LOW} AND coalesce(n.status, 'metadata_only') IN {LOW} THEN 'downloaded' WHEN coalesce(o.status, 'metadata_only') IN ('off_topic', 'parsed', 'downloaded') AND coalesce(n.status, 'metadata_only') IN {LOW} THEN o.status WHEN o.status = 'parsed' AND n.status = 'downloaded' THEN 'parsed' ELSE coalesce(n.status, 'metadata_only') END"
UPSERT_SQL = f"WITH {PAPERS_SQL}, old AS (SELECT id, venue AS title, status, fulltext_path, parsed_path FROM papers WHERE id % 3 <> 1), new AS (SELECT {UPDATES} FROM documents WHERE doc_id % 2 = 0)"


def _old_new(spark, d):
    old = papers(spark, d).where("id % 3 <> 1").select("id", F.col("venue").alias("title"), "status", "fulltext_path", "parsed_path")
    return old, table(spark, d, "documents").where("doc_id % 2 = 0").selectExpr("doc_id AS id", "concat('new ', lang) AS title", "CASE doc_id % 4 WHEN 0 THEN 'parse_failed' WHEN 1 THEN 'downloaded' WHEN 2 THEN 'parsed' END AS status", "CASE WHEN doc_id % 8 = 0 THEN 'new/path' END AS fulltext_path", "CAST(NULL AS STRING) AS parsed_path")


UPSERTED_SQL = f"{UPSERT_SQL} SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE o.title END AS title, CASE WHEN n.id IS NULL THEN o.status ELSE {STATUS_SQL} END AS status, coalesce(n.fulltext_path, o.fulltext_path) AS fulltext_path, coalesce(n.parsed_path, o.parsed_path) AS parsed_path FROM old o FULL JOIN new n ON o.id = n.id"


@query("upsert_merge", UPSERTED_SQL)
def upsert_merge(spark, d):
    return C.upsert(*_old_new(spark, d))


@query("versioned_upsert", UPSERTED_SQL)
def versioned_upsert(spark, d):
    """The same into a table of versions: a commit for the old rows, one that rewrites the buckets of the new ones."""
    folder = f"{work_dir(spark)}/papers-{uuid.uuid4().hex}"
    old, new = _old_new(spark, d)
    V.upsert(old, folder, ["id"], token=1)
    V.upsert(new, folder, ["id"], C.upsert, token=2)
    return V.rows_of(spark, folder)


DATES_SQL = f"WITH {PAPERS_SQL}, o AS (SELECT id, publication_date AS d, CASE WHEN id % 2 = 0 THEN 'arxiv_page' WHEN id % 7 <> 0 THEN 'crossref' END AS s FROM papers), n AS (SELECT id, CASE id % 5 WHEN 0 THEN '2024' WHEN 1 THEN '2024-02' WHEN 2 THEN '2024-02-03' WHEN 3 THEN '' END AS d, CASE WHEN id % 3 = 0 THEN 'arxiv' WHEN id % 11 <> 0 THEN 'openalex' END AS s FROM papers)"


@query(
    "date_precedence",
    f"{DATES_SQL} SELECT id, CASE WHEN keep THEN od ELSE d END AS publication_date, CASE WHEN keep THEN os ELSE s END AS date_source FROM (SELECT *, coalesce(os LIKE 'arxiv%' AND (s NOT LIKE 'arxiv%' OR (length(od) = 10 AND length(coalesce(d, '')) < 10)), false) AS keep FROM (SELECT o.id, o.d AS od, o.s AS os, coalesce(nullif(n.d, ''), o.d) AS d, coalesce(n.s, o.s) AS s FROM o JOIN n ON n.id = o.id))",
)
def date_precedence(spark, d):
    """An update's date and source, unless what is there is first-hand and the update isn't, or is coarser."""
    known, k = papers(spark, d), F.col("id")
    old = known.select("id", "publication_date", F.when(k % 2 == 0, "arxiv_page").when(k % 7 != 0, "crossref").alias("date_source"))
    date = F.when(k % 5 == 0, "2024").when(k % 5 == 1, "2024-02").when(k % 5 == 2, "2024-02-03").when(k % 5 == 3, "")
    return C.upsert_dates(old, known.select("id", date.alias("publication_date"), F.when(k % 3 == 0, "arxiv").when(k % 11 != 0, "openalex").alias("date_source")))


@query("merged_status", f"{UPSERT_SQL} SELECT n.id, {STATUS_SQL} AS status FROM new n LEFT JOIN old o ON o.id = n.id")
def merged(spark, d):
    old, new = _old_new(spark, d)
    o = old.alias("o")
    status = T.merged_status(F.col("o.status"), F.col("n.status"), F.col("o.parsed_path"), F.col("o.fulltext_path"), F.col("o.id").isNotNull())
    return new.alias("n").join(o, F.col("n.id") == F.col("o.id"), "left").select(F.col("n.id").alias("id"), status.alias("status"))


@query("evidence_explode", "SELECT doc_id AS id, concat(doc_id, '_ev_', i) AS evidence_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)")
def evidence_explode(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("id", F.concat_ws("_ev_", "id", "i").alias("evidence_id"), "line")


@query("evidence_for_papers", "WITH want AS (SELECT unnest([40, 7, 300, 12]) AS id, generate_subscripts([40, 7, 300, 12], 1) AS ord) SELECT w.ord::BIGINT AS ord, l.doc_id AS id, i::BIGINT AS i, line FROM want w JOIN (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) l ON l.doc_id = w.id")
def evidence_for_papers(spark, d):
    want = spark.createDataFrame([(40, 1), (7, 2), (300, 3), (12, 4)], "id bigint, ord bigint")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").join(F.broadcast(want), "id")
    return docs.select("ord", "id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("ord", "id", F.col("i").cast("bigint").alias("i"), "line")


@query("keep_latest_by_key", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def keep_latest_by_key(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return C.keep_latest(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("index_delta", "WITH s AS (SELECT doc_id AS id, sha256(text) AS sha FROM documents), i AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'stale' ELSE sha END AS sha FROM s WHERE id % 7 <> 0) SELECT s.id, s.sha FROM s LEFT JOIN i ON i.id = s.id AND i.sha = s.sha WHERE i.id IS NULL")
def index_delta(spark, d):
    source = _source(spark, d).drop("text")
    return C.index_delta(source, _index(source))


def _source(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"), "text")


def _index(source):
    return source.where("id % 7 <> 0").select("id", F.when(F.col("id") % 5 == 0, "stale").otherwise(F.col("sha")).alias("sha"))


@query("index_prune", f"WITH {PAPERS_SQL} SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 0 AND doc_id IN (SELECT id FROM papers WHERE coalesce(status, '') <> 'off_topic')")
def index_prune(spark, d):
    eligible = papers(spark, d).where("coalesce(status, '') <> 'off_topic'").select("id")
    return _index(_source(spark, d)).select("id").join(eligible, "id", "left_semi")


@query("index_outcomes", "WITH s AS (SELECT doc_id AS id, sha256(text) AS sha, text FROM documents), i AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'stale' ELSE sha END AS sha FROM s WHERE id % 7 <> 0), k AS (SELECT * FROM s WHERE id % 11 <> 0) SELECT CASE WHEN k.id IS NULL THEN 'pruned' WHEN k.sha = i.sha THEN 'reused' WHEN length(k.text) = 0 THEN 'empty' ELSE 'indexed' END AS outcome, count(*) AS n FROM k FULL JOIN i ON i.id = k.id GROUP BY 1")
def index_outcomes(spark, d):
    source = _source(spark, d)
    return C.index_outcomes(source.where("id % 11 <> 0"), _index(source.drop("text")))


@query("index_status", "SELECT count_if(doc_id % 5 <> 0)::BIGINT AS current_documents, count(*) AS documents, sum(len(string_split(text, chr(10))))::BIGINT AS chunks FROM documents WHERE doc_id % 7 <> 0")
def index_status(spark, d):
    rows = table(spark, d, "documents").where("doc_id % 7 <> 0")
    return rows.agg(F.count_if(F.col("doc_id") % 5 != 0).alias("current_documents"), F.count("*").alias("documents"), F.sum(F.size(F.split("text", "\n"))).cast("bigint").alias("chunks"))


@query("status_repair", f"WITH {PAPERS_SQL} SELECT id, CASE WHEN parsed_path IS NOT NULL AND coalesce(status, '') <> 'off_topic' THEN 'parsed' WHEN fulltext_path IS NOT NULL AND (status IS NULL OR status IN {LOW}) THEN 'downloaded' ELSE status END AS status FROM papers")
def status_repair(spark, d):
    fixed = F.when(F.col("parsed_path").isNotNull() & (F.coalesce("status", F.lit("")) != "off_topic"), "parsed").when(F.col("fulltext_path").isNotNull() & (F.col("status").isNull() | F.col("status").isin(*T.LOW_CONFIDENCE)), "downloaded").otherwise(F.col("status"))
    return papers(spark, d).select("id", fixed.alias("status"))


@query("bulk_status", f"WITH {PAPERS_SQL} SELECT id, CASE WHEN id IN (SELECT DISTINCT conv_id * 3 FROM conversations) THEN 'off_topic' ELSE status END AS status FROM papers")
def bulk_status(spark, d):
    ids = table(spark, d, "conversations").select((F.col("conv_id") * 3).alias("id")).distinct().withColumn("named", F.lit(True))
    return papers(spark, d).join(ids, "id", "left").select("id", F.when(F.col("named"), "off_topic").otherwise(F.col("status")).alias("status"))


@query("missing_flag", f"WITH {PAPERS_SQL} SELECT id, coalesce(CASE WHEN id % 9 = 0 THEN 'kept' END, 'no full text') AS reason FROM papers WHERE fulltext_path IS NULL AND parsed_path IS NULL")
def missing_flag(spark, d):
    return papers(spark, d).where("fulltext_path IS NULL AND parsed_path IS NULL").select("id", F.coalesce(F.when(F.col("id") % 9 == 0, "kept"), F.lit("no full text")).alias("reason"))


@query("parse_state", f"WITH {PAPERS_SQL} SELECT id, coalesce(CASE WHEN id % 4 = 0 THEN 'new.md' END, parsed_path) AS parsed_path, CASE WHEN status IN ('parsed', 'off_topic') THEN status WHEN id % 4 = 0 THEN 'parsed' ELSE 'parse_failed' END AS status FROM papers")
def parse_state(spark, d):
    new = F.when(F.col("id") % 4 == 0, "new.md")
    return papers(spark, d).select("id", F.coalesce(new, "parsed_path").alias("parsed_path"), F.when(F.col("status").isin("parsed", "off_topic"), F.col("status")).when(F.col("id") % 4 == 0, "parsed").otherwise("parse_failed").alias("status"))


@query("cascade_delete", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 0 AND length(text) % 3 = 0)")
def cascade_delete(spark, d):
    turns = table(spark, d, "conversations")
    gone = turns.where("turn = 0 AND length(text) % 3 = 0").select("conv_id")
    return turns.join(gone, "conv_id", "left_anti").select("conv_id", "turn")


@query("organize_undo", "WITH cur AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'touched' ELSE 'new' END AS category FROM documents), log AS (SELECT doc_id AS id, lang AS before, 'new' AS after FROM documents WHERE doc_id % 2 = 0) SELECT c.id, CASE WHEN l.after = c.category THEN l.before ELSE c.category END AS category, l.after = c.category AS undone FROM cur c JOIN log l ON l.id = c.id")
def organize_undo(spark, d):
    docs = table(spark, d, "documents")
    current = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "touched").otherwise("new").alias("category"))
    log = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("before"), F.lit("new").alias("after"))
    same = F.col("after") == F.col("category")
    return current.join(log, "id").select("id", F.when(same, F.col("before")).otherwise(F.col("category")).alias("category"), same.alias("undone"))


@query("table_digest", "SELECT count(*) AS n, (sum(('0x' || substr(sha256(concat_ws(chr(31), o_orderkey, o_orderstatus, o_orderpriority)), 1, 12))::BIGINT::HUGEINT) % (1::HUGEINT << 60))::BIGINT AS digest FROM orders")
def table_digest(spark, d):
    return C.table_digest(table(spark, d, "orders"), "o_orderkey", "o_orderstatus", "o_orderpriority")


@query("group_fingerprint", "SELECT source, count(*) AS n, (sum(('0x' || substr(sha256(concat_ws(chr(31), doc_id, sha256(text))), 1, 12))::BIGINT::HUGEINT) % (1::HUGEINT << 60))::BIGINT AS digest FROM documents GROUP BY source")
def group_fingerprint(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.sha2("text", 256).alias("sha"))
    return C.group_digest(rows, "source", "doc_id", "sha")


@query("cache_valid", "SELECT d.doc_id AS id, (l.quality = 1 AND contains(d.text, 'the')) IS TRUE AS valid FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND sha256(d.text) < 'c'")
def cache_valid(spark, d):
    docs = table(spark, d, "documents")
    entry = table(spark, d, "labels").select("doc_id", "quality")
    current = docs.join(entry, "doc_id", "left").select(F.col("doc_id").alias("id"), ((F.sha2("text", 256) < "c") & (F.col("quality") == 1) & F.contains("text", F.lit("the"))).alias("v"))
    return current.select("id", F.coalesce("v", F.lit(False)).alias("valid"))


@query("paper_view", f"{BOTH_SQL} SELECT p.id, CASE WHEN parsed_path IS NOT NULL THEN 'parsed' WHEN fulltext_path IS NOT NULL THEN 'downloaded' ELSE coalesce(status, 'metadata_only') END AS status, coalesce(CASE WHEN o.category <> 'en' THEN o.category END, 'unclassified') AS category, coalesce(o.canonical_id, p.id) AS canonical_id FROM papers p LEFT JOIN organisation o ON o.paper_id = p.id")
def paper_view(spark, d):
    org = organisation(spark, d).select(F.col("paper_id").alias("id"), "canonical_id", F.col("category").alias("own"))
    status = F.when(F.col("parsed_path").isNotNull(), "parsed").when(F.col("fulltext_path").isNotNull(), "downloaded").otherwise(F.coalesce("status", F.lit("metadata_only")))
    return papers(spark, d).join(org, "id", "left").select("id", status.alias("status"), F.coalesce(F.when(F.col("own") != "en", F.col("own")), F.lit("unclassified")).alias("category"), F.coalesce("canonical_id", "id").alias("canonical_id"))


@query("text_source_pick", f"WITH {PAPERS_SQL} SELECT id, coalesce(parsed_path, fulltext_path, CASE WHEN url LIKE '%.pdf' THEN url END) AS origin, CASE WHEN parsed_path IS NOT NULL THEN 'parsed' WHEN fulltext_path IS NOT NULL THEN 'fulltext' WHEN url LIKE '%.pdf' THEN 'pdf' END AS kind FROM papers")
def text_source_pick(spark, d):
    pdf = F.when(F.col("url").like("%.pdf"), F.col("url"))
    kind = F.when(F.col("parsed_path").isNotNull(), "parsed").when(F.col("fulltext_path").isNotNull(), "fulltext").when(pdf.isNotNull(), "pdf")
    return papers(spark, d).select("id", F.coalesce("parsed_path", "fulltext_path", pdf).alias("origin"), kind.alias("kind"))


@query("enrich_fill", f"WITH {PAPERS_SQL}, a AS (SELECT doc_id AS id, concat('ax ', lang) AS venue FROM documents WHERE doc_id % 5 = 0), c AS (SELECT doc_id AS id, 'cr' AS venue, 1999 AS year FROM documents WHERE doc_id % 2 = 0) SELECT p.id, coalesce(a.venue, CASE WHEN p.id % 3 <> 0 THEN p.venue END, c.venue) AS venue, coalesce(CASE WHEN p.id % 10 <> 4 THEN p.year END, c.year)::INT AS year FROM papers p LEFT JOIN a ON a.id = p.id LEFT JOIN c ON c.id = p.id")
def enrich_fill(spark, d):
    docs = table(spark, d, "documents")
    a = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("ax "), "lang").alias("a_venue"))
    c = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.lit("cr").alias("c_venue"), F.lit(1999).alias("c_year"))
    own = papers(spark, d).join(a, "id", "left").join(c, "id", "left")
    return own.select("id", F.coalesce("a_venue", F.when(F.col("id") % 3 != 0, F.col("venue")), "c_venue").alias("venue"), F.coalesce(F.when(F.col("id") % 10 != 4, F.col("year")), "c_year").alias("year"))


@query("date_parts_format", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS published FROM orders")
def date_parts_format(spark, d):
    parts = F.array(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    given = table(spark, d, "orders").select("o_orderkey", F.slice(parts, 1, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("p"))
    return given.select("o_orderkey", F.array_join(F.transform("p", lambda x: F.lpad(x.cast("string"), F.when(x > 31, 4).otherwise(2), F.lit("0"))), "-").alias("published"))


@query("excerpt_prefix", "SELECT doc_id AS id, substr(text, 1, 200) AS prefix, length(text) > 200 AS cut FROM documents")
def excerpt_prefix(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 200).alias("prefix"), (F.length("text") > 200).alias("cut"))


@query("label_if_hash_matches", "SELECT d.doc_id AS id, l.quality AS label FROM documents d LEFT JOIN (SELECT l.doc_id, quality, CASE WHEN l.doc_id % 2 = 0 THEN sha256(text) ELSE 'old' END AS sha FROM labels l JOIN documents x ON x.doc_id = l.doc_id) l ON l.doc_id = d.doc_id AND l.sha = sha256(d.text)")
def label_if_hash_matches(spark, d):
    files = _source(spark, d).drop("text")
    noted = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality").join(files, "id").select("id", "quality", F.when(F.col("id") % 2 == 0, F.col("sha")).otherwise("old").alias("sha"))
    return files.join(noted, ["id", "sha"], "left").select("id", F.col("quality").alias("label"))


@query("path_relocate", f"WITH {PAPERS_SQL} SELECT id, regexp_replace(fulltext_path, '^fulltext/', '/new/root/') AS fulltext_path, regexp_replace(url, '^http://host\\.example/', 'https://other.example/') AS url FROM papers")
def path_relocate(spark, d):
    return papers(spark, d).select("id", F.regexp_replace("fulltext_path", "^fulltext/", "/new/root/").alias("fulltext_path"), F.regexp_replace("url", r"^http://host\.example/", "https://other.example/").alias("url"))


@query("scrub_secrets", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, 'sk-[A-Za-z0-9_-]{8,}', '[secret]', 'g'), '(?i)(api[_-]?key|token|password)\s*[:=]\s*[^\s,;]+', '\1=[secret]', 'g'), '(?i)bearer\s+[A-Za-z0-9._-]{8,}', 'Bearer [secret]', 'g'), '(?:/home|/Users|/root)/[^\s''" + '"' + r"]+', '[path]', 'g') AS clean FROM (SELECT page_id, concat(url, ' token=abc', page_id, ' sk-12345678', page_id, ' /home/u/', page_id, ' Bearer abcdefgh.', page_id) AS x FROM pages)")
def scrub_secrets(spark, d):
    x = F.concat(F.col("url"), F.lit(" token=abc"), "page_id", F.lit(" sk-12345678"), "page_id", F.lit(" /home/u/"), "page_id", F.lit(" Bearer abcdefgh."), "page_id")
    return table(spark, d, "pages").select("page_id", T.scrub(x).alias("clean"))


@query("note_slug", "SELECT page_id, concat(CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END, '/', substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40)) AS path FROM pages")
def note_slug(spark, d):
    slug = F.substring(F.trim(F.regexp_replace(F.lower("url"), "[^a-z0-9]+", "-"), F.lit("-")), 1, 40)
    return table(spark, d, "pages").select("page_id", F.concat_ws("/", F.when(F.col("page_id") % 2 == 0, "a").otherwise("b"), slug).alias("path"))
