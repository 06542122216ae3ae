"""Entity resolution and set-like queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.operators import catalog as C
from evidentia.operators import identity as I
from evidentia.operators import review as R
from evidentia.operators.catalog import first_by_ordinal
from evidentia.operators.graph import hot_join
from evidentia.plans.base import query
from evidentia.sources.sinks import materialize
from evidentia.sources.tables import PAPERS_SQL, papers, table

IDS_SQL = PAPERS_SQL + r""", ids AS (SELECT id, CASE WHEN regexp_matches(d, '^10\.\d+/.+$') THEN d END AS doi, CASE WHEN regexp_matches(a, '^(?:\d{4}\.\d{4,5}|[a-z][a-z.\-]*/\d{7})$') THEN a END AS arxiv, CASE WHEN s NOT IN ('', 'unknown') THEN s END AS semantic, pdf,
CASE WHEN length(t) >= 16 AND p <> '' AND year IS NOT NULL THEN sha256(concat(t, chr(31), year::VARCHAR, chr(31), p)) END AS work FROM
(SELECT id, year, rtrim(lower(regexp_replace(trim(doi), '(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', '')), ' .') AS d,
lower(trim(semantic_id)) AS s, rtrim(trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '\s+', ' ', 'g')), '.') AS t,
coalesce(array_to_string(list_sort(list_distinct(list_transform(string_split(authors, ';'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')))), chr(30)), '') AS p,
lower(trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN coalesce(arxiv_id, '') <> '' THEN arxiv_id ELSE regexp_extract(coalesce(url, ''), '(?i)arxiv\.org/(?:abs|pdf)/([^?#]+)', 1) END, '(?i)^(?:arxiv:|https?://arxiv\.org/(?:abs|pdf)/)', ''), '(?i)\.pdf$', ''), '(?i)v\d+$', ''))) AS a, sha256(text) AS pdf FROM papers))"""


def ids(spark, d):
    # the digest and the first line are taken before the join with labels, so that no text is shuffled
    docs = table(spark, d, "documents").withColumns({"pdf": F.sha2("text", 256), "text": F.split_part("text", F.lit("\n"), F.lit(1))})
    known = I.with_identifiers(papers(spark, d, docs, "pdf"))
    work = I.work_key(F.col("title"), F.col("year"), F.split("authors", ";"))
    return known.select("id", "doi", "arxiv", "semantic", "pdf", work.alias("work"))


@query("normalize_identifiers", f"WITH {IDS_SQL} SELECT id, doi, arxiv, semantic, work FROM ids")
def normalize_identifiers(spark, d):
    return ids(spark, d).select("id", "doi", "arxiv", "semantic", "work")


KEYS_SQL = f"WITH {IDS_SQL}, k AS (" + " UNION ".join(f"SELECT id, '{n}:' || {n} AS key FROM ids WHERE {n} IS NOT NULL" for n in I.IDENTITIES) + ")"


@query("dup_candidates", f'{KEYS_SQL} SELECT "left", id AS "right", key FROM (SELECT id, key, min(id) OVER (PARTITION BY key) AS "left" FROM k) WHERE id <> "left"')
def dup_candidates(spark, d):
    return I.candidate_links(ids(spark, d))


@query("dup_exact", f"WITH {IDS_SQL} SELECT pdf, min(id) AS first, count(*) AS n FROM ids GROUP BY pdf HAVING count(*) > 1")
def dup_exact(spark, d):
    return ids(spark, d).groupBy("pdf").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")


@query("dedup_groups")
def dedup_groups(spark, d):
    return I.duplicate_groups(ids(spark, d))


@query("canonical_pick", f"WITH {PAPERS_SQL} SELECT pdf, id FROM (SELECT sha256(text) AS pdf, id, row_number() OVER (PARTITION BY sha256(text) ORDER BY parsed_path IS NOT NULL DESC, coalesce(status = 'parsed', false) DESC, fulltext_path IS NOT NULL DESC, n_chars DESC, id DESC) AS r FROM papers) WHERE r = 1")
def canonical_pick(spark, d):
    """The best of each group by one maximum over a struct."""
    order = F.struct(F.col("parsed_path").isNotNull(), F.coalesce(F.col("status") == "parsed", F.lit(False)), F.col("fulltext_path").isNotNull(), "n_chars", "id")
    return papers(spark, d).groupBy(F.sha2("text", 256).alias("pdf")).agg(F.max_by("id", order).alias("id"))


@query("suspicious_titles", "SELECT lower(split_part(text, chr(10), 1)) AS title, count(DISTINCT sha256(text)) AS roots FROM documents WHERE length(split_part(text, chr(10), 1)) >= 16 GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1")
def suspicious_titles(spark, d):
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    rows = table(spark, d, "documents").where(F.length(title) >= 16).select(F.lower(title).alias("title"), F.sha2("text", 256).alias("root"))
    return rows.groupBy("title").agg(F.count_distinct("root").alias("roots")).where("roots > 1")


@query("merge_by_key", f"WITH {PAPERS_SQL} SELECT sha256(text) AS key, arg_min(venue, id) FILTER (venue IS NOT NULL) AS venue, arg_min(publication_date, id) FILTER (publication_date IS NOT NULL) AS publication_date, count(*) AS n FROM papers GROUP BY 1")
def merge_by_key(spark, d):
    rows = papers(spark, d).withColumn("key", F.sha2("text", 256))
    return I.merge_by_key(rows, "key", "id", ["venue", "publication_date"])


@query("merge_records")
def merge_records(spark, d):
    known = I.with_identifiers(papers(spark, d))
    rows = known.select(F.col("id").alias("ord"), F.coalesce("doi", "arxiv", "semantic", F.concat(F.lit("id"), "id")).alias("key"), F.sha2("text", 256).alias("title"), "publication_date", F.when(F.col("publication_date").isNotNull(), F.col("category")).alias("date_source"), "venue", "url", "fulltext_path")
    return I.merge_records(rows, ["venue", "url", "fulltext_path"])


@query("author_set", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x <> ''))), ',') AS names FROM part")
def author_set(spark, d):
    names = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("p_name"), " "), lambda x: x != "")))
    return table(spark, d, "part").select("p_partkey", F.array_join(names, ",").alias("names"))


def _group_digest_sql(name: str, text: str) -> str:
    return f"{name} AS (SELECT source || '/' || lang AS key, count(*) AS n, (sum(('0x' || substr(sha256(concat_ws(chr(31), doc_id, sha256({text}))), 1, 12))::BIGINT::HUGEINT) % (1::HUGEINT << 60))::BIGINT AS digest FROM documents GROUP BY 1)"


@query("incremental_pending", f"WITH {_group_digest_sql('g', 'text')}, {_group_digest_sql('l', chr(39).join(('CASE WHEN doc_id % 30 = 0 THEN text || ', ' old', ' ELSE text END')))} SELECT g.key, g.n, ceil(g.n / 12e0)::BIGINT AS calls FROM g LEFT JOIN l ON l.key = g.key AND l.digest = g.digest WHERE l.key IS NULL")
def incremental_pending(spark, d):
    """Groups whose digest is no longer the one that the last run stored; some texts were others then."""
    docs = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("key"), "doc_id", "text")
    digest = lambda text: C.group_digest(docs.withColumn("sha", F.sha2(text, 256)), "key", "doc_id", "sha")
    stored = materialize(digest(F.when(F.col("doc_id") % 30 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))), "last-run")
    pending = C.pending_groups(digest(F.col("text")), stored, "key")
    return pending.select("key", "n", F.ceil(F.col("n") / 12.0).alias("calls"))


@query("hydrate_or_join", f"WITH {IDS_SQL}, w AS (SELECT doc_id AS wid, concat('10.1234/ab.', doc_id % 400) AS doi, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS pid FROM documents), m AS (SELECT wid, id, 0 AS r FROM w JOIN ids ON ids.id = w.pid UNION ALL SELECT wid, id, 1 FROM w JOIN ids ON ids.doi = w.doi) SELECT wid, id FROM (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY r, id) AS k FROM m) WHERE k = 1")
def hydrate_or_join(spark, d):
    """A join on either of two keys as a union of equi-joins, the better key first; never a nested loop. Of the records of a key only
    the first can be taken, so only it is joined: a key that both sides have often makes no pairs."""
    wanted = table(spark, d, "documents").select(F.col("doc_id").alias("wid"), F.concat(F.lit("10.1234/ab."), F.col("doc_id") % 400).alias("doi"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("pid"))
    known = ids(spark, d).select("id", "doi")
    by_id = wanted.join(known.select(F.col("id").alias("pid")), "pid", "left_semi").select("wid", F.col("pid").alias("id"), F.lit(0).alias("r"))
    first = known.where("doi IS NOT NULL").groupBy("doi").agg(F.min("id").alias("id"))
    by_doi = hot_join(wanted, first, "doi").where("id IS NOT NULL").select("wid", "id", F.lit(1).alias("r"))
    return by_id.unionByName(by_doi).groupBy("wid").agg(F.min(F.struct("r", "id"))["id"].alias("id"))


@query("ordered_distinct", "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def ordered_distinct(spark, d):
    return first_by_ordinal(table(spark, d, "events"), "event_type", "event_id")


@query("union_sources", "SELECT 0 AS src, doc_id AS id FROM documents WHERE lang = 'de' UNION ALL SELECT 1, item_id FROM benchmark UNION ALL SELECT 2, page_id FROM pages")
def union_sources(spark, d):
    one = lambda k, name, col: table(spark, d, name).select(F.lit(k).alias("src"), F.col(col).alias("id"))
    german = table(spark, d, "documents").where("lang = 'de'").select(F.lit(0).alias("src"), F.col("doc_id").alias("id"))
    return german.unionByName(one(1, "benchmark", "item_id")).unionByName(one(2, "pages", "page_id"))


@query("id_set_ops", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM labels INTERSECT SELECT conv_id FROM conversations) UNION ALL SELECT 'labels_only', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT conv_id FROM conversations)")
def id_set_ops(spark, d):
    a, b = table(spark, d, "labels").select(F.col("doc_id").alias("id")), table(spark, d, "conversations").select(F.col("conv_id").alias("id"))
    both = a.intersect(b).agg(F.lit("both").alias("kind"), F.count("*").alias("n"))
    return both.unionByName(a.subtract(b).agg(F.lit("labels_only").alias("kind"), F.count("*").alias("n")))


@query("related_merge", "WITH h AS (SELECT doc_id AS id, 0 AS src, doc_id AS ord FROM documents UNION ALL SELECT item_id AS id, 1, item_id FROM benchmark) SELECT id, min(src * 1000000 + ord)::BIGINT AS ord FROM h GROUP BY id ORDER BY ord LIMIT 60")
def related_merge(spark, d):
    hits = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"))
    more = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") + 1_000_000).alias("ord"))
    return first_by_ordinal(hits.unionByName(more), "id", "ord").orderBy("ord").limit(60)


@query("fallback_union", "WITH p AS (SELECT doc_id AS id FROM documents WHERE lang = 'xx'), f AS (SELECT item_id AS id FROM benchmark) SELECT id FROM p UNION ALL SELECT id FROM f WHERE NOT EXISTS (SELECT 1 FROM p)")
def fallback_union(spark, d):
    primary = table(spark, d, "documents").where("lang = 'xx'").select(F.col("doc_id").alias("id"))
    found = primary.limit(1).agg(F.count("*").alias("found"))
    backup = table(spark, d, "benchmark").select(F.col("item_id").alias("id")).crossJoin(F.broadcast(found)).where("found = 0").select("id")
    return primary.unionByName(backup)


@query("even_sample", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) WHERE r IN (SELECT (i * n) // 80 FROM (SELECT unnest(range(80)) AS i), (SELECT count(*) AS n FROM documents))")
def even_sample(spark, d):
    """Evenly spaced rows by rank: ranks come from counts of id ranges, so no task orders the whole table."""
    docs = table(spark, d, "documents").select("doc_id")
    span = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("total")).first()
    width = max(1, -(-(((span["hi"] or 0) - (span["lo"] or 0)) + 1) // 256))
    ranged = docs.withColumn("p", F.floor((F.col("doc_id") - F.lit(span["lo"] or 0)) / width))
    counts = ranged.groupBy("p").agg(F.count("*").alias("n"))  # 256 rows at most
    before = counts.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    ranked = ranged.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("doc_id")) - 1).join(F.broadcast(before), "p")
    r, total = F.col("k") + F.col("before"), max(1, span["total"])
    i = F.ceil(r * 80 / total)  # r is one of floor(i * total / 80)
    return ranked.where((F.floor(i * total / 80) == r) & (i < 80)).select("doc_id")


@query("admit_topk", "SELECT doc_id FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30)")
def admit_topk(spark, d):
    """Admission that replaces the weakest: what stays in the end are the strongest."""
    return table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(30).select("doc_id")


@query("retain_then_rank", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY l.quality = 1 DESC NULLS LAST, d.n_chars DESC, d.doc_id LIMIT 50")
def retain_then_rank(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.orderBy(F.desc_nulls_last(F.col("quality") == 1), F.desc("n_chars"), "doc_id").limit(50).select("doc_id")


@query("pending_reading", f"WITH {PAPERS_SQL} SELECT id FROM papers WHERE parsed_path IS NULL AND coalesce(status, '') <> 'off_topic' ORDER BY fulltext_path IS NULL, status = 'parsed' DESC NULLS LAST, year DESC, id LIMIT 40")
def pending_reading(spark, d):
    rows = papers(spark, d).where("parsed_path IS NULL AND coalesce(status, '') <> 'off_topic'")
    return rows.orderBy(F.col("fulltext_path").isNull(), F.desc_nulls_last(F.col("status") == "parsed"), F.desc("year"), "id").limit(40).select("id")


@query("retry_select", "WITH asked AS (SELECT doc_id AS id, doc_id AS ord, 0 AS late FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, doc_id, 1 FROM labels WHERE toxic = 1), f AS (SELECT id, min(late * 1000000000000 + ord) AS place_at FROM asked WHERE id IN (SELECT doc_id FROM documents) AND id NOT IN (SELECT conv_id FROM conversations) GROUP BY id) SELECT id, row_number() OVER (ORDER BY unread, place_at) AS place FROM (SELECT f.*, CASE WHEN d.n_chars > 1000 THEN 0 ELSE 1 END AS unread FROM f JOIN documents d ON d.doc_id = f.id) ORDER BY unread, place_at LIMIT 8")
def retry_select(spark, d):
    rows, labels = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars"), table(spark, d, "labels").withColumnRenamed("doc_id", "id")
    tried = table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct()
    got = R.retry_selection(rows, labels.where("quality = 0").select("id", F.col("id").alias("ord")), labels.where("toxic = 1").select("id"), rows.where("n_chars > 1000").select("id"), tried)
    return got.select("id", F.col("place").cast("bigint").alias("place"))


@query("batch_assign", "SELECT source, doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 12)::BIGINT AS batch FROM documents")
def batch_assign(spark, d):
    rows = C.numbered(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", "number")
    return rows.select("source", "doc_id", F.floor((F.col("number") - 1) / 12).alias("batch"))


