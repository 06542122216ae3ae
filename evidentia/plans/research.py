"""Coverage, admission, completion, coalescing and SQL-callable operators over the test tables.

Labels stand for audits, documents for papers and candidates, benchmark passages for members of a set.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import sql as Q
from evidentia.operators import admission as A
from evidentia.operators import completion as CM
from evidentia.operators import coverage as C
from evidentia.operators import reports as RP
from evidentia.plans.base import query
from evidentia.plans.retrieval import DOCUMENTS_SQL, chunks_sql
from evidentia.sources.tables import table
from evidentia.streaming import timers as TM

PAUSE, FULL, IDLE = 36_000_000, 40, 36_000_000


def deltas(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("call"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("text"), F.lit(False).alias("ends"))


@query(
    "delta_pieces",
    f"""WITH RECURSIVE e AS (SELECT user_id AS call, event_id AS seq, epoch_us(ts) // 1000 AS ms, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n_all FROM events),
r AS (SELECT call, k, n_all, seq AS first, 1::BIGINT AS n, text AS body, TRUE AS out, ms AS last FROM e WHERE k = 1
UNION ALL SELECT call, k, n_all, first, n, body, ms - last >= {PAUSE} OR length(body) >= {FULL}, CASE WHEN ms - last >= {PAUSE} OR length(body) >= {FULL} THEN ms ELSE last END FROM
(SELECT r.call, e.k, e.n_all, CASE WHEN r.out THEN e.seq ELSE r.first END AS first, CASE WHEN r.out THEN 1 ELSE r.n + 1 END AS n, CASE WHEN r.out THEN e.text ELSE r.body || e.text END AS body, e.ms, r.last FROM r JOIN e ON e.call = r.call AND e.k = r.k + 1))
SELECT call, first, n, body FROM r WHERE out OR k = n_all""",
)
def delta_pieces(spark, d):
    """Events of a user as deltas of a call, in pieces of ten hours or forty characters."""
    return TM.coalesce(deltas(spark, d), PAUSE, FULL)


@query(
    "idle_spells",
    f"""WITH m AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000) AS before FROM events), s AS (SELECT *, sum(CASE WHEN before IS NULL OR ms - before >= {IDLE} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS spell FROM m)
SELECT user_id AS key, max(ms)::BIGINT AS since_ms, count(*) AS beats FROM s GROUP BY user_id, spell HAVING max(ms) + {IDLE} <= (SELECT max(epoch_us(ts)) // 1000 FROM events)""",
)
def idle_spells(spark, d):
    beats = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    until = beats.agg(F.max("ts")).first()[0]
    return TM.idle_spells(beats, IDLE, F.lit(until)).select("key", F.unix_millis("since").alias("since_ms"), "beats")


CAP = 50


@query(
    "admission_replace",
    f"""WITH RECURSIVE m AS (SELECT -1 - item_id AS id, item_id AS ord, CASE WHEN item_id % 7 = 0 THEN 0.5 ELSE length(text) END::DOUBLE AS score, item_id % 4 = 0 AS fixed FROM benchmark WHERE item_id < {CAP}),
w AS (SELECT id, score, row_number() OVER (ORDER BY score, ord) - 1 AS j FROM m WHERE NOT fixed), room AS (SELECT greatest(0, {CAP} - count(*)) AS n FROM m), q AS (SELECT doc_id AS id, doc_id AS ord, n_chars::DOUBLE AS score, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
r AS (SELECT n AS k, 0::BIGINT AS j, NULL::BIGINT AS id, NULL::BIGINT AS ord, NULL::BIGINT AS replaced FROM room
UNION ALL SELECT q.k, CASE WHEN w.score < q.score THEN r.j + 1 ELSE r.j END, CASE WHEN w.score < q.score THEN q.id END, q.ord, w.id FROM r JOIN q ON q.k = r.k + 1 LEFT JOIN w ON w.j = r.j)
SELECT id, ord, NULL::BIGINT AS replaced FROM q, room WHERE k <= n UNION ALL SELECT id, ord, replaced FROM r WHERE id IS NOT NULL""",
)
def admission_replace(spark, d):
    """Documents in order of id, longer ones stronger, taking the places of passages."""
    passages = table(spark, d, "benchmark").where(F.col("item_id") < CAP)
    members = passages.select((-1 - F.col("item_id")).alias("id"), F.col("item_id").alias("ord"), F.when(F.col("item_id") % 7 != 0, F.length("text").cast("double")).alias("score"), (F.col("item_id") % 4 == 0).alias("fixed"))
    newcomers = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.col("n_chars").cast("double").alias("score"))
    return A.admit(members, newcomers, CAP)


def research(spark, d):
    """A run: labelled documents are its papers, and each source of documents a query that returns them."""
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    own = labels.select(F.col("doc_id").alias("id"), "quality", "toxic").dropDuplicates(["id"])
    error = F.when(F.col("toxic") == 1, "unreadable").cast("string")
    given = CM.Research(
        papers=own.select("id"),
        profiles=own.where("quality IS NOT NULL").select("id", error.alias("error")),
        audits=own.where("quality = 1").select("id", F.lit("audited").alias("status"), F.lit(None).cast("string").alias("mode")),
        planned=docs.groupBy(F.col("source").alias("query")).agg(F.min("id").alias("ord")).select("ord", "query"),
        executed=docs.where("id < 2").select(F.col("source").alias("query")).distinct(),
        requested=own.where("toxic = 1").select(F.col("id").alias("ord"), "id"),
        opens=docs.select(F.col("id").alias("ord"), F.concat(F.lit("lang:"), "lang").alias("query"), "id"),
    )
    results = docs.select(F.col("source").alias("query"), F.col("id").alias("ord"), "id").unionByName(docs.select(F.concat(F.lit("lang:"), "lang").alias("query"), F.col("id").alias("ord"), "id"))
    return given, results, docs.where("n_chars > 500").select("id")


@query("completion_rounds")
def completion_rounds(spark, d):
    return CM.complete(*research(spark, d))[1]


@query("sql_token_chunks", f"WITH {chunks_sql(DOCUMENTS_SQL)} SELECT id, ord::INTEGER AS ord, s::INTEGER AS start, e::INTEGER AS \"end\", md5(text) AS h FROM chunks")
def sql_token_chunks(spark, d):
    """Chunks by a table function of the session's SQL."""
    Q.register(spark)
    return spark.sql("SELECT doc_id AS id, c.ord, c.start, c.end, md5(c.chunk) AS h FROM {docs}, LATERAL token_chunks(text) c", docs=table(spark, d, "documents"))


@query("sql_quote_span", r"SELECT doc_id AS id, instr(regexp_replace(text, '[\s\x0B]+', '', 'g'), q)::BIGINT AS tight_at FROM (SELECT doc_id, text, regexp_replace(substr(text, 31, 60), '[\s\x0B]+', '', 'g') AS q FROM documents) WHERE length(q) >= 12")
def sql_quote_span(spark, d):
    """Where a piece of each text lies in it for the first time, white space aside."""
    Q.register(spark)
    found = spark.sql("SELECT doc_id AS id, text, q.start FROM {docs}, LATERAL quote_span(text, substr(text, 31, 60)) q", docs=table(spark, d, "documents"))
    before = F.regexp_replace(F.substr("text", F.lit(1), F.col("start")), r"\s+", "")
    return found.select("id", (F.length(before) + 1).cast("bigint").alias("tight_at"))


@query("sql_bm25", "WITH t AS (SELECT doc_id AS id, (length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4e0 AS tf, greatest(length(text) - 2, 0)::DOUBLE AS dl FROM documents), s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean, count_if(tf > 0)::DOUBLE AS df FROM t) SELECT id, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / mean)), 6) + 0e0 AS score FROM t, s WHERE tf > 0")
def sql_bm25(spark, d):
    """A ranking written in the session's SQL with the library's functions."""
    Q.register(spark)
    return spark.sql(
        "WITH t AS (SELECT doc_id AS id, term_count(text, 'tion') AS tf, CAST(greatest(length(text) - 2, 0) AS DOUBLE) AS dl FROM {docs}), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS mean, CAST(count_if(tf > 0) AS DOUBLE) AS df FROM t) "
        "SELECT id, round(bm25_part(tf, df, n, dl, mean), 6) + 0.0D AS score FROM t CROSS JOIN s WHERE tf > 0",
        docs=table(spark, d, "documents"),
    )


#: Audits, assessments and evidence, made of labels and documents.
AUDIT_SQL = """claims AS (SELECT unnest([0, 1, 2, 3]) AS claim_id), au AS (SELECT doc_id AS paper_id, lang FROM (SELECT l.doc_id, l.quality, max(d.lang) AS lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY ALL) WHERE quality = 1 AND doc_id % 5 <> 0 AND doc_id % 4 <> 0),
ass AS (SELECT paper_id, lang, k, (paper_id + k) % 5 AS claim_id, CASE WHEN (paper_id + k) % 3 = 0 THEN 'partially_covered' WHEN (paper_id + k) % 7 = 0 THEN 'not_relevant' ELSE 'covered' END AS verdict FROM au, (SELECT unnest([0, 1, 2]) AS k)),
ev AS (SELECT paper_id, paper_id * 10 + j AS evidence_id FROM au, (SELECT unnest([1, 2, 3]) AS j) WHERE (paper_id + j) % 3 <> 0),
cl AS (SELECT a.paper_id, a.claim_id, a.k, a.lang, verdict, list(evidence_id ORDER BY evidence_id) AS ids FROM ass a JOIN claims c ON c.claim_id = a.claim_id JOIN ev e ON e.paper_id = a.paper_id AND e.evidence_id IN (a.paper_id * 10 + 1, a.paper_id * 10 + 2 + a.k) WHERE verdict <> 'not_relevant' GROUP BY ALL)"""


def covered(spark, d):
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents")
    rows = labels.join(docs.select("doc_id", "lang"), "doc_id").groupBy("doc_id", "quality").agg(F.max("lang").alias("lang"))
    p = F.col("doc_id")
    audit = rows.select(p.alias("paper_id"), F.when(F.col("quality") == 1, "audited").otherwise("open").alias("status"), F.when(p % 5 == 0, C.FALLBACK).alias("mode"), F.when(p % 4 == 0, "abstract").otherwise(C.FULLTEXT).alias("source_type"), F.array("lang").alias("relations"))
    each = rows.select(p.alias("paper_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    s = F.col("paper_id") + F.col("k")
    verdict = F.when(s % 3 == 0, "partially_covered").when(s % 7 == 0, "not_relevant").otherwise("covered")
    said = each.select("paper_id", (s % 5).cast("int").alias("claim_id"), F.col("k").alias("ord"), verdict.alias("verdict"), F.array(F.col("paper_id") * 10 + 1, F.col("paper_id") * 10 + 2 + F.col("k")).alias("evidence_ids"), F.lit("").alias("reason"))
    evidence = rows.select(p.alias("paper_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("j")).select("paper_id", (F.col("paper_id") * 10 + F.col("j")).alias("evidence_id"), F.when((F.col("paper_id") + F.col("j")) % 3 != 0, "direct_fulltext").otherwise("abstract").alias("level"))
    claims = spark.createDataFrame([(k, f"claim {k}") for k in range(4)], "claim_id int, claim string")
    return C.cells(claims, audit, said, evidence)


@query("claim_cells", f"WITH {AUDIT_SQL} SELECT claim_id::INTEGER AS claim_id, paper_id, lang AS relation, CASE verdict WHEN 'covered' THEN 'direct' ELSE 'partial' END AS coverage, array_to_string(ids, ',') AS evidence FROM cl")
def claim_cells(spark, d):
    return covered(spark, d).select("claim_id", "paper_id", F.array_join("relations", ",").alias("relation"), "coverage", F.array_join(F.col("evidence_ids").cast("array<string>"), ",").alias("evidence"))


@query("claim_records", f"WITH {AUDIT_SQL} SELECT paper_id, string_agg(DISTINCT claim_id::VARCHAR, ',' ORDER BY claim_id::VARCHAR) AS claims, count(DISTINCT e)::BIGINT AS n_evidence FROM (SELECT paper_id, claim_id, unnest(ids) AS e FROM cl) GROUP BY paper_id")
def claim_records(spark, d):
    return C.records(covered(spark, d)).select("paper_id", F.array_join(F.col("claim_ids").cast("array<string>"), ",").alias("claims"), F.size("evidence_ids").cast("bigint").alias("n_evidence"))


@query(
    "candidate_grounding",
    f"""WITH {AUDIT_SQL}, rec AS (SELECT paper_id, list_distinct(flatten(list(ids))) AS ids FROM cl GROUP BY paper_id),
c AS (SELECT doc_id % 100 AS run, doc_id AS ord, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS o, CASE WHEN doc_id % 6 <> 0 THEN 'g' || (doc_id % 350) END AS gap_id, doc_id, coalesce(source, '') <> '' AS based FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY run, coalesce(gap_id, '') ORDER BY o, ord) = 1 AS lead FROM c), s AS (SELECT *, sum(lead::INT) OVER (PARTITION BY run ORDER BY o, ord) AS seen FROM f WHERE lead OR gap_id IS NULL),
g AS (SELECT s.*, EXISTS (SELECT 1 FROM rec WHERE rec.paper_id = s.doc_id + 1) AS near, EXISTS (SELECT 1 FROM rec WHERE rec.paper_id = s.doc_id AND list_contains(rec.ids, s.doc_id * 10 + 1)) AS held FROM s)
SELECT run, ord, coalesce(gap_id, 'candidate_' || seen::BIGINT) AS gap_id, CASE WHEN o = 0 AND near AND held AND based THEN 'gaps' WHEN o = 2 THEN 'rejected_gaps' ELSE 'provisional_gaps' END AS bucket,
CASE WHEN o = 0 AND near AND held AND based THEN '' ELSE concat_ws(',', CASE WHEN NOT near THEN 'no_nearest_work' END, CASE WHEN NOT held THEN 'no_evidence' END, CASE WHEN NOT based THEN 'no_basis' END) END AS notes FROM g""",
)
def candidate_grounding(spark, d):
    doc = F.col("doc_id")
    pair = lambda i, x: F.struct(i.alias("paper_id"), F.lit(x).alias("difference"))
    rows = table(spark, d, "documents").select(
        (doc % 100).alias("run"), doc.alias("ord"), F.when(F.col("lang") == "en", C.ORIGINS[0]).when(F.col("lang") == "de", C.ORIGINS[1]).otherwise(C.ORIGINS[2]).alias("origin"), F.when(doc % 6 != 0, F.concat(F.lit("g"), doc % 350)).alias("gap_id"), F.lit(None).cast("string").alias("name"), F.lit("supported_candidate").alias("status"),
        F.col("source").alias("basis"), F.lit("own").alias("contribution"), F.array(pair(doc, " "), pair(doc + 1, "differs")).alias("nearest"), F.array(F.struct(doc.alias("paper_id"), F.array(doc * 10 + 1, F.lit(7).cast("bigint")).alias("evidence_ids"))).alias("evidence"),
    )
    runs = spark.range(100).select(F.col("id").alias("run"))
    known = C.records(covered(spark, d)).select("paper_id", "evidence_ids")
    # a paper is asked for by the runs of two neighbouring documents only
    near = known.select(F.explode(F.array((F.col("paper_id") - 1) % 100, F.col("paper_id") % 100)).alias("run"), "paper_id", "evidence_ids").join(F.broadcast(runs), "run")
    got = C.ground(rows, near)
    return got.select("run", "ord", "gap_id", "bucket", F.array_join("notes", ",").alias("notes"))


@query(
    "report_rules",
    r"""SELECT doc_id, array_to_string(CASE WHEN length(trim(x)) < 300 THEN ['too_short'] ELSE list_filter([CASE WHEN len(list_filter(c, lambda n: n NOT IN ('1', '2'))) > 0 THEN 'unknown_citation' END, CASE WHEN len(c) = 0 THEN 'no_citation' END, CASE WHEN doc_id % 4 = 0 THEN 'missing:Methods' END, CASE WHEN doc_id % 4 = 1 THEN 'order' END, CASE WHEN doc_id % 5 = 0 THEN 'unwanted:Gaps' END], lambda e: e IS NOT NULL) END, ',') AS errors
FROM (SELECT doc_id, x, regexp_extract_all(x, '\[(\d+)\]', 1) AS c FROM (SELECT doc_id, (CASE doc_id % 4 WHEN 0 THEN E'## Results\n' WHEN 1 THEN E'## Results\n## Methods\n' ELSE E'## Methods\n## Results\n' END) || CASE WHEN doc_id % 5 = 0 THEN E'## Gaps\n' ELSE '' END || replace(replace(replace(replace(text, '##', ''), '[', '('), '<', ''), '_', ' ') || CASE doc_id % 3 WHEN 0 THEN ' [1]' WHEN 1 THEN ' [2] [7]' ELSE '' END AS x FROM documents))""",
)
def report_rules(spark, d):
    doc = F.col("doc_id")
    text = F.col("text")
    for mark, plain in (("##", ""), ("[", "("), ("<", ""), ("_", " ")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    heads = F.when(doc % 4 == 0, "## Results\n").when(doc % 4 == 1, "## Results\n## Methods\n").otherwise("## Methods\n## Results\n")
    cited = F.when(doc % 3 == 0, " [1]").when(doc % 3 == 1, " [2] [7]").otherwise("")
    rows = table(spark, d, "documents").select("doc_id", F.concat(heads, F.when(doc % 5 == 0, "## Gaps\n").otherwise(""), text, cited).alias("text"), F.array(F.lit(1), F.lit(2)).cast("array<bigint>").alias("sources"))
    return RP.validate_reports(rows, ["Methods", "Results"], ["Gaps"]).select("doc_id", F.array_join("errors", ",").alias("errors"))
