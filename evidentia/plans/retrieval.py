"""Retrieval queries over documents, embeddings and benchmark passages."""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
from pyspark.sql import functions as F

from evidentia.operators import index as X
from evidentia.operators import passages as P
from evidentia.operators import retrieval as R
from evidentia.operators import segments as S
from evidentia.operators import vectors as VX
from evidentia.plans.base import query
from evidentia.sources.sinks import work_dir
from evidentia.sources.tables import table

QUESTION = "the thation anhe_or ouestion"
TERMS = R.query_terms(QUESTION)

_TF = ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{t}', ''))) / {len(t)}::DOUBLE AS t{k}" for k, t in enumerate(TERMS))
_DF = ", ".join(f"sum(CASE WHEN t{k} > 0 THEN 1e0 ELSE 0 END) AS d{k}" for k in range(len(TERMS)))
_SUM = " + ".join(f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * t{k} * 2.2e0 / (t{k} + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))" for k in range(len(TERMS)))
_ANY = " OR ".join(f"t{k} > 0" for k in range(len(TERMS)))
BM25_SQL = f"""tf AS (SELECT doc_id AS id, greatest(length(text) - 2, 0)::DOUBLE AS dl, {_TF} FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {_DF} FROM tf),
bm AS (SELECT id, {_SUM} AS score FROM tf, st WHERE {_ANY}),
lex AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm)"""
COS_SQL = """probe AS (SELECT embedding::DOUBLE[] AS y FROM embeddings WHERE vec_id = 0),
cs AS (SELECT vec_id AS id, 1 - list_dot_product(embedding::DOUBLE[], y) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(y, y))) AS distance FROM embeddings, probe),
vec AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS rank FROM cs)"""


def documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 50).alias("parent"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def probe(spark, d) -> list[float]:
    return vectors(spark, d).where("id = 0").first()["vector"]


@query("bm25_topk", f"WITH {BM25_SQL} SELECT id, round(score, 6) AS score, rank FROM lex WHERE rank <= 40")
def bm25_topk(spark, d):
    return R.top(R.bm25(documents(spark, d), TERMS), [F.desc("score"), F.asc("id")], 40).select("id", F.round("score", 6).alias("score"), "rank")


@query("index_search", f"WITH {BM25_SQL} SELECT id, round(score, 6) AS score, rank FROM lex WHERE rank <= 40")
def index_search(spark, d):
    """The same over a stored index, which is built here first; later searches would read it as it is."""
    folder = f"{work_dir(spark)}/index-{uuid.uuid4().hex}"
    X.build(documents(spark, d), folder)
    return R.top(X.search(spark, folder, TERMS), [F.desc("score"), F.asc("id")], 40).select("id", F.round("score", 6).alias("score"), "rank")


#: White space of any script in SQL's patterns, as passages.BLANK has it.
BLANK_SQL = r"\t-\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def chunks_sql(rows: str) -> str:
    """CTEs ending in chunks (id, ord, start, end, text): windows of 112 words, 88 apart, of rows (id, text)."""
    return rf"""given AS ({rows}), pieces AS (SELECT id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_extract_all(text, '[{BLANK_SQL}]*[^{BLANK_SQL}]+') AS x FROM given)),
tokens AS (SELECT id, i, sum(length(x)) OVER (PARTITION BY id ORDER BY i) AS e, length(regexp_replace(x, '^[{BLANK_SQL}]+', '')) AS n FROM pieces),
spans AS (SELECT id, i, e - n AS s, coalesce(lead(e, 111) OVER (PARTITION BY id ORDER BY i), max(e) OVER (PARTITION BY id)) AS e FROM tokens),
chunks AS (SELECT p.id, (i - 1) // 88 AS ord, s::BIGINT AS s, e::BIGINT AS e, substr(text, s::BIGINT + 1, (e - s)::BIGINT) AS text FROM spans p JOIN given g ON g.id = p.id WHERE (i - 1) % 88 = 0)"""


def chunk_bm25_sql(rows: str, where: str = "TRUE", most: int = 40) -> str:
    """The best chunks of rows by BM25 over all chunks, of those where the condition holds."""
    return f"""WITH {chunks_sql(rows)}, tf AS (SELECT id, ord, greatest(length(text) - 2, 0)::DOUBLE AS dl, {_TF} FROM chunks), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {_DF} FROM tf),
bm AS (SELECT id, ord, {_SUM} AS score FROM tf, st WHERE {_ANY}), lex AS (SELECT id, ord, score, row_number() OVER (ORDER BY score DESC, id, ord) AS rank FROM bm WHERE {where}) SELECT id, ord::INTEGER AS ord, round(score, 6) AS score, rank FROM lex WHERE rank <= {most}"""


DOCUMENTS_SQL = "SELECT doc_id AS id, text FROM documents"


@query("token_chunks", f"WITH {chunks_sql(DOCUMENTS_SQL)} SELECT id, ord::INTEGER AS ord, s::INTEGER AS start, e::INTEGER AS \"end\", md5(text) AS h FROM chunks")
def token_chunks(spark, d):
    return P.token_chunks(documents(spark, d)).select("id", "ord", "start", "end", F.md5("chunk").alias("h"))


_built: dict[tuple[str, str], str] = {}


def hashed_words(texts: list[str], size: int = 64) -> np.ndarray:
    """A vector of word counts, hashed: an encoder that needs no model."""
    out = np.zeros((len(texts), size), np.float32)
    for k, text in enumerate(texts):
        for word in re.findall(r"\w+", text.lower()):
            out[k, zlib.crc32(word.encode()) % size] += 1
    return out


def chunk_index(spark, d, fresh: bool = False) -> str:
    """The folder of the index over all documents' chunks, built once a session and table folder."""
    key = (spark.sparkContext.applicationId, d)
    if fresh or key not in _built:
        folder = f"{work_dir(spark)}/chunks-{uuid.uuid4().hex}"
        S.update(S.stamped(documents(spark, d).select("id", "text")), folder, encode=hashed_words)
        _built[key] = folder
    return _built[key]


def best_chunks(found, most: int = 40):
    return R.top(found, [F.desc("score"), F.asc("id"), F.asc("ord")], most).select("id", "ord", F.round("score", 6).alias("score"), "rank")


@query("chunk_index_build", f"WITH {chunks_sql(DOCUMENTS_SQL)} SELECT id, count(e) AS n_chunks, coalesce(sum(greatest(length(c.text) - 2, 0)), 0)::DOUBLE AS dl, sha256(coalesce(g.text, '')) AS sha FROM given g LEFT JOIN chunks c USING (id) GROUP BY id, g.text")
def chunk_index_build(spark, d):
    return S.sources(spark, chunk_index(spark, d, fresh=True)).select("id", "n_chunks", "dl", "sha")


@query("chunk_search", chunk_bm25_sql(DOCUMENTS_SQL))
def chunk_search(spark, d):
    return best_chunks(S.lexical(spark, chunk_index(spark, d), TERMS))


@query("chunk_search_after_updates", chunk_bm25_sql("SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN replace(text, 'on', 'no') || ' changed the text' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0"))
def chunk_search_after_updates(spark, d):
    """The index of all documents, then changed ones come in and others go; equal to an index of what is left."""
    folder = f"{work_dir(spark)}/chunks-{uuid.uuid4().hex}"
    docs = documents(spark, d).select("id", "text")
    S.update(S.stamped(docs), folder)
    changed = docs.withColumn("text", F.when(F.col("id") % 10 == 0, F.concat(F.replace("text", F.lit("on"), F.lit("no")), F.lit(" changed the text"))).otherwise(F.col("text")))
    S.update(S.stamped(changed.where("id % 10 = 0")), folder)
    S.update(S.stamped(changed.where("id % 7 <> 0")), folder, prune=True)
    return best_chunks(S.lexical(spark, folder, TERMS))


@query("session_search", chunk_bm25_sql("SELECT conv_id * 100000 + turn AS id, text FROM conversations", "id // 100000 IN (SELECT conv_id FROM conversations WHERE role = 'system')", 10))
def session_search(spark, d):
    """Turns as documents of a stored index; a search looks in the sessions of its scope, here those with a system turn."""
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), "conv_id", "role", "text")
    folder = f"{work_dir(spark)}/sessions-{uuid.uuid4().hex}"
    S.update(S.stamped(turns.select("id", "text")), folder)
    sessions = turns.where("role = 'system'").select("conv_id").distinct()
    return best_chunks(S.lexical(spark, folder, TERMS, turns.join(sessions, "conv_id", "left_semi").select("id")), 10)


@query("chunk_hybrid_search")
def chunk_hybrid_search(spark, d):
    """Hits with their section, place and version, of the documents that still have the version which the index has."""
    current = S.stamped(documents(spark, d)).select("id", "sha")
    hits = S.hybrid(spark, chunk_index(spark, d), QUESTION, hashed_words([QUESTION])[0].tolist(), current)
    return hits.select("id", "ord", "section", "start", "end", "sha", F.array_join("methods", "+").alias("methods"), F.round("rrf", 9).alias("rrf"), "rank")


@query("vector_index_exact", f"WITH {COS_SQL} SELECT id, round(distance, 6) + 0e0 AS distance, rank FROM vec WHERE rank <= 40")
def vector_index_exact(spark, d):
    """All cells of a stored index."""
    near = VX.search(spark, vector_index(spark, d), probe(spark, d), exact=True)
    return R.top(near, [F.asc("distance"), F.asc("id")], 40).select("id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


def vector_index(spark, d) -> str:
    key = (spark.sparkContext.applicationId, d + "#vectors")
    if key not in _built:
        folder = f"{work_dir(spark)}/vectors-{uuid.uuid4().hex}"
        VX.build(vectors(spark, d), folder)
        _built[key] = folder
    return _built[key]


@query("vector_index_search")
def vector_index_search(spark, d):
    """The nearest cells only, as many as the index measured for its recall."""
    near = VX.search(spark, vector_index(spark, d), probe(spark, d))
    return R.top(near, [F.asc("distance"), F.asc("id")], 40).select("id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


@query("lexical_topk", f"WITH {BM25_SQL}, sc AS (SELECT * FROM bm WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)) SELECT id, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, id LIMIT 40")
def lexical_topk(spark, d):
    scope = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    hits = R.bm25(documents(spark, d), TERMS).join(scope, "id", "left_semi")
    return R.top(hits, [F.desc("score"), F.asc("id")], 40).select("id", F.round("score", 6).alias("score"))


@query("vector_topk", f"WITH {COS_SQL} SELECT id, round(distance, 6) + 0e0 AS distance, rank FROM vec WHERE rank <= 40")
def vector_topk(spark, d):
    near = vectors(spark, d).select("id", R.cosine_distance(F.col("vector"), probe(spark, d)).alias("distance"))
    return R.top(near, [F.asc("distance"), F.asc("id")], 40).select("id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


@query("overfetch_filter", f"WITH {COS_SQL} SELECT id, round(distance, 6) + 0e0 AS distance FROM (SELECT v.*, e.label FROM vec v JOIN embeddings e ON e.vec_id = v.id WHERE rank <= 40) WHERE label < 5 ORDER BY distance, id LIMIT 8")
def overfetch_filter(spark, d):
    near = vectors(spark, d).select("id", "label", R.cosine_distance(F.col("vector"), probe(spark, d)).alias("distance"))
    kept = R.top(near, [F.asc("distance"), F.asc("id")], 40).where("label < 5").drop("rank")
    return R.top(kept, [F.asc("distance"), F.asc("id")], 8).select("id", (F.round("distance", 6) + 0.0).alias("distance"))


RRF_SQL = f"{BM25_SQL}, {COS_SQL}, both_ AS (SELECT id, rank FROM lex WHERE rank <= 40 UNION ALL SELECT id, rank FROM vec WHERE rank <= 40), fused AS (SELECT id, sum(1e0 / (60 + rank)) AS rrf, count(*) AS n_methods FROM both_ GROUP BY id)"


@query("rrf_fusion", f"WITH {RRF_SQL} SELECT id, round(rrf, 9) AS rrf, n_methods FROM fused")
def rrf_fusion(spark, d):
    lexical = R.top(R.bm25(documents(spark, d), TERMS), [F.desc("score"), F.asc("id")], 40)
    near = vectors(spark, d).select("id", R.cosine_distance(F.col("vector"), probe(spark, d)).alias("distance"))
    semantic = R.top(near, [F.asc("distance"), F.asc("id")], 40)
    return R.reciprocal_rank_fusion(lexical, semantic).select("id", F.round("rrf", 9).alias("rrf"), "n_methods")


@query(
    "hybrid_search",
    f"WITH {RRF_SQL}, one AS (SELECT f.*, f.id % 50 AS parent, row_number() OVER (PARTITION BY f.id % 50 ORDER BY rrf DESC, f.id) AS turn FROM fused f JOIN documents d ON d.doc_id = f.id) "
    "SELECT id, parent, round(rrf, 9) AS rrf, n_methods, row_number() OVER (ORDER BY one.rrf DESC, id) AS rank FROM one WHERE turn = 1 ORDER BY one.rrf DESC, id LIMIT 8",
)
def hybrid_search(spark, d):
    found = R.hybrid_search(documents(spark, d), vectors(spark, d), QUESTION, probe(spark, d))
    return found.select("id", "parent", F.round("rrf", 9).alias("rrf"), "n_methods", "rank")


@query("query_terms", r"SELECT item_id, list_slice(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]{3,}|[\x{3400}-\x{9fff}]+'), lambda t: substr(t, 1, 8)), 1, 24) AS terms FROM benchmark")
def query_terms(spark, d):
    return table(spark, d, "benchmark").select("item_id", R.query_terms_col(F.col("text")).alias("terms"))


@query(
    "token_windows",
    """WITH t AS (SELECT doc_id AS id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT id, w, unnest(range(0, len(w), 88)) AS i FROM t WHERE len(w) > 0)
SELECT id, (i / 88)::BIGINT AS ord, len(list_slice(w, i + 1, i + 112))::BIGINT AS n, md5(array_to_string(list_slice(w, i + 1, i + 112), ' ')) AS h FROM s""".replace("(i / 88)", "(i // 88)"),
)
def token_windows(spark, d):
    words = documents(spark, d).select("id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w")).where("size(w) > 0")
    at = words.select("id", "w", F.explode(F.expr("sequence(0, size(w) - 1, 88)")).alias("i"))
    window = F.expr("slice(w, i + 1, 112)")
    return at.select("id", F.floor(F.col("i") / 88).alias("ord"), F.size(window).cast("bigint").alias("n"), F.md5(F.array_join(window, " ")).alias("h"))


@query(
    "parent_of_chunk",
    """WITH t AS (SELECT doc_id AS id, length(text) AS n FROM documents WHERE length(text) > 0), c AS (SELECT id, n, unnest(range(0, n, 500)) AS start FROM t),
p AS (SELECT id, unnest(range(0, n, 1600)) AS p_start, n FROM t)
SELECT c.id, c.start::BIGINT AS start, p_start::BIGINT AS parent_start, least(p_start + 1600, p.n)::BIGINT AS parent_end FROM c JOIN p ON c.id = p.id AND c.start >= p_start AND c.start < p_start + 1600""",
)
def parent_of_chunk(spark, d):
    """Point in interval: both sides share the document and the number of the interval, so the join is an equi-join."""
    size = documents(spark, d).select("id", F.length("text").cast("bigint").alias("n")).where("n > 0")
    chunks = size.select("id", F.explode(F.expr("sequence(0L, n - 1, 500L)")).alias("start")).withColumn("bin", F.floor(F.col("start") / 1600))
    spans = size.select("id", "n", F.explode(F.expr("sequence(0L, n - 1, 1600L)")).alias("parent_start")).select("id", "parent_start", F.least(F.col("parent_start") + 1600, "n").alias("parent_end"), F.floor(F.col("parent_start") / 1600).alias("bin"))
    return chunks.join(spans, ["id", "bin"]).select("id", "start", "parent_start", "parent_end")


@query("l2_normalize", "SELECT vec_id, round(list_sum(list_transform(e, lambda v: v / n)), 6) AS total, round(list_max(list_transform(e, lambda v: v / n)), 6) AS top FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def l2_normalize(spark, d):
    x = F.transform("vector", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(F.transform(x, lambda v: v * v), F.lit(0.0), lambda a, v: a + v))
    unit = vectors(spark, d).select(F.col("id").alias("vec_id"), x.alias("x"), norm.alias("n")).withColumn("u", F.transform("x", lambda v: v / F.col("n")))
    return unit.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(F.array_max("u"), 6).alias("top"))


WORDS = ("the", "oned", "shing")
_WTF = ", ".join(f"len(list_filter(ws, lambda x: x = '{w}'))::DOUBLE AS t{k}" for k, w in enumerate(WORDS))
_WSUM = " + ".join(f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * t{k} * 2.2e0 / (t{k} + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))" for k in range(3))


def equals(word: str):
    return lambda x: x == word


@query(
    "word_bm25",
    rf"WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM documents), tf AS (SELECT id, len(ws)::DOUBLE AS dl, {_WTF} FROM w), "
    "st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, " + ", ".join(f"sum(CASE WHEN t{k} > 0 THEN 1e0 ELSE 0 END) AS d{k}" for k in range(3)) + " FROM tf), "
    f"s AS (SELECT id, {_WSUM} AS score FROM tf, st WHERE t0 > 0 OR t1 > 0 OR t2 > 0) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 40",
)
def word_bm25(spark, d):
    words = documents(spark, d).select("id", F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)).alias("ws"))
    counted = words.select("id", F.size("ws").cast("double").alias("dl"), *[F.size(F.filter("ws", equals(w))).cast("double").alias(f"t{k}") for k, w in enumerate(WORDS)])
    stats = counted.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum(F.when(F.col(f"t{k}") > 0, 1.0).otherwise(0.0)).alias(f"d{k}") for k in range(3)])
    part = lambda k: F.greatest(F.log((F.col("n") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5)), F.lit(1e-6)) * F.col(f"t{k}") * 2.2 / (F.col(f"t{k}") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    scored = counted.where("t0 > 0 OR t1 > 0 OR t2 > 0").crossJoin(F.broadcast(stats)).select("id", (part(0) + part(1) + part(2)).alias("score"))
    return R.top(scored, [F.desc("score"), F.asc("id")], 40).select("id", F.round("score", 6).alias("score"))


EX_TERMS = ("ing", "tion", "oned")


@query(
    "excerpt_scores",
    "WITH t AS (SELECT doc_id AS id, text, length(text) AS n FROM documents WHERE length(text) > 0), c AS (SELECT id, s, lower(substr(text, s + 1, 1600)) AS x FROM (SELECT id, text, unnest(range(0, n, 1600)) AS s FROM t)), "
    "st AS (SELECT id, count(*) AS n, " + ", ".join(f"sum(CASE WHEN contains(x, '{t}') THEN 1 ELSE 0 END) AS d{k}" for k, t in enumerate(EX_TERMS)) + " FROM c GROUP BY id) "
    "SELECT c.id, s::BIGINT AS start, round(" + " + ".join(f"CASE WHEN contains(x, '{t}') THEN ln(1 + n / (1e0 + d{k})) ELSE 0e0 END" for k, t in enumerate(EX_TERMS)) + ", 6) AS score FROM c JOIN st ON st.id = c.id",
)
def excerpt_scores(spark, d):
    docs = documents(spark, d).withColumn("n", F.length("text").cast("bigint")).where("n > 0")
    cut = docs.select("id", "text", F.explode(F.expr("sequence(0L, n - 1, 1600L)")).alias("start")).select("id", "start", F.lower(F.expr("substring(text, CAST(start AS INT) + 1, 1600)")).alias("x"))
    has = [F.contains("x", F.lit(t)) for t in EX_TERMS]
    marked = cut.select("id", "start", *[h.alias(f"h{k}") for k, h in enumerate(has)])
    stats = marked.groupBy("id").agg(F.count("*").alias("n"), *[F.sum(F.col(f"h{k}").cast("int")).alias(f"d{k}") for k in range(len(EX_TERMS))])
    score = sum((F.when(F.col(f"h{k}"), F.log(1 + F.col("n") / (1.0 + F.col(f"d{k}")))).otherwise(0.0) for k in range(len(EX_TERMS))), F.lit(0.0))
    return marked.join(stats, "id").select("id", "start", F.round(score, 6).alias("score"))


@query("reading_mode", "SELECT doc_id AS id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN octet_length(encode(text)) <= 8000 THEN 'full' WHEN octet_length(encode(text)) + 120 > 8000 AND NOT regexp_matches(text, '\\n\\s*\\n') THEN 'too_large' ELSE 'sections' END AS mode FROM documents".replace("\\\\", "\\"))
def reading_mode(spark, d):
    return P.reading_plan(documents(spark, d), QUESTION, 8000).select("id", "n_bytes", "mode")


@query("reading_spans")
def reading_spans(spark, d):
    lined = documents(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return P.reading_plan(lined, QUESTION, 8000, most=1500).select("id", "mode", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))


@query(
    "quote_bind",
    r"WITH q AS (SELECT item_id, regexp_replace(text, '\s+', '', 'g') AS k FROM benchmark), t AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS x FROM documents) SELECT doc_id AS id, item_id AS quote_id FROM t JOIN q ON length(k) >= 12 AND contains(x, k)",
)
def quote_bind(spark, d):
    return P.candidate_quotes(documents(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")))


@query("quote_spans")
def quote_spans(spark, d):
    return P.bind_quotes(documents(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")))


@query("content_hash", "SELECT doc_id AS id, sha256(text) AS sha FROM documents")
def content_hash(spark, d):
    return documents(spark, d).select("id", F.sha2("text", 256).alias("sha"))


@query("chunk_text")
def chunk_text(spark, d):
    return P.chunk_text(documents(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))


@query("chunk_overlap", """WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ord FROM documents)
SELECT id, ord::BIGINT AS ord, right(lag(line) OVER (PARTITION BY id ORDER BY ord), 100) AS before FROM l""")
def chunk_overlap(spark, d):
    """The end of the line before, by its place in the text's own array of lines."""
    lines = documents(spark, d).select("id", F.split("text", "\n").alias("lines"))
    each = lines.select("id", F.posexplode(F.transform("lines", lambda x, i: F.when(i > 0, F.right(F.get("lines", i - 1), F.lit(100))))).alias("ord", "before"))
    return each.select("id", (F.col("ord") + 1).cast("bigint").alias("ord"), "before")


@query("chunk_markdown")
def chunk_markdown(spark, d):
    return P.chunk_markdown(documents(spark, d).withColumn("text", F.regexp_replace("text", "\n", "\n\n## ")))


@query("session_chunks")
def session_chunks(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return P.chunk_text(turns)


@query("parent_spans")
def parent_spans(spark, d):
    return P.parent_spans(documents(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))


@query("document_excerpt")
def document_excerpt(spark, d):
    return P.document_excerpt(documents(spark, d), "ing tion oned", 6000)
