"""The operators as SQL functions."""

import pytest

from evidentia.functions import sql
from evidentia.operators import passages as P
from evidentia.operators import retrieval as R


def test_functions_equal_the_operators(spark):
    assert set(sql.register(spark)) == {"term_count", "bm25_part", "content_stamp", "token_chunks", "markdown_chunks", "quote_span"}
    rows = [(1, "# One\n" + "graph of a graph " * 60), (2, None), (3, "x  long enough\nquote here 𝔊"), (4, "")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    df.createOrReplaceTempView("sql_docs")
    got = spark.sql("SELECT id, c.* FROM sql_docs, LATERAL token_chunks(text, size => 10, step => 8) c").collect()
    want = [(i, k, s, e, sec, c) for i, t in rows if t for k, s, e, _, _, sec, c in P.token_windows(t, P.word_offsets(t), 10, 8)]
    assert sorted(map(tuple, got)) == sorted(want)
    parts = spark.sql("SELECT id, m.* FROM sql_docs, LATERAL markdown_chunks(text) m").collect()
    assert sorted(map(tuple, parts)) == sorted((i, k, s, c) for i, t in rows for k, (s, c) in enumerate(P.markdown_chunks(t or "")))
    spans = spark.sql("SELECT id, q.* FROM sql_docs, LATERAL quote_span(text, 'long enough quote here') q").collect()
    assert [(r.id, rows[2][1][r.start : r.end]) for r in spans] == [(3, "long enough\nquote here")]
    scores = spark.sql("WITH t AS (SELECT id, term_count(text, 'Graph') AS tf, CAST(greatest(length(text) - 2, 0) AS DOUBLE) AS dl FROM sql_docs), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS mean, CAST(count_if(tf > 0) AS DOUBLE) AS df FROM t) SELECT id, bm25_part(tf, df, n, dl, mean) AS score FROM t, s WHERE tf > 0").collect()
    assert [(r.id, round(r.score, 9)) for r in scores] == [(r.id, round(r.score, 9)) for r in R.bm25(df, ["graph"]).collect()]
    assert spark.sql("SELECT content_stamp(NULL) = sha2('', 256)").first()[0]


def test_wrong_arguments_are_refused_when_planned(spark):
    sql.register(spark)
    for bad in ("SELECT * FROM token_chunks(5)", "SELECT * FROM token_chunks('a b', size => 0)", "SELECT * FROM quote_span('a', 5)"):
        with pytest.raises(Exception, match="must be"):
            spark.sql(bad).collect()
