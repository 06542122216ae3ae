"""Every query of the library beside its SQL on a small scale, as far as the data are there."""

import datetime
import hashlib
import itertools
import os

import duckdb
import pandas as pd
import pytest

from evidentia.plans.all import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return "NULL"
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, list):
        return "[" + ",".join(map(cell, x)) + "]"
    return x.isoformat() if hasattr(x, "isoformat") else str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


def texts(con):
    return dict(con.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def tight(text):
    return "".join(text.split())


def check_hybrid(con, rows):
    known = texts(con)
    assert [r.rank for r in sorted(rows, key=lambda r: r.rank)] == list(range(1, len(rows) + 1)) and len(rows) <= 6
    assert all(0 <= r.start < r.end <= len(known[r.id]) and r.sha == hashlib.sha256(known[r.id].encode()).hexdigest() for r in rows)
    assert all(a.rrf >= b.rrf for a, b in itertools.pairwise(sorted(rows, key=lambda r: r.rank)))


def check_recall(con, rows):
    truth = {r[0] for r in con.sql(ORACLES["vector_topk"]).fetchall()}
    assert len({r.id for r in rows} & truth) >= 0.9 * len(truth)


def check_rounds(con, rows):
    assert {r.round for r in rows} <= {1, 2}
    for k in (1, 2):
        of = lambda action: sum(r.round == k and r.action == action for r in rows)  # noqa: B023, E731
        assert of("search") <= 6 and of("admit") <= 8 and of("again") <= 8 and of("read") + of("failed") <= 16


def check_quotes(con, rows):
    known, quotes = texts(con), dict(con.sql("SELECT item_id, text FROM benchmark").fetchall())
    assert all(tight(known[r.id][r.start : r.end]) == tight(quotes[r.quote_id]) for r in rows)
    assert len(rows) == con.sql(ORACLES["quote_bind"]).fetchall().__len__()


def check_excerpts(con, rows):
    known = texts(con)
    assert all(len(r.excerpt) <= 6000 and (r.excerpt == known[r.id]) == (len(known[r.id]) <= 6000) for r in rows if r.excerpt is not None)


def check_groups(con, rows):
    assert all(r.group_id <= r.id for r in rows) and {r.group_id for r in rows} <= {r.id for r in rows if r.id == r.group_id} and len(rows) == len({r.id for r in rows})


#: What holds for the rows of queries that have no SQL; of the others, that there are any.
CHECKS = {"chunk_hybrid_search": check_hybrid, "vector_index_search": check_recall, "completion_rounds": check_rounds, "quote_spans": check_quotes, "document_excerpt": check_excerpts, "dedup_groups": check_groups}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    found = df.collect()
    got = rows_of(df.columns, [tuple(r) for r in found])
    if name not in ORACLES:
        assert found
        CHECKS.get(name, lambda con, rows: None)(con, found)
    else:
        want = con.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows_of(want.columns, want.fetchall())


def beside_sql(spark, folder, name, table, rows, schema):
    """A query's rows and those of its SQL over a table of its own."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    own = duckdb.connect()
    own.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df, want = QUERIES[name](spark, str(folder)), own.sql(ORACLES[name])
    return rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(want.columns, want.fetchall())


def test_access_pages_at_the_limits(spark, tmp_path):
    rows = [(8200, "x" * 4999), (8250, "x" * 4985), (8300, "x" * 5000), (8350, "  " + "x" * 4999 + "   "), (45200, "y" * 9000), (50, "  "), (100, None), (78, None), (3, None), (4, " "), (150, "abc"), (5, "z" * 6000)]
    got, want = beside_sql(spark, tmp_path, "access_page_reject", "documents", rows, "doc_id bigint, text string")
    assert got == want


def test_pieces_of_odd_hours_and_missing_parts(spark, tmp_path):
    at = lambda *x: datetime.datetime(*x)
    rows = [(3, at(1969, 12, 31, 23, 30), 1, "b"), (2, at(1970, 1, 1, 0, 30), 1, "a"), (None, at(2024, 1, 1), 2, "z"), (5, at(2024, 1, 1), 2, "y"), (6, at(2024, 1, 1), 3, None), (7, at(2024, 1, 1), 4, ""), (8, None, 4, "n")]
    got, want = beside_sql(spark, tmp_path, "delta_coalesce", "events", rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string")
    assert got == want


def test_pieces_of_the_last_half_millisecond_and_of_equal_ids(spark, tmp_path):
    hour = datetime.datetime(2024, 1, 1, 5)
    last = [datetime.timedelta(microseconds=us) for us in (-501, -500, -1, 0, 499, 500)]
    rows = [(k, hour + us, 1, f"{k}") for k, us in enumerate(last)] + [(10 + k, datetime.datetime(1970, 1, 1, 1) + us, 2, f"{k}") for k, us in enumerate(last)]
    rows += [(20 + k, datetime.datetime(1969, 12, 31, 23) + us, 3, f"{k}") for k, us in enumerate(last)]
    rows += [(40, hour, 4, x) for x in "zayb"] + [(None, hour, 4, x) for x in "xcw"]
    got, want = beside_sql(spark, tmp_path, "delta_coalesce", "events", rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string")
    assert got == want


def test_frequent_keys_on_both_sides_make_no_pairs(spark, tmp_path):
    ids = [*range(0, 1_200_000, 6000), *range(1, 40)]
    docs = spark.createDataFrame([(k, f"text {k}", "en", "s", 6) for k in ids], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(6000, 1, 0)], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    own = duckdb.connect()
    for t in ("documents", "labels"):
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df, want = QUERIES["hydrate_or_join"](spark, str(tmp_path)), own.sql(ORACLES["hydrate_or_join"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 1 and "Relation [doi" in plan  # an id is looked up only; what is known of a key was written as one row
