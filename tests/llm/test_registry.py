"""The queries that SQL expresses, beside their SQL on a small scale; the others run and return a row a document."""

import pytest

from evidentia.llm import registry
from tests.test_queries import DATA, con, pytestmark, rows_of  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, con, name):  # noqa: F811
    df = registry.QUERIES[name](spark, DATA)
    want = con.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall())
