"""Versions, racing writers, fencing tokens and upserts that rewrite what they touch."""

import threading

import pytest

from evidentia.operators import catalog
from evidentia.sources import versions as V

SCHEMA = "id bigint, title string"


def found(spark, folder, version=None):
    return {r.id: r.title for r in V.rows_of(spark, folder, version).collect()}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert V.latest(spark, folder).number == -1 and V.rows_of(spark, folder) is None
    first = V.upsert(spark.createDataFrame([(k, f"a{k}") for k in range(50)], SCHEMA), folder, ["id"], buckets=8)
    second = V.upsert(spark.createDataFrame([(3, "new"), (99, "more")], SCHEMA), folder, ["id"])
    assert found(spark, folder) == {k: f"a{k}" for k in range(50)} | {3: "new", 99: "more"}
    assert found(spark, folder, first) == {k: f"a{k}" for k in range(50)}
    changed = [b for b, p in second.state["buckets"].items() if first.state["buckets"].get(b) != p]
    assert 1 <= len(changed) <= 2 and len(second.state["buckets"]) == 8


def test_of_two_writers_that_saw_the_same_version_one_is_refused(spark, tmp_path):
    folder = str(tmp_path / "t")
    seen = V.upsert(spark.createDataFrame([(1, "a")], SCHEMA), folder, ["id"], buckets=2)
    outcomes = []

    def write(name):
        try:
            V.upsert(spark.createDataFrame([(1, name)], SCHEMA), folder, ["id"], after=seen)
            outcomes.append(("done", name))
        except V.Conflict:
            outcomes.append(("refused", name))

    write("x")
    write("y")
    assert outcomes == [("done", "x"), ("refused", "y")] and found(spark, folder) == {1: "x"}
    outcomes.clear()
    seen = V.latest(spark, folder)
    both = [threading.Thread(target=write, args=(n,)) for n in "pq"]
    [t.start() for t in both]
    [t.join() for t in both]
    winners = [n for how, n in outcomes if how == "done"]
    assert len(winners) == 1 and found(spark, folder) == {1: winners[0]}


def test_a_lower_token_is_fenced_off(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = lambda x: spark.createDataFrame([(1, x)], SCHEMA)
    old = V.upsert(rows("a"), folder, ["id"], token=1)
    V.upsert(rows("b"), folder, ["id"], token=2)
    with pytest.raises(V.Fenced):
        V.upsert(rows("c"), folder, ["id"], token=1)
    with pytest.raises(V.Fenced):
        V.commit(spark, folder, old, old.state, token=1)
    assert found(spark, folder) == {1: "b"}


def test_a_rule_merges_old_and_new(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), "id bigint, title string, status string, fulltext_path string, parsed_path string"
    make = lambda *r: spark.createDataFrame(r, schema)
    V.upsert(make((1, "a", "parsed", "f", "p"), (2, "b", None, None, None)), folder, ["id"], catalog.upsert, buckets=2)
    V.upsert(make((1, "new", "metadata_only", None, None)), folder, ["id"], catalog.upsert)
    assert sorted(map(tuple, V.rows_of(spark, folder).collect())) == [(1, "new", "parsed", "f", "p"), (2, "b", "metadata_only", None, None)]


def test_empty_upsert(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert V.upsert(spark.createDataFrame([], SCHEMA), folder, ["id"]).number == 0
    assert found(spark, folder) == {}
