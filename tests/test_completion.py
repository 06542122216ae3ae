"""Admission against a plain loop, and research in rounds."""

import random

import numpy as np
import pytest

from evidentia.operators import admission as A
from evidentia.operators import completion as C


def plain(members, newcomers, cap):
    papers, admitted = [list(m) for m in sorted(members, key=lambda m: m[1])], []
    for i, o, s in sorted(newcomers, key=lambda n: n[1]):
        s = 0.5 if s is None else s
        if len(papers) + len(admitted) < cap:
            admitted.append((i, o, None))
            continue
        may = [p for p in papers if not p[3]]
        weakest = min(may, key=lambda p: 0.5 if p[2] is None else p[2], default=None)
        if weakest and s > (0.5 if weakest[2] is None else weakest[2]):
            papers.remove(weakest)
            admitted.append((i, o, weakest[0]))
    return sorted(admitted)


@pytest.mark.parametrize("cap, n, m", [(10, 10, 200), (14, 10, 60), (10, 10, 3), (5, 10, 80), (10, 0, 30), (0, 0, 10)])
def test_admission_equals_a_plain_loop(spark, cap, n, m):
    r = random.Random(cap * 100 + m)
    score = lambda: r.choice([None, *(round(r.random(), 1) for _ in range(6))])
    members = [(k, k, score(), r.random() < 0.3) for k in range(n)]
    newcomers = [(1000 + k, k, score()) for k in range(m)]
    mem = spark.createDataFrame(members, "id bigint, ord bigint, score double, fixed boolean")
    got = A.admit(mem, spark.createDataFrame(newcomers, "id bigint, ord bigint, score double").repartition(3), cap)
    want = plain(members, newcomers, cap)
    assert sorted(map(tuple, got.collect())) == want
    stays = {i for i, *_ in members} - {x for _, _, x in want} | {i for i, _, _ in want}
    assert {x.id for x in A.admitted_set(mem, got).collect()} == stays


def test_summaries_chain():
    r = np.random.default_rng(1)
    weakest, scores = np.sort(r.random(20).round(1)), r.random(500).round(2)
    whole = A.summary(scores, weakest)
    a, b = A.summary(scores[:130], weakest), A.summary(scores[130:], weakest)
    assert (b[a] == whole).all()


def test_more_members_than_a_state_may_have_are_refused(spark):
    rows = spark.createDataFrame([], "id bigint, ord bigint, score double, fixed boolean")
    with pytest.raises(ValueError, match="at most"):
        A.admit(rows, rows, A.MOST + 1)


@pytest.fixture
def research(spark):
    make = spark.createDataFrame
    return C.Research(
        papers=make([(1,), (2,), (3,)], "id bigint"),
        profiles=make([(1, None), (2, "broken")], "id bigint, error string"),
        audits=make([(1, "audited", None)], "id bigint, status string, mode string"),
        planned=make([(0, "done before"), (1, "first"), (2, " ")], "ord bigint, query string"),
        executed=make([("done before",)], "query string"),
        requested=make([(0, 3), (1, 99)], "ord bigint, id bigint"),
        opens=make([(5, "second", 10), (6, "never", 77)], "ord bigint, query string, id bigint"),
    )


RESULTS = [("first", 0, 1), ("first", 1, 10), ("first", 2, 11), ("second", 0, 20), ("second", 1, 11), ("done before", 0, 66)]


def logged(log):
    return {(r.round, r.action, r.what, r.n) for r in log.collect()}


def test_the_second_round_works_on_what_the_first_opened(spark, research):
    results = spark.createDataFrame(RESULTS, "query string, ord bigint, id bigint")
    done, log = C.complete(research, results, spark.createDataFrame([(2,), (10,), (20,)], "id bigint"))
    first = {(1, "search", "first", 3), (1, "admit", "10", 1), (1, "admit", "11", 1), (1, "again", "3", 1), (1, "again", "2", 1), (1, "read", "2", 1), (1, "read", "10", 1), (1, "failed", "11", 1), (1, "failed", "3", 1)}
    second = {(2, "search", "second", 2), (2, "admit", "20", 1), (2, "again", "11", 1), (2, "read", "20", 1), (2, "failed", "11", 1)}
    assert logged(log) == first | second
    assert {r.id for r in done.papers.collect()} == {1, 2, 3, 10, 11, 20}
    assert {(r.id, r.error) for r in done.profiles.collect()} == {(1, None), (2, None), (3, "unreadable"), (10, None), (11, "unreadable"), (20, None)}
    assert {(r.kind, r.what) for r in C.still_open(done).collect()} == {("extraction_failed", "3"), ("extraction_failed", "11"), ("not_reviewed", "2"), ("not_reviewed", "10"), ("not_reviewed", "20")}


def test_caps_end_the_work(spark, research):
    results = spark.createDataFrame(RESULTS, "query string, ord bigint, id bigint")
    none = spark.createDataFrame([], "id bigint")
    _, log = C.complete(research, results, none, C.Limits(rounds=1, new=1, again=1))
    assert logged(log) == {(1, "search", "first", 3), (1, "admit", "10", 1), (1, "again", "3", 1), (1, "failed", "3", 1), (1, "failed", "10", 1)}
    _, log = C.complete(research, results, none, C.Limits(new_in_all=1))
    assert {x for x in logged(log) if x[1] == "admit"} == {(1, "admit", "10", 1)}


def test_nothing_open_is_no_work(spark, research):
    empty = spark.createDataFrame([], "ord bigint, query string")
    research.papers = spark.createDataFrame([(1,)], "id bigint")
    research.planned = empty
    _, log = C.complete(research, spark.createDataFrame([], "query string, ord bigint, id bigint"), research.papers)
    assert log.count() == 0
