"""Dates of updates, groups of a last run, evidence that still holds, and models found by their whole name."""

from evidentia.operators import catalog as C
from evidentia.operators import numeric as N
from evidentia.operators import passages as P


def test_first_hand_dates_stay(spark):
    """old date and source, new date and source, what is kept."""
    cases = [
        (None, None, "2020", "x", "2020", "x"), ("2019", "y", "", None, "2019", "y"), ("2019", "y", "2020-01-02", None, "2020-01-02", "y"), ("2019-01-02", "arxiv", "2020-01-02", "x", "2019-01-02", "arxiv"), ("2019-01-02", "arxiv_page", "2020", "arxiv", "2019-01-02", "arxiv_page"),
        ("2019-01", "arxiv", "2020", "arxiv", "2020", "arxiv"), ("2019-01-02", "crossref", "2020", "x", "2020", "x"), ("", "arxiv", "2020", None, "2020", "arxiv"), ("2019-01-02", "arxiv", None, None, "2019-01-02", "arxiv"),
    ]
    shape = "id int, publication_date string, date_source string"
    old = spark.createDataFrame([(k, *c[:2]) for k, c in enumerate(cases)] + [(90, "2001", "z")], shape)
    new = spark.createDataFrame([(k, *c[2:4]) for k, c in enumerate(cases)] + [(91, "2002", "z")], shape)
    got = {r.id: (r.publication_date, r.date_source) for r in C.upsert_dates(old, new).collect()}
    assert got == {k: c[4:] for k, c in enumerate(cases)} | {90: ("2001", "z"), 91: ("2002", "z")}


def test_pending_groups_are_new_or_changed(spark):
    now = spark.createDataFrame([("a", 1, 5), ("b", 2, 6), ("c", 3, 7)], "key string, n int, digest int")
    last = spark.createDataFrame([("a", 5), ("b", 9), ("gone", 1)], "key string, digest int")
    assert {r.key for r in C.pending_groups(now, last, "key").collect()} == {"b", "c"}


def test_evidence_is_bound_by_digest_and_place(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    docs = spark.createDataFrame([(1, "a 𝔊 quote  here"), (2, None)], "id int, text string")
    rows = [(1, 2, 9, "𝔊 quote", sha("a 𝔊 quote  here")), (1, 4, 15, "quote here", sha("a 𝔊 quote  here")), (1, 3, 9, "𝔊 quote", sha("a 𝔊 quote  here")), (1, 2, 9, "𝔊 quote", sha("older")), (2, 0, 0, "", sha("")), (3, 0, 1, "a", sha("a"))]
    got = P.still_bound(spark.createDataFrame(rows, "id int, start int, end int, quote string, sha256 string"), docs).collect()
    assert sorted((r.id, r.start, r.sha256 == sha("older"), r.bound) for r in got) == sorted([(1, 2, False, True), (1, 4, False, True), (1, 3, False, False), (1, 2, True, False), (2, 0, False, False), (3, 0, False, False)])


def test_models_match_whole_leading_names(spark):
    models = spark.createDataFrame([(1, "Alpha [3]"), (2, "Fast-Alpha"), (3, ""), (4, "**alpha**")], "id int, model string")
    titles = spark.createDataFrame([(10, "Alpha: a study"), (9, "ALPHA：other"), (11, "Alpha beta: x"), (12, None), (13, "")], "id int, title string")
    assert {tuple(r) for r in N.resolved_models(models, titles).collect()} == {(1, 9, 2), (4, 9, 2)}
