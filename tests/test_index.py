"""The stored index against a scan, stale sources, comparison rules and embeddings."""

import random

import numpy as np
from pyspark.sql import functions as F

from evidentia.operators import index as X
from evidentia.operators import numeric as N
from evidentia.operators import passages as P
from evidentia.operators import retrieval as R
from evidentia.operators import segments as S


def test_search_equals_a_scan_and_reads_own_postings(spark, tmp_path):
    r = random.Random(4)
    words = ["graph", "Graphs", "stereo", "depth", "ab", "loss", "zz", "monograph"]
    docs = spark.createDataFrame([(k, " ".join(r.choices(words, k=r.randrange(0, 12)))) for k in range(60)] + [(99, None), (98, "")], "id bigint, text string")
    folder = str(tmp_path / "index")
    X.build(docs, folder, per_bucket=8)
    full = docs.withColumn("text", F.coalesce("text", F.lit("")))
    for terms in (["graph", "loss"], ["Stereo depth"], ["ab"], ["nowhere"], []):
        want = {x.id: round(x.score, 9) for x in R.bm25(full, terms).collect()} if [t for t in terms if len(t) > 2] else {}
        assert {x.id: round(x.score, 9) for x in X.search(spark, folder, terms).collect()} == want
    scope = docs.where("id < 10").select("id")
    assert {x.id for x in X.search(spark, folder, ["graph"], scope).collect()} == {x.id for x in R.bm25(full, ["graph"]).collect() if x.id < 10}
    plan = spark._jvm.PythonSQLUtils.explainString(S.term_counts(spark, folder, ["graph"])._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_stale_sources_are_named_and_a_new_generation_replaces_the_old(spark, tmp_path):
    folder = str(tmp_path / "index")
    make = lambda *rows: spark.createDataFrame(rows, "id bigint, text string")
    X.build(make((1, "one text"), (2, "two text"), (3, "three")), folder, per_bucket=4)
    now = make((1, "one text"), (2, "other"), (4, "four text"))
    assert {(r.id, r.state) for r in X.stale(now, folder).collect()} == {(2, "changed"), (3, "gone"), (4, "missing")}
    X.build(now, folder, per_bucket=4)
    assert X.stale(now, folder).count() == 0 and {r.id for r in X.search(spark, folder, ["text"]).collect()} == {1, 4}


def test_best_reported_values_keep_ties_and_notes(spark):
    rows = [
        ("acc", "Set", "EPE", "p1", 0.5, True, "a"), ("acc", "Set (test set)", "EPE (px)", "p2", 0.5, True, "b"), ("acc", "set", "epe", "p1", 0.6, True, "c"),
        ("acc", "Set", "Time (ms)", "", 9.0, True, "d"), ("acc", "Set", "Time (s)", "", 1.0, True, "e"), ("acc", "Set", "EPE", "p1", 0.1, False, "f"), ("acc", "Set", "EPE", "p1", float("nan"), True, "g"), ("fast", "Set", "EPE", None, 0.9, True, "h"),
    ]
    df = spark.createDataFrame(rows, "grp string, dataset string, metric string, protocol string, value double, eligible boolean, model string")
    best = lambda **k: {r.model for r in N.reported_best(df, **k).collect()}
    assert best() == {"a", "b", "d", "e", "h"} and best(controlled=True) == {"a", "b", "d", "e", "h"} and best(lower_is_better=False) == {"c", "d", "e", "h"}
    assert N.reported_best(df.withColumn("protocol", F.when(F.col("model") == "c", "own").otherwise(F.col("protocol"))), controlled=True).where("model = 'c'").count() == 1


def test_first_reason_against_a_row(spark):
    rows = [(1, False, "proposed", "in_scope", "g"), (2, True, "baseline", "in_scope", "g"), (3, True, "proposed", "date_unconfirmed", "g"), (4, True, "proposed", "in_scope", "g"), (5, True, "proposed", "in_scope", "g"), (6, True, "proposed", "in_scope", "g"), (7, True, "proposed", "in_scope", "g"), (8, True, "proposed", "unrestricted", "g"), (9, True, "proposed", "outside_scope", "old")]
    reviews = [(5, False, True, None), (6, True, False, None), (7, True, True, "other"), (8, True, True, "G!"), (9, True, True, "")]
    got = N.eligibility(spark.createDataFrame(rows, "row_id int, source_bound boolean, role string, scope string, grp string"), spark.createDataFrame(reviews, "row_id int, scope_match boolean, group_verified boolean, grp string"), ["g", "old"], ["old"])
    assert {r.row_id: r.reason for r in got.collect()} == {1: "unbound", 2: "not_proposed", 3: "date_unconfirmed", 4: "not_reviewed", 5: "out_of_scope", 6: "group_unverified", 7: "unknown_group", 8: "", 9: ""}


def test_any_function_embeds(spark):
    docs = spark.createDataFrame([(1, "aab"), (2, None), (3, "b")], "id bigint, text string")
    got = {r.id: np.round(r.vector, 4).tolist() for r in R.embedded(docs, lambda texts: [[t.count("a"), t.count("b")] for t in texts], 2).collect()}
    assert got == {1: [0.8944, 0.4472], 2: [0.0, 0.0], 3: [0.0, 1.0]}


def test_sections_keep_headings():
    text = "intro\n# One\ntext of one\n## Two\n" + "long " * 400
    got = P.markdown_chunks(text)
    assert [h for h, _ in got][:3] == ["", "One", "Two"] and "".join(c for _, c in got).count("long") >= 400
