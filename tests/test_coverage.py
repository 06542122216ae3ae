"""Coverage cells, grounded candidates, and rules of reports: a row for each rung."""

from pyspark.sql import Row

from evidentia.operators import coverage as C
from evidentia.operators import reports as R


def test_cells_need_an_audit_a_full_text_and_direct_evidence(spark):
    claims = spark.createDataFrame([(1, "first"), (2, "second")], "claim_id int, claim string")
    audit = spark.createDataFrame([(1, "audited", None, "paper_fulltext", ["uses"]), (2, "audited", "deterministic_fallback", "paper_fulltext", []), (3, "open", None, "paper_fulltext", []), (4, "audited", "x", "abstract", []), (5, "audited", "x", "paper_fulltext", None)], "paper_id int, status string, mode string, source_type string, relations array<string>")
    said = [(p, 1, 0, "covered", [10, 11, 11], "because") for p in (1, 2, 3, 4)] + [(5, 1, 0, "partially_covered", [51, 52], " "), (5, 2, 1, "contradicted", [52], None), (5, 9, 2, "covered", [51], ""), (1, 2, 1, "not_relevant", [10], ""), (1, 2, 2, "covered", [], "")]
    assessments = spark.createDataFrame(said, "paper_id int, claim_id int, ord int, verdict string, evidence_ids array<int>, reason string")
    evidence = spark.createDataFrame([(p, e, "direct_fulltext") for p in (1, 2, 3, 4) for e in (10, 12)] + [(1, 11, "abstract"), (5, 51, "direct_fulltext"), (5, 52, "direct_fulltext")], "paper_id int, evidence_id int, level string")
    cells = C.cells(claims, audit, assessments, evidence)
    got = {(r.claim_id, r.paper_id): (r.relations, r.coverage, r.evidence_ids, r.verdict, r.reason) for r in cells.collect()}
    assert got == {(1, 1): (["uses"], "direct", [10], "covered", "because"), (1, 5): (["other"], "partial", [51, 52], "partially_covered", "first"), (2, 5): (["other"], "direct", [52], "contradicted", "second")}
    assert {(r.paper_id, tuple(r.claim_ids), tuple(r.evidence_ids)) for r in C.records(cells).collect()} == {(1, (1,), (10,)), (5, (1, 2), (51, 52))}


CANDIDATE = "run int, ord int, origin string, gap_id string, name string, status string, basis string, contribution string, nearest array<struct<paper_id: int, difference: string>>, evidence array<struct<paper_id: int, evidence_ids: array<int>>>"


def candidate(ord_, origin="gaps", gap_id=None, name=None, status="supported_candidate", basis="b", contribution="c", nearest=((1, "differs"),), evidence=((1, (11, 10)),)):
    return (1, ord_, origin, gap_id, name, status, basis, contribution, [Row(paper_id=p, difference=x) for p, x in nearest], [Row(paper_id=p, evidence_ids=list(e)) for p, e in evidence])


def test_candidates_keep_what_holds(spark):
    rows = [
        candidate(0, gap_id="good", nearest=((9, "x"), (1, "differs"), (2, " ")), evidence=((1, (11, 10, 99)), (9, (10,)), (2, (10,)))),
        candidate(1, gap_id="no-near", nearest=((9, "unknown"),)), candidate(2, gap_id="no-evidence", evidence=((1, (77,)),)), candidate(3, gap_id="bare", basis=None, contribution=" "), candidate(4, gap_id="weak", status="insufficient_evidence"),
        candidate(5, name="only a name"), candidate(6), candidate(7), candidate(8, gap_id="good"),
        candidate(0, "provisional_gaps", gap_id="later"), candidate(0, "rejected_gaps", gap_id="later"), candidate(1, "rejected_gaps", gap_id="gone"), candidate(9, "elsewhere", gap_id="z"),
    ]
    known = spark.createDataFrame([(1, 1, [10, 11]), (1, 2, [20]), (2, 9, [10])], "run int, paper_id int, evidence_ids array<int>")
    out = C.ground(spark.createDataFrame(rows, CANDIDATE), known).collect()
    got = {(r.origin, r.ord): (r.gap_id, r.bucket, r.status, r.notes) for r in out}
    assert got == {
        ("gaps", 0): ("good", "gaps", "narrow_candidate", []), ("gaps", 1): ("no-near", "provisional_gaps", "insufficient_evidence", ["no_nearest_work"]), ("gaps", 2): ("no-evidence", "provisional_gaps", "insufficient_evidence", ["no_evidence"]),
        ("gaps", 3): ("bare", "provisional_gaps", "insufficient_evidence", ["no_basis", "no_contribution"]), ("gaps", 4): ("weak", "provisional_gaps", "insufficient_evidence", []), ("gaps", 5): ("candidate_6", "gaps", "narrow_candidate", []),
        ("gaps", 6): ("candidate_7", "gaps", "narrow_candidate", []), ("gaps", 7): ("candidate_7", "gaps", "narrow_candidate", []), ("provisional_gaps", 0): ("later", "provisional_gaps", "insufficient_evidence", []), ("rejected_gaps", 1): ("gone", "rejected_gaps", "rejected", []),
    }
    first = next(r for r in out if r.gap_id == "good")
    assert [tuple(x) for x in first.nearest] == [(1, "differs")] and [tuple(x) for x in first.evidence] == [(1, [10, 11])]


def test_a_name_is_in_one_bucket(spark):
    rows = [candidate(0, "provisional_gaps", gap_id="a"), candidate(0, "rejected_gaps", gap_id="a"), candidate(1, "rejected_gaps", gap_id="b"), candidate(0, "gaps", gap_id="b"), candidate(3, "provisional_gaps", gap_id="c")]
    got = {(r.gap_id, r.origin, r.status) for r in C.consistent(spark.createDataFrame(rows, CANDIDATE)).collect()}
    assert got == {("a", "rejected_gaps", "rejected"), ("b", "gaps", "supported_candidate"), ("c", "provisional_gaps", "insufficient_evidence")}


def test_every_rule_of_reports(spark):
    pad = "x" * 300
    good = f"## One\n{pad} [1]\n## Two\nend [2]"
    cases = [(good, [1, 2], []), ("short", [1], ["too_short"]), (None, None, ["too_short"]), (good + " claim_7", [1, 2], ["inner_data"]), (good + " is eligible now", [1, 2], ["inner_fields"]), (good + " uneligible", [1, 2], []), (good + "[9]", [1, 2], ["unknown_citation"]), (f"## One\n## Two\n{pad}", [1], ["no_citation"]), (f"## One\n## Two\n{pad}", None, []), (f"## Two\n## One\n{pad}[1]", [1], ["order"]), (f"## One\n{pad}[1]\n## Bad", [1], ["missing:Two", "unwanted:Bad"])]
    df = spark.createDataFrame([(k, t, s) for k, (t, s, _) in enumerate(cases)], "k int, text string, sources array<bigint>")
    got = {r.k: r.errors for r in R.validate_reports(df, ["One", "Two"], ["Bad"]).collect()}
    assert [got[k] for k in range(len(cases))] == [c[2] for c in cases]


def test_every_rule_of_revisions(spark):
    old = "# T\n" + "y" * 90 + " [1] https://a.example/x\n## References\n[1] a [2] b"
    new = "# T\n" + "z" * 90
    cases = [(new + "[2]", old, []), ("short", old, ["too_short"]), (new + "[3][1]", old, ["unknown_citation"]), (new, old, ["lost_citations"]), (new, "# T no citations\n## References\n[1] a", []), (new + "[1] paper_id", old, ["inner_data"]), (new[2:] + "[1]", old, ["no_title"]), (new + "[1]\n## references\n", old, ["references"]), (new + "[1] https://b.example", old, ["new_link"]), (new + "[1] (https://a.example/x)", old, [])]
    df = spark.createDataFrame([(k, t, o) for k, (t, o, _) in enumerate(cases)], "k int, text string, original string")
    got = {r.k: r.errors for r in R.validate_revisions(df).collect()}
    assert [got[k] for k in range(len(cases))] == [c[2] for c in cases]
