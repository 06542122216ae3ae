"""Every rung of the review rules and of the job queue, against small tables."""

import random

from pyspark.sql import functions as F

from evidentia.operators import catalog as C
from evidentia.operators import jobs as J
from evidentia.operators import review as R

GAPS = "gap_id bigint, status string, confidence string, novelty_basis string, nearest array<struct<paper_id: bigint, difference: string>>, baselines string, change string, metrics string, stops string"


def run(spark, cells=(("covered", 1),), audits=((1, "audited", "question"), (2, "audited", "question")), records=None, fulltexts=((1, True), (2, False))):
    make = spark.createDataFrame
    known = make([*records], "paper_id bigint, basis string, level string, n_evidence int") if records is not None else None
    return R.run_state(make([*fulltexts], "paper_id bigint, has_fulltext boolean"), make([*cells], "state string, paper_id bigint"), make([*audits], "paper_id bigint, status string, mode string"), known)


def test_every_rung_of_the_gate(spark):
    profiles = spark.createDataFrame([(1, True), (2, False)], "paper_id bigint, has_fulltext boolean")
    ok = ("b", "c", "m", "s")
    rows = [
        (1, "supported_candidate", "0.9", "basis", [(1, "differs")], *ok),
        (2, "narrow_candidate", "0.9", "basis", [(1, "differs")], *ok),
        (3, "supported_candidate", "0.9", "basis", [(2, "differs")], *ok),
        (4, "supported_candidate", "no", "basis", [(2, "x"), (1, "y")], *ok),
        (5, "Rejected", "0.9", "basis", [(1, "differs")], *ok),
        (6, "odd", "0.9", "basis", [(1, "differs")], *ok),
        (7, None, "0.9", "basis", [(1, "differs")], *ok),
        (8, "supported_candidate", "0.9", "basis", [(1, " "), (77, "differs")], *ok),
        (9, "supported_candidate", "0.9", " ", [(1, "differs")], *ok),
        (10, "supported_candidate", "0.9", "basis", [(1, "differs")], "b", None, "m", "s"),
        (11, "supported_candidate", "7", "basis", [(1, "differs")], *ok),
    ]
    df = spark.createDataFrame(rows, GAPS)
    got = {r.gap_id: (r.outcome, r.status, r.confidence, r.note) for r in R.gated(df, profiles, run(spark)).collect()}
    assert got[1] == ("accepted", "supported_candidate", 0.9, "") and got[2] == ("accepted", "narrow_candidate", 0.65, "")
    assert got[3] == ("accepted", "supported_candidate", 0.55, "no_fulltext") and got[4][2] == 0.0 and got[11][2] == 1.0
    assert got[5][0] == "rejected" and [got[k][3] for k in (6, 7, 8, 9, 10)] == ["status", "status", "no_nearest_work", "no_basis", "no_experiment"]
    assert all(got[k][:2] == ("provisional", "insufficient_evidence") for k in (6, 7, 8, 9, 10))
    note = lambda **k: {r.note for r in R.gated(df.where("gap_id = 1"), profiles, run(spark, **k)).collect()}
    assert note(cells=[]) == note(cells=[("covered", 9)]) == note(cells=[("open", 1)]) == {"no_matrix"}
    assert note(records=[]) == note(records=[(1, "other", "direct", 1)]) == {"no_matrix"} and note(records=[(1, "research_claims", "direct", 1)]) == {""}
    assert note(audits=[(1, "audited", "q")]) == {"unaudited"} and note(audits=[]) == {""}
    assert note(audits=[(1, "audited", "deterministic_fallback"), (2, "audited", "q")]) == {"fallback"}


def test_critic_by_id_or_name(spark):
    gaps = spark.createDataFrame([(k, f"n{k}", "supported_candidate", 0.9, k == 4) for k in range(1, 10)], "gap_id bigint, name string, status string, confidence double, contradicted boolean")
    reviews = spark.createDataFrame(
        [(1, 1, None, "accept", None, None), (2, 2, None, "Accept", 0.5, None), (3, None, "n3", "reject", None, None), (4, 4, None, "reject", 2.0, None), (5, 5, None, "revise", None, "narrower"), (6, 6, None, "revise", None, " "), (7, 7, None, "what", None, None), (8, 8, None, "reject", None, None), (9, 8, None, "accept", None, None)],
        "ord bigint, gap_id bigint, gap_name string, verdict string, cap double, revised string",
    )
    got = {r.gap_id: (r.outcome, r.status, r.confidence, r.revised) for r in R.criticised(gaps, reviews).collect()}
    weak = "insufficient_evidence"
    assert got == {1: ("accepted", "supported_candidate", 0.9, False), 2: ("accepted", "supported_candidate", 0.5, False), 3: ("rejected", weak, 0.9, False), 4: ("rejected", "contradicted", 0.9, False), 5: ("provisional", weak, 0.9, True), 6: ("provisional", weak, 0.9, False), 7: ("provisional", weak, 0.9, False), 8: ("accepted", "supported_candidate", 0.9, False), 9: ("provisional", "supported_candidate", 0.9, False)}


def test_verdicts_need_direct_evidence_of_their_paper(spark):
    evidence = spark.createDataFrame([(1, 11, R.DIRECT, "A teacher guides it."), (1, 12, "abstract", "teacher"), (2, 21, R.DIRECT, "No teacher is used. Loss falls; a student learns")], "paper_id bigint, evidence_id bigint, level string, quote string")
    claims = spark.createDataFrame([(1, 1, "covered", [12, 11, 21]), (1, 2, "covered", [12]), (1, 3, "odd", [11]), (2, 1, "not_relevant", None), (3, 1, "contradicted", [11])], "paper_id bigint, claim_id bigint, verdict string, evidence_ids array<bigint>")
    got = {(r.paper_id, r.claim_id): (r.verdict, r.evidence_ids, r.evidence_level) for r in R.grounded_verdicts(claims, evidence).collect()}
    weak, far = "insufficient_evidence", "abstract_or_inference"
    assert got == {(1, 1): ("covered", [12, 11], R.DIRECT), (1, 2): (weak, [12], far), (1, 3): (weak, [11], R.DIRECT), (2, 1): ("not_relevant", [], far), (3, 1): (weak, [], far)}
    facts = spark.createDataFrame([(1, "teacher", "T", [11, 12]), (2, "teacher", "T", [21]), (2, "student", "S", [21]), (2, "task", "x", [21]), (2, "empty", " ", [21])], "paper_id bigint, key string, value string, evidence_ids array<bigint>")
    proven = R.proven_facts(facts, evidence, {"teacher": "teacher", "student": "student"}, r"\b(?:no|not)\b")
    assert {(r.paper_id, r.key, tuple(r.evidence_ids)) for r in proven.collect()} == {(1, "teacher", (11,)), (2, "student", (21,)), (2, "task", (21,))}
    relations = spark.createDataFrame([(1, "distillation"), (2, "distillation"), (3, "other")], "paper_id bigint, relation string")
    assert {r.paper_id for r in R.unproven(relations, proven, "distillation", ["student", "task"]).collect()} == {1}


def test_ledger_and_what_is_left(spark):
    make = spark.createDataFrame
    papers = make([(k, "prior_knowledge" if k == 1 else None) for k in range(1, 11)], "id bigint, source_type string")
    profiles = make([(5, "bad", True, None), (6, None, True, None), (7, None, True, None), (8, None, True, None), (9, None, False, None), (10, None, True, "survey_or_repository")], "id bigint, error string, has_fulltext boolean, source_type string")
    audits = make([(7, "audited", "deterministic_fallback"), (8, "audited", "q"), (9, "audited", None), (6, "open", "q")], "id bigint, status string, mode string")
    got = {r.id: f"{r.status}:{r.reason}" for r in R.ledger(papers, profiles, audits.fillna("q"), make([(3,)], "id bigint"), make([(3,), (4,)], "id bigint")).collect()}
    assert got == {1: "excluded:background", 2: "not_analyzed:no_profile", 3: "not_analyzed:limit", 4: "not_analyzed:parse_failed", 5: "extraction_failed:profile_error", 6: "unassessed:no_audit", 7: "unassessed:fallback", 8: "fulltext:profile", 9: "abstract:profile", 10: "excluded:background"}
    left = {r.id: r.reason for r in R.pending_material(papers, profiles, audits).collect()}
    assert left == {**{k: "not_extracted" for k in (1, 2, 3, 4)}, 5: "extraction_failed", 6: "not_reviewed", 7: "not_reviewed", 10: "not_reviewed"}
    asked = make([(1, 8), (2, 5), (3, 8), (4, 99), (5, 2)], "ord bigint, id bigint")
    again = R.retry_selection(papers, asked, make([(9,), (5,)], "id bigint"), make([(2,), (5,)], "id bigint"), make([(1,)], "id bigint"), 3)
    assert [r.id for r in again.orderBy("place").collect()] == [5, 2, 8]
    planned = make([(1, "a"), (2, "b"), (3, "a"), (4, " "), (5, "c")], "ord bigint, query string")
    assert [r.query for r in R.next_queries(planned, make([("b",)], "query string"), 2).collect()] == ["a", "c"]


def test_facet_rules_with_all_forms(spark):
    rules = [C.FacetRule("time", "many", "multi", exclude_title="dataset"), C.FacetRule("time", "one", "single", only_if_empty=True), C.FacetRule("prior", "mono", "base model", require_title="stereo"), C.FacetRule("how", "full", "supervised", exclude="semi"), C.FacetRule("how", "full", "guided")]
    rows = [(1, "Multi frames", ["single"]), (2, "Multi dataset", ["single"]), (3, "Stereo", ["BASE model"]), (4, "Other", ["base model"]), (5, "Semi supervised", []), (6, "supervised and guided", None), (7, None, None)]
    df = spark.createDataFrame(rows, "id bigint, title string, tags array<string>")
    got = {r.id: (r.time, r.prior, r.how) for r in df.select("id", *[c.alias(n) for n, c in C.rule_facets(F.col("title"), F.col("tags"), rules).items()]).collect()}
    assert got == {1: (["many"], [], []), 2: (["one"], [], []), 3: ([], ["mono"], []), 4: ([], [], []), 5: ([], [], []), 6: ([], [], ["full"]), 7: ([], [], [])}


def test_submissions_equal_a_plain_queue(spark):
    r = random.Random(3)
    jobs = [(k, f"s{k}", f"k{k}", "p", "running" if k < 3 else "succeeded") for k in range(6)]
    requests = [(k, f"s{r.randrange(14)}", f"k{r.randrange(30)}", r.choice("pq")) for k in range(80)]
    for cap in (3, 6, 20):
        known, busy, n, want, judged = {j[2]: j[1:4:2] for j in jobs}, {j[1] for j in jobs if j[4] == "running"}, 3, {}, {}
        for o, s, key, p in requests:
            if key in known:
                want[o] = "existing" if known[key] == (s, p) else "idempotency_conflict"
            elif key in judged:
                want[o] = judged[key]
            elif n >= cap:
                want[o] = judged[key] = "queue_full"
            elif s in busy:
                want[o] = judged[key] = "conflict"
            else:
                known[key], n, want[o] = (s, p), n + 1, "queued"
                busy.add(s)
        df = spark.createDataFrame(jobs, "ord bigint, session_id string, request_key string, payload string, status string")
        got = {x.ord: x.result for x in J.submit(df, spark.createDataFrame(requests, "ord bigint, session_id string, request_key string, payload string"), cap).collect()}
        assert got == want
    assert J.claim(df).count() == 0 and [x.ord for x in J.claim(df.where("status <> 'running'").unionByName(df.limit(2).withColumn("status", F.lit("queued")))).collect()] == [0]
