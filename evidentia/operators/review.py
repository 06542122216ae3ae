"""Reviews of evidence: verdicts, proofs of facts, gates of candidates, critics, ledgers and what remains to be read.

Rules are ordered lists that a caller may replace; the first that holds decides. Inputs are tables with a row for each thing, so
that every step is a join or an aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verdicts, those that need direct evidence, and evidence levels.
VERDICTS = ("covered", "partially_covered", "contradicted", "not_relevant", "insufficient_evidence")
STRONG = ("covered", "partially_covered", "contradicted")
DIRECT = "direct_fulltext"
#: States of candidates that may be accepted or are contradicted, and the most confidence of weak ones.
OPEN, CONTRADICTED, WEAK = ("supported_candidate", "narrow_candidate"), ("contradicted", "rejected", "reject"), "insufficient_evidence"
CAP_NO_FULLTEXT, CAP_NARROW = 0.55, 0.65
#: Sources that are background only.
BACKGROUND = ("prior_knowledge", "survey_or_repository")


def first_of(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule that holds; a null condition doesn't hold."""
    out = F.when(F.lit(False), F.lit(None))
    for holds, value in rules:
        out = out.when(holds, value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def cited_evidence(cited: DataFrame, evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, known array, direct): which of the evidence_ids of rows of (*keys, paper_id, evidence_ids) their paper has, in the
    given order, and whether one of those of (paper_id, evidence_id, level) is direct."""
    each = cited.select(*keys, "paper_id", F.posexplode("evidence_ids").alias("p", "evidence_id"))
    held = each.join(evidence.select("paper_id", "evidence_id", "level").distinct(), ["paper_id", "evidence_id"])
    found = held.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", "evidence_id")))["evidence_id"].alias("known"), F.bool_or(F.col("level") == DIRECT).alias("direct"))
    return cited.select(*keys).join(found, list(keys), "left").select(*keys, F.coalesce("known", F.array().cast("array<bigint>")).alias("known"), F.coalesce("direct", F.lit(False)).alias("direct"))


def grounded_verdicts(claims: DataFrame, evidence: DataFrame, verdicts: Sequence[str] = VERDICTS, strong: Sequence[str] = STRONG) -> DataFrame:
    """(paper_id, claim_id, verdict, evidence_ids) of distinct claims -> the same with evidence that the paper has, its level, and a
    verdict that falls to the weakest where it is unknown, or strong without direct evidence."""
    keys = ["paper_id", "claim_id"]
    found = claims.join(cited_evidence(claims.select(*keys, "evidence_ids"), evidence, keys), keys)
    verdict = first_of([(~F.coalesce(F.col("verdict"), F.lit("")).isin(*verdicts), WEAK), (F.col("verdict").isin(*strong) & ~F.col("direct"), WEAK)], F.col("verdict"))
    return found.select(*keys, verdict.alias("verdict"), F.col("known").alias("evidence_ids"), F.when(F.col("direct"), DIRECT).otherwise("abstract_or_inference").alias("evidence_level"))


def states(quote: Column, pattern: str, negation: str, sentence: str = r"[.!?。！？;；\n]") -> Column:
    """Whether a sentence of a quote matches a pattern without a negation."""
    return F.exists(F.split(quote, sentence), lambda s: s.rlike(f"(?i){pattern}") & ~s.rlike(f"(?i){negation}"))


def proven_facts(facts: DataFrame, evidence: DataFrame, patterns: Mapping[str, str], negation: str) -> DataFrame:
    """(paper_id, key, value, evidence_ids) -> those that a direct quote of their paper bears out, with the quotes that do.

    A key with a pattern needs quotes that state it; any quote will do for others. Facts without a value are none.
    """
    keys = ["paper_id", "key"]
    real = facts.where(F.trim("value") != "").select(*keys, "value", F.posexplode("evidence_ids").alias("p", "evidence_id"))
    held = real.join(evidence.where(F.col("level") == DIRECT).select("paper_id", "evidence_id", "quote"), ["paper_id", "evidence_id"])
    shown = first_of([(F.col("key") == k, states(F.coalesce("quote", F.lit("")), p, negation)) for k, p in patterns.items()], True)
    return held.where(shown).groupBy(*keys, "value").agg(F.array_sort(F.collect_set(F.struct("p", "evidence_id")))["evidence_id"].alias("evidence_ids"))


def unproven(relations: DataFrame, facts: DataFrame, relation: str, needed: Sequence[str]) -> DataFrame:
    """(paper_id) of papers that claim a relation in (paper_id, relation) and lack one of the facts that it needs."""
    has = facts.where(F.col("key").isin(*needed)).groupBy("paper_id").agg(F.count_distinct("key").alias("n")).where(F.col("n") == len(needed))
    return relations.where(F.col("relation") == relation).select("paper_id").distinct().join(has, "paper_id", "left_anti")


def run_state(profiles: DataFrame, cells: DataFrame, audits: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """One row: what a whole run says about its candidates.

    profiles (paper_id, has_fulltext), cells (state, paper_id), audits (paper_id, status, mode), records (paper_id, basis, level,
    n_evidence): matrix (has cells, a covered or partial one with a paper of the run, and no such paper without an eligible record),
    unaudited and fallback papers, full texts.
    """
    papers = profiles.select("paper_id").distinct()
    assigned = cells.where(F.col("state").isin("covered", "partial")).select("paper_id").distinct().join(papers, "paper_id", "left_semi")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        n(cells, "cells"),
        n(assigned, "assigned"),
        n(papers.join(audits.where("status = 'audited'"), "paper_id", "left_anti"), "unaudited"),
        n(audits, "audits"),
        n(audits.where("mode = 'deterministic_fallback'").select("paper_id").distinct().join(papers, "paper_id", "left_semi"), "fallback"),
        n(profiles.where("has_fulltext"), "fulltexts"),
    ]
    if records is not None:
        sound = records.where("basis = 'research_claims' AND level IN ('direct', 'partial') AND n_evidence > 0").select("paper_id").distinct()
        parts += [n(assigned.join(sound, "paper_id", "left_anti"), "unrecorded")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    unrecorded = F.col("unrecorded") if records is not None else F.lit(0)
    return out.withColumn("matrix", (F.col("cells") > 0) & (F.col("assigned") > 0) & (unrecorded == 0))


def gated(candidates: DataFrame, profiles: DataFrame, run: DataFrame) -> DataFrame:
    """(gap_id, outcome, status, confidence, note) of candidates (gap_id, status, confidence, novelty_basis, nearest
    array<struct<paper_id, difference>>, baselines, change, metrics, stops): accepted, provisional or rejected, with the first reason.

    A run without a valid matrix, with unaudited papers or with fallback audits accepts nothing. Confidence lies in 0 to 1, is capped
    where no nearest work has its full text or the candidate is a narrow one, and has two decimals; no number counts as 0.
    """
    near = candidates.select("gap_id", F.explode("nearest").alias("w")).where(F.trim("w.difference") != "")
    works = near.select("gap_id", F.col("w.paper_id").alias("paper_id")).join(profiles.groupBy("paper_id").agg(F.bool_or("has_fulltext").alias("full")), "paper_id")
    known = works.groupBy("gap_id").agg(F.count("*").alias("works"), F.bool_or("full").alias("full"))
    given = candidates.join(known, "gap_id", "left").crossJoin(F.broadcast(run)).withColumn("kind", F.lower(F.coalesce("status", F.lit(WEAK))))
    filled = lambda *c: F.lit(True) if not c else (F.coalesce(F.trim(F.col(c[0]).cast("string")), F.lit("")) != "") & filled(*c[1:])
    note = first_of(
        [
            (~F.col("matrix"), "no_matrix"),
            ((F.col("audits") > 0) & (F.col("unaudited") > 0), "unaudited"),
            (F.col("fallback") > 0, "fallback"),
            (F.col("kind").isin(*CONTRADICTED), "contradicted"),
            (~F.col("kind").isin(*OPEN), "status"),
            (F.coalesce("works", F.lit(0)) == 0, "no_nearest_work"),
            (~filled("novelty_basis"), "no_basis"),
            (~filled("baselines", "change", "metrics", "stops"), "no_experiment"),
        ]
    )
    full = F.coalesce("full", F.lit(False)) & (F.col("fulltexts") > 0)
    number = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence").try_cast("double"))), F.lit(0.0))
    capped = F.least(number, F.when(full, 1.0).otherwise(CAP_NO_FULLTEXT), F.when(F.col("kind") == "narrow_candidate", CAP_NARROW).otherwise(1.0))
    ready = given.withColumn("note", note)
    outcome = first_of([(F.col("note").isNull(), "accepted"), (F.col("note") == "contradicted", "rejected")], "provisional")
    status = F.when(F.col("note").isNull() | (F.col("note") == "contradicted"), F.col("kind")).otherwise(WEAK)
    confidence = F.when(F.col("note").isNull(), F.round(capped, 2)).otherwise(F.col("confidence").try_cast("double"))
    return ready.select("gap_id", outcome.alias("outcome"), status.alias("status"), confidence.alias("confidence"), F.coalesce("note", F.when(~full, "no_fulltext"), F.lit("")).alias("note"))


def criticised(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """(gap_id, name, confidence, contradicted) with the verdict of reviews (gap_id, gap_name, verdict, cap, revised): by id, or else
    by name; the last review of an id or name (the highest ord) counts.

    -> (gap_id, outcome, verdict, status, confidence). Without a review, with an unknown verdict, or revised, a candidate is
    provisional; a cap in 0 to 1 lowers the confidence.
    """
    facts = F.struct("ord", "verdict", "cap", "revised")
    by_id = reviews.where("gap_id IS NOT NULL").groupBy("gap_id").agg(F.max(facts).alias("own"))
    by_name = reviews.where("gap_name IS NOT NULL").groupBy(F.col("gap_name").alias("name")).agg(F.max(facts).alias("named"))
    found = candidates.join(by_id, "gap_id", "left").join(by_name, "name", "left").withColumn("r", F.coalesce("own", "named"))
    verdict = F.when(F.col("r").isNull(), "provisional").otherwise(F.lower(F.coalesce("r.verdict", F.lit("provisional"))))
    outcome = first_of([(verdict == "accept", "accepted"), (verdict == "reject", "rejected")], "provisional")
    status = first_of([(verdict == "accept", F.col("status")), ((verdict == "reject") & F.col("contradicted"), "contradicted")], WEAK)
    cap = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r.cap")))
    lowered = F.when(F.col("r.cap").isNotNull(), F.round(F.least(F.coalesce("confidence", F.lit(0.0)), cap), 2)).otherwise(F.col("confidence"))
    rewritten = (verdict == "revise") & (F.coalesce(F.trim("r.revised"), F.lit("")) != "")
    return found.select("gap_id", outcome.alias("outcome"), verdict.alias("verdict"), F.when(F.col("r").isNull(), F.col("status")).otherwise(status).alias("status"), lowered.alias("confidence"), F.coalesce(rewritten, F.lit(False)).alias("revised"))


def ledger(papers: DataFrame, profiles: DataFrame, audits: DataFrame, deferred: DataFrame, failed: DataFrame) -> DataFrame:
    """(id, status, reason) for every paper of (id, source_type): how far its reading came.

    profiles (id, error, has_fulltext, source_type), audits (id, status, mode), deferred (id), failed (id); of several rows of an id
    any serves that the ledger prefers: one without an error, an audited one, one that isn't a fallback.
    """
    one = profiles.groupBy("id").agg(F.min(F.struct(F.col("error").isNotNull().alias("bad"), (~F.col("has_fulltext")).alias("part"), "source_type")).alias("p"))
    audit = audits.groupBy("id").agg(F.bool_or(F.col("status") == "audited").alias("audited"), F.bool_or((F.col("status") == "audited") & (F.col("mode") != "deterministic_fallback")).alias("reviewed"))
    flag = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    found = papers.join(one, "id", "left").join(audit, "id", "left").join(flag(deferred, "later"), "id", "left").join(flag(failed, "broken"), "id", "left")
    kind = F.coalesce("p.source_type", F.col("source_type"))
    why = first_of(
        [
            (kind.isin(*BACKGROUND), "excluded:background"),
            (F.col("p").isNull() & F.col("later"), "not_analyzed:limit"),
            (F.col("p").isNull() & F.col("broken"), "not_analyzed:parse_failed"),
            (F.col("p").isNull(), "not_analyzed:no_profile"),
            (F.col("p.bad"), "extraction_failed:profile_error"),
            (~F.coalesce("audited", F.lit(False)), "unassessed:no_audit"),
            (~F.coalesce("reviewed", F.lit(False)), "unassessed:fallback"),
            (~F.col("p.part"), "fulltext:profile"),
        ],
        "abstract:profile",
    )
    return found.select("id", F.split_part(why, F.lit(":"), F.lit(1)).alias("status"), F.split_part(why, F.lit(":"), F.lit(2)).alias("reason"))


def pending_material(papers: DataFrame, profiles: DataFrame, audits: DataFrame) -> DataFrame:
    """(id, reason) of papers not yet read to the end: without a profile, with a failed one, or without a real audit."""
    profile = profiles.groupBy("id").agg(F.bool_and(F.col("error").isNotNull()).alias("bad"))
    done = audits.where("status = 'audited' AND coalesce(mode, '') <> 'deterministic_fallback'").select("id").distinct().withColumn("done", F.lit(True))
    found = papers.select("id").join(profile, "id", "left").join(done, "id", "left")
    reason = first_of([(F.col("bad").isNull(), "not_extracted"), (F.col("bad"), "extraction_failed"), (F.col("done").isNull(), "not_reviewed")])
    return found.select("id", reason.alias("reason")).where("reason IS NOT NULL")


def retry_selection(papers: DataFrame, requested: DataFrame, failed: DataFrame, pending: DataFrame, attempted: DataFrame, most: int = 8) -> DataFrame:
    """(id, place): the next papers to read again, most of them: those asked for in (ord, id), in order, then failed ones by id;
    unread ones first within that. Unknown and attempted ones are left out."""
    asked = requested.groupBy("id").agg(F.min("ord").alias("ord")).select("id", F.lit(0).alias("late"), "ord")
    broken = failed.select("id").distinct().select("id", F.lit(1).alias("late"), F.col("id").alias("ord"))
    first = asked.unionByName(broken).groupBy("id").agg(F.min(F.struct("late", "ord")).alias("at"))
    known = first.join(papers.select("id").distinct(), "id", "left_semi").join(attempted.select("id"), "id", "left_anti")
    unread = pending.select("id").distinct().withColumn("unread", F.lit(0))
    order = [F.coalesce("unread", F.lit(1)), F.col("at")]
    best = known.join(unread, "id", "left").orderBy(*order).limit(most)
    return best.select("id", F.row_number().over(Window.orderBy(*order)).alias("place"))


def next_queries(planned: DataFrame, executed: DataFrame, most: int = 6) -> DataFrame:
    """(query, ord): the first distinct queries of (ord, query) that haven't been executed; blank ones are none."""
    open_ = planned.where(F.trim("query") != "").groupBy("query").agg(F.min("ord").alias("ord"))
    return open_.join(executed.select("query"), "query", "left_anti").orderBy("ord").limit(most)
