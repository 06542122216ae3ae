"""Coverage of claims by audited papers, and candidates held against it: only what direct evidence of the run supports counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.review import DIRECT, OPEN, STRONG, first_of

#: Where candidates come from, in the order in which they are taken, and in which consistency takes them.
ORIGINS, EXCLUSIVE = ("gaps", "provisional_gaps", "rejected_gaps"), ("gaps", "rejected_gaps", "provisional_gaps")
#: An audit that isn't one, the source that counts, and the relation of papers that name none.
FALLBACK, FULLTEXT, OTHER = "deterministic_fallback", "paper_fulltext", "other"


def cells(claims: DataFrame, audit: DataFrame, assessments: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, paper_id, relations, coverage, evidence_ids, verdict, reason): what audited full texts say of known claims, with the
    direct evidence that the paper has.

    claims (claim_id, claim); audit (paper_id, status, mode, source_type, relations array); assessments (paper_id, claim_id, ord,
    verdict, evidence_ids array, reason); evidence (paper_id, evidence_id, level). A verdict counts if it is one of the strong ones
    and cites direct evidence; a blank reason is the claim itself. Repeated assessments are cells of their own.
    """
    usable = audit.where((F.col("status") == "audited") & (F.coalesce("mode", F.lit("")) != FALLBACK) & (F.col("source_type") == FULLTEXT))
    related = usable.select("paper_id", F.when(F.size("relations") > 0, F.col("relations")).otherwise(F.array(F.lit(OTHER))).alias("relations"))
    said = assessments.where(F.col("verdict").isin(*STRONG)).join(related, "paper_id").join(claims.select("claim_id", "claim").dropDuplicates(["claim_id"]), "claim_id")
    cited = said.select("paper_id", "claim_id", "ord", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    direct = evidence.where(F.col("level") == DIRECT).select("paper_id", "evidence_id").distinct()
    held = cited.join(direct, ["paper_id", "evidence_id"]).groupBy("paper_id", "claim_id", "ord").agg(F.array_sort(F.collect_list("evidence_id")).alias("known"))
    level = F.when(F.col("verdict") == "partially_covered", "partial").otherwise("direct")
    reason = F.when(F.trim("reason") != "", F.col("reason")).otherwise(F.col("claim"))
    return said.join(held, ["paper_id", "claim_id", "ord"]).select("claim_id", "paper_id", "relations", level.alias("coverage"), F.col("known").alias("evidence_ids"), "verdict", reason.alias("reason"))


def records(covered: DataFrame) -> DataFrame:
    """(paper_id, claim_ids, evidence_ids, relations) of each paper with a cell: ids ascending, each once."""
    every = covered.select("paper_id", "claim_id", "relations", F.explode("evidence_ids").alias("evidence_id"))
    return every.groupBy("paper_id").agg(F.array_sort(F.collect_set("claim_id")).alias("claim_ids"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"), F.first("relations").alias("relations"))


def _first_seen(candidates: DataFrame, order: Sequence[str]) -> DataFrame:
    """candidates with place, by origin and ord, and seen: how many names came up to there. Of rows with one name the first stays;
    rows without a name all stay, and have one in common when names are counted."""
    origin = first_of([(F.col("origin") == o, k) for k, o in enumerate(order)])
    named = candidates.withColumns({"place": F.struct(origin.alias("origin"), F.col("ord").alias("ord")), "name_": F.coalesce(F.nullif(F.col("gap_id"), F.lit("")), F.col("name"), F.lit(""))})
    one = Window.partitionBy("run", "name_").orderBy("place")
    known = named.where(origin.isNotNull()).withColumn("first_", F.row_number().over(one) == 1).where(F.col("first_") | (F.col("name_") == ""))
    # a run has a few dozen candidates
    return known.withColumn("seen", F.sum(F.col("first_").cast("int")).over(Window.partitionBy("run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))


def ground(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(run, ord, origin, gap_id, bucket, status, nearest, evidence, notes): candidates with the references that hold.

    candidates: (run, ord, origin, gap_id, name, status, basis, contribution, nearest array<struct<paper_id, difference>>, evidence
    array<struct<paper_id, evidence_ids>>); known: (run, paper_id, evidence_ids) as records gives them. Of one name the first counts.
    Nearest works stay if the paper is known and a difference is told, evidence if it is the paper's own. A candidate is accepted
    (narrow_candidate) if it was put forward as one and has both, a basis and a contribution; notes name what others lack. A
    missing gap_id is made of the number of names so far.
    """
    rows = _first_seen(candidates, ORIGINS)
    key = ["run", "place"]
    near = rows.select(*key, F.posexplode("nearest").alias("p", "x")).select(*key, "p", F.col("x.paper_id").alias("paper_id"), F.col("x.difference").alias("difference")).where(F.trim("difference") != "")
    near = near.join(known.select("run", "paper_id"), ["run", "paper_id"], "left_semi").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "paper_id", "difference"))), lambda x: F.struct(x["paper_id"].alias("paper_id"), x["difference"].alias("difference"))).alias("near"))
    told = rows.select(*key, F.posexplode("evidence").alias("p", "x")).select(*key, "p", F.col("x.paper_id").alias("paper_id"), F.col("x.evidence_ids").alias("given"))
    held = told.join(known.select("run", "paper_id", F.col("evidence_ids").alias("own")), ["run", "paper_id"]).withColumn("ids", F.array_sort(F.array_intersect("given", "own"))).where(F.size("ids") > 0)
    held = held.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "paper_id", "ids"))), lambda x: F.struct(x["paper_id"].alias("paper_id"), x["ids"].alias("evidence_ids"))).alias("held"))
    both = rows.join(near, key, "left").join(held, key, "left")
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    lacks = [(F.col("near").isNull(), "no_nearest_work"), (F.col("held").isNull(), "no_evidence"), (~has("basis"), "no_basis"), (~has("contribution"), "no_contribution")]
    notes = F.array_compact(F.array(*[F.when(missing, note) for missing, note in lacks]))
    accepted = (F.col("origin") == ORIGINS[0]) & F.coalesce(F.col("status").isin(*OPEN), F.lit(False)) & (F.size(notes) == 0)
    rejected = F.col("origin") == ORIGINS[2]
    bucket = F.when(accepted, ORIGINS[0]).when(rejected, ORIGINS[2]).otherwise(ORIGINS[1])
    status = F.when(accepted, "narrow_candidate").when(rejected, "rejected").otherwise("insufficient_evidence")
    none = F.array().cast("array<string>")
    return both.select("run", "ord", "origin", F.coalesce(F.col("gap_id"), F.concat(F.lit("candidate_"), "seen")).alias("gap_id"), bucket.alias("bucket"), status.alias("status"), F.coalesce("near", F.array().cast(both.schema["near"].dataType)).alias("nearest"), F.coalesce("held", F.array().cast(both.schema["held"].dataType)).alias("evidence"), F.when(accepted, none).otherwise(notes).alias("notes"))


def consistent(candidates: DataFrame) -> DataFrame:
    """(run, ord, origin, gap_id, name, status) with each name in one bucket only, an accepted one before a rejected before an open one,
    and the status that its bucket has."""
    rows = _first_seen(candidates, EXCLUSIVE)
    status = F.when(F.col("origin") == "rejected_gaps", "rejected").when(F.col("origin") == "provisional_gaps", "insufficient_evidence").otherwise(F.col("status"))
    return rows.select("run", "ord", "origin", "gap_id", "name", status.alias("status"))
