"""One object for a catalog's tables, with a method for each thing that a user asks of it. All results are lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators import catalog, log, passages, retrieval, segments

#: Values set at once, at most.
BATCH = 500


@dataclass
class Library:
    """papers (id, text, status, category, fulltext_path, ...), organisation (paper_id, canonical_id, category), vectors
    (id, vector), turns (conv_id, turn, role, text) and events (event_id, user_id, ...); those not given can't be asked."""

    papers: DataFrame
    organisation: DataFrame
    vectors: DataFrame | None = None
    turns: DataFrame | None = None
    events: DataFrame | None = None

    def visible(self) -> DataFrame:
        return catalog.visible(self.papers, self.organisation)

    def search(self, question: str, probe: Sequence[float], ids: Sequence[int] | None = None, top_k: int = 8) -> DataFrame:
        """Fused hits among the visible papers, or among those of ids that are visible; statistics stay over all papers."""
        scope = self.visible().select("id")
        if ids is not None:
            named = self.papers.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id bigint")
            scope = scope.join(named, "id", "left_semi")
        docs = self.papers.select("id", "text", F.col("id").alias("parent"))
        return retrieval.hybrid_search(docs, self.vectors, question, list(probe), scope, top_k=top_k)

    def index(self, folder: str, encode: Callable | None = None) -> dict[str, int]:
        """Bring a stored index of the papers' chunks up to date; numbers of reused, indexed and pruned papers."""
        return segments.update(segments.stamped(self.papers.select("id", "text")), folder, prune=True, encode=encode)

    def find(self, folder: str, question: str, probe: Sequence[float] | None = None, ids: Sequence[int] | None = None, top_k: int = 6) -> DataFrame:
        """Hits of a stored index with their section, place and version, among the visible papers, or those of ids that are; papers that
        have changed since they were indexed are not found."""
        current = segments.stamped(self.visible().select("id", "text")).select("id", "sha")
        if ids is not None:
            named = self.papers.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id bigint")
            current = current.join(named, "id", "left_semi")
        return segments.hybrid(self.papers.sparkSession, folder, question, probe, current, top_k=top_k)

    def page(self, number: int, size: int = 50, text: str | None = None, status: str | None = None, category: str | None = None, order: Sequence[Column] | None = None) -> DataFrame:
        """A page of visible papers; text looks in the papers and in those folded onto them."""
        rows = self.visible()
        if text:
            pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
            hits = self.papers.where(F.col("text").ilike(pattern)).select(F.col("id").alias("paper_id"))
            roots = self.organisation.join(hits, "paper_id", "left_semi").select(F.col("canonical_id").alias("id"))
            rows = rows.join(roots, "id", "left_semi")
        if status:
            rows = rows.where(F.coalesce("status", F.lit("metadata_only")) == status)
        if category:
            rows = rows.where(F.col("category") == category)
        return catalog.page(rows, order or [F.asc("id")], number, size)

    def detail(self, paper_id: int) -> DataFrame:
        """A paper and those folded onto it."""
        root = self.organisation.where(F.col("paper_id") == paper_id).select("canonical_id")
        members = self.organisation.join(root, "canonical_id", "left_semi").select(F.col("paper_id").alias("id"), "canonical_id")
        return self.papers.join(members, "id")

    def missing(self, number: int = 0, size: int = 50) -> DataFrame:
        return catalog.page(self.visible().where("fulltext_path IS NULL"), [F.asc("id")], number, size)

    def set_status(self, ids: Sequence[int], status: str) -> DataFrame:
        """papers with the status of the named ones replaced; unknown ids change nothing, more than BATCH are refused."""
        named = list(dict.fromkeys(ids))
        if len(named) > BATCH:
            raise ValueError(f"{len(named)} ids, {BATCH} at most")
        return self.papers.withColumn("status", F.when(F.col("id").isin(named), status).otherwise(F.col("status")))

    def categories(self) -> DataFrame:
        return self.visible().groupBy(F.coalesce("category", F.lit("unclassified")).alias("category")).agg(F.count("*").alias("n"))

    def quotes(self, quotes: DataFrame) -> DataFrame:
        """Where quotes of (quote_id, quote) lie."""
        return passages.bind_quotes(self.papers, quotes)

    def outdated(self, index: DataFrame) -> DataFrame:
        """Papers that an index of (id, sha) lacks in their present text."""
        return catalog.index_delta(self.papers.select("id", F.sha2("text", 256).alias("sha")), index)

    def numbered_turns(self) -> DataFrame:
        return log.islands(self.turns, "conv_id", "turn", F.col("role") == "user", "turn_id")

    def without_sessions(self, ids: DataFrame) -> DataFrame:
        """Turns of all sessions but those of ids (conv_id)."""
        return self.turns.join(ids.select("conv_id"), "conv_id", "left_anti")

    def events_after(self, cursor: int, size: int = 200) -> DataFrame:
        return log.replay_page(self.events, cursor, size)
