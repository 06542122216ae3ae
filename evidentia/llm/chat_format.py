"""Chat formatting by a finite-state machine over roles and a declarative template.

The machine's state is the role that spoke last, so a conversation of any length streams through it with constant memory. Each turn
becomes text segments with a flag that tells whether a model is trained on them. Control strings inside texts are escaped, so that a
text can't open or close a turn, and the formatted text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.llm.common import materialize, pick, table


@dataclass(frozen=True)
class Template:
    """How turns are written: before and after a role's label, after the text, the labels, the mark of a role that has none, the
    escape character, the roles whose texts are trained on, which roles may follow which ("" is the start), and who may be last."""

    opens: str = "### "
    says: str = ": "
    closes: str = "</turn>\n"
    other: str = "@"
    escape: str = "\\"
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    @cached_property
    def controls(self) -> list[str]:
        """What a text mustn't say unescaped, white space around marks aside."""
        return [self.escape, self.opens.strip(), self.closes.strip()]

    @cached_property
    def _marked(self) -> re.Pattern:
        return re.compile(f"(?={'|'.join(map(re.escape, self.controls))})")

    @cached_property
    def _escaped(self) -> re.Pattern:
        return re.compile(f"{re.escape(self.escape)}(.)", re.S)

    @cached_property
    def _turn(self) -> re.Pattern:
        e, body = re.escape, lambda stop: f"(?:(?!{stop}|{re.escape(self.escape)}).|{re.escape(self.escape)}.)*"
        labels = "|".join(map(e, self.labels.values()))
        return re.compile(f"{e(self.opens)}(?:({labels})|{e(self.other)}({body(e(self.says[0]))})){e(self.says)}({body(e(self.closes.strip()))}){e(self.closes)}", re.S)

    def escaped(self, text: str) -> str:
        """The escape character before each place where a control string begins, those that overlap too."""
        return self._marked.sub(lambda m: self.escape, text)

    def plain(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def write(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Segments of a turn and whether they are trained on; empty ones are left out."""
        label = self.labels.get(role) or self.other + self.escaped(role).replace(self.says[0], self.escape + self.says[0])
        return [(s, own) for s, own in ((f"{self.opens}{label}{self.says}", False), (self.escaped(text), role in self.loss), (self.closes, False)) if s]

    def read(self, turn: str) -> tuple[str, str]:
        """Role and text of a formatted turn."""
        m = self._turn.fullmatch(turn)
        if not m:
            raise ValueError(f"not a formatted turn: {turn[:200]!r}")
        known = {label: role for role, label in self.labels.items()}
        return known[m[1]] if m[1] is not None else self.plain(m[2]), self.plain(m[3])


_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def _each(batches: Iterator[pa.RecordBatch], rows: int = 1000):
    """Slices of batches, each with the values of its columns."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, [c.to_pylist() for c in part.columns]


def format_chat(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, k, legal, segments array<struct<text, loss>>) of every row of (conv_id, turn, role, text).

    k counts a conversation's rows by turn from 0, nulls first, ties by role and text, repeated rows one by one. legal is the
    machine's verdict: the role may follow the one before. Null roles and texts count as empty, null conv_ids are one conversation;
    a role that the template doesn't know is written with its name and is never legal. Further columns of any name don't matter; an
    empty table gives no rows. A conversation's rows stream through one task, which holds its state only.
    """
    t = template or Template()
    kind = turns.schema["conv_id"].dataType

    def run(batches):
        conv, last, k = object(), "", 0
        for part, (ids, _, roles, texts) in _each(batches):
            places, legal, segments = [], [], []
            for own, role, text in zip(ids, roles, texts):
                if own != conv:
                    conv, last, k = own, "", 0
                places.append(k)
                legal.append(role in t.follows.get(last, ()))
                segments.append([{"text": s, "loss": f} for s, f in t.write(role, text)])
                last, k = role or "?", k + 1
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(places, pa.int64()), pa.array(legal, pa.bool_()), pa.array(segments, _SEGMENTS)], ["conv_id", "k", "legal", "segments"])

    rows = pick(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind.simpleString()}, k bigint, legal boolean, segments array<struct<text: string, loss: boolean>>")


def read_chat(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, k, role, text, trained) of the rows of format_chat, parsed from their text; trained is what lies under the loss mask,
    unescaped. A row that the template can't have written raises ValueError."""
    t = template or Template()
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for part, (_, _, segments) in _each(batches):
            read = [t.read("".join(s["text"] for s in x)) for x in segments]
            trained = [t.plain("".join(s["text"] for s in x if s["loss"])) for x in segments]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r for r, _ in read], pa.string()), pa.array([x for _, x in read], pa.string()), pa.array(trained, pa.string())], ["conv_id", "k", "role", "text", "trained"])

    return formatted.select("conv_id", "k", "segments").mapInArrow(run, f"conv_id {kind}, k bigint, role string, text string, trained string")


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid), all read back from the rows of format_chat.

    valid tells that each turn was legal and the last one may end a conversation. Rows stream by conversation and place; running
    digests are all that is held.
    """
    t = template or Template()
    kind = formatted.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)
    schema = f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"

    def run(batches):
        none = conv = object()
        n, said, chars, loss, size, legal, last = 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, ""

        def batch(done):
            types = (arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*done) if done else [[]] * 7, types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])

        row = lambda: (conv, n, said.hexdigest(), chars, loss.hexdigest(), size, legal and last in t.ends)
        for _, columns in _each(batches):
            done = []
            for own, _, ok, segments in zip(*columns):
                if own != conv:
                    if conv is not none:
                        done.append(row())
                    conv, n, said, chars, loss, size, legal, last = own, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, ""
                written = "".join(s["text"] for s in segments)
                last, text = t.read(written)
                trained = t.plain("".join(s["text"] for s in segments if s["loss"]))
                n, chars, size, legal = n + 1, chars + len(trained), size + len(written), legal and ok
                said.update(f"{last}\n{text}\n".encode())
                loss.update(trained.encode())
            yield batch(done)
        yield batch([row()] if conv is not none else [])

    rows = formatted.select("conv_id", "k", "legal", "segments")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "k").mapInArrow(run, schema)


#: A conversation whose texts hold the template's own marks.
PROBE = "\\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return digests(materialize(format_chat(given.unionByName(probe)), "chat"))


ORACLE = r"""WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
  length(regexp_replace(text, '[^\\]', '', 'g')) + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) + len(regexp_extract_all(text, '</turn>')) AS escapes FROM given),
near AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY k) AS after FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE '@' || regexp_replace(role, '([\\:])', '\\\1', 'g') END) + 2 + length(text) + escapes + 8)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN k = 1 THEN role IN ('system', 'user') ELSE before || ' ' || role IN ('system user', 'user assistant', 'assistant user') END AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM near GROUP BY conv_id"""
