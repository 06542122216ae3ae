"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, by a time-major tensor DP.

Conversations are bucketed by length. A bucket's rows lie in arrays of (turn, conversation), and one step of NumPy per turn, from the
last to the first, gives the cost that each conversation still has from each of four states on: nothing said yet, system said, user
said, assistant said. The stored costs are then followed forwards, again for all conversations of a bucket at once.

A conversation of over LONG rows is cut into pieces, which different tasks solve: each piece gives the cheapest cost from every
state to every state, these 4 x 4 tables are chained per conversation, each piece follows the costs from every state it may be
entered in, and the entered states are chained. Only the digest of its repaired text, which has an order, streams through one task,
a row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.llm.common import materialize, pick, table
from evidentia.operators.graph import hot_join

#: Rows of a conversation that one task may hold, rows of a piece of a longer one, and rows that are solved together.
LONG, PIECE, TOGETHER = 8192, 4096, 40_000
#: Costs of the edits, and of keeping a truncated row.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Letters of the edits in the order in which ties are settled.
EDITS = np.frombuffer(b"DIKR", np.uint8)
BLANKS = " \t\n\x0b\x0c\r"
#: The state after the row that is due, and the state after a kept row by the state before and the row's initial: s, u, a, other.
DUE = np.array([2, 2, 3, 2])
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: What is still to pay at the end in each state.
ENDED = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
NEVER = 1 << 50
#: Faults of a row.
SOUND, BLANK, DUPLICATE, CUT = range(4)


def initial(role: str) -> int:
    return "sua".find(role[:1]) % 4 if role else 3


def fault(text: str, seen: bool) -> int:
    said = text.strip(BLANKS)
    return BLANK if not said else DUPLICATE if seen else SOUND if said[-1] in ".!?" else CUT


def closed(cost: np.ndarray) -> np.ndarray:
    """Costs when rows may be inserted first; two are enough, as three lead back."""
    return np.minimum(cost, np.minimum(INSERT + cost[..., DUE], 2 * INSERT + cost[..., DUE[DUE]]))


def backward(code: np.ndarray, faults: np.ndarray, lengths: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(T, C) initials and faults, lengths (C,) and costs at the end (C, 4) -> costs (T + 1, C, 4) before each turn, from each state."""
    turns, n = code.shape
    cost = np.empty((turns + 1, n, 4), np.int64)
    cost[turns] = end
    for t in range(turns - 1, -1, -1):
        after, extra = cost[t + 1], (TRUNCATED * (faults[t] == CUT))[:, None]
        to = KEPT.T[code[t]]
        stays = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1), NEVER)
        stays = extra + np.minimum(stays, REROLE + after[:, DUE])
        must_go = (faults[t] == BLANK) | (faults[t] == DUPLICATE)
        best = np.minimum(DELETE + after, np.where(must_go[:, None], NEVER, stays))
        cost[t] = np.where((t < lengths)[:, None], closed(best), after)
    return cost


def forward(cost: np.ndarray, code: np.ndarray, faults: np.ndarray, lengths: np.ndarray, start: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Follow the costs from the start states: letters (steps, C), 0 where a conversation has ended; whether each step's due row is
    an assistant's; and the states at the end. Where last is not set the rows go on elsewhere, so nothing is inserted after them."""
    turns, n = code.shape
    row, state, each, letters, due = np.zeros(n, np.int64), start.copy(), np.arange(n), [], []
    while True:
        inside = row < lengths
        live = inside | last & (ENDED[state] > 0)
        if not live.any():
            shape = (len(letters), n)
            return np.array(letters, np.uint8).reshape(shape), np.array(due, bool).reshape(shape), state
        at, then = np.minimum(row, turns - 1), np.minimum(row + 1, turns)
        now, kind = cost[row, each, state], code[at, each]
        extra = TRUNCATED * (faults[at, each] == CUT)
        to = KEPT[state, kind]
        goes = inside & (DELETE + cost[then, each, state] == now)
        added = live & ~goes & (INSERT + cost[row, each, DUE[state]] == now)
        kept = inside & ~goes & ~added & (to >= 0) & (extra + cost[then, each, np.maximum(to, 0)] == now)
        letters.append(np.where(live, EDITS[np.select([goes, added, kept], [0, 1, 2], 3)], 0))
        due.append(state == 2)
        state = np.where(kept, to, np.where(live & ~goes, DUE[state], state))
        row = row + (live & ~added)


def solve(conversations: list[tuple[list[int], list[int]]], ends: list[np.ndarray], starts: list[int], last: list[bool]) -> list[tuple[bytes, list[bool], int, np.ndarray]]:
    """Edits, due roles, state at the end and costs at the start for each (initials, faults), bucketed by length."""
    out: list = [None] * len(conversations)
    buckets: dict[int, list[int]] = {}
    for k, (code, _) in enumerate(conversations):
        step = max(1, 1 << max(0, len(code).bit_length() - 4))  # at most an eighth of a bucket's rows are padding
        buckets.setdefault(-(-len(code) // step) * step, []).append(k)
    for turns, members in buckets.items():
        code, faults = np.full((2, max(1, turns), len(members)), 3)
        lengths = np.array([len(conversations[k][0]) for k in members])
        for c, k in enumerate(members):
            code[: lengths[c], c], faults[: lengths[c], c] = conversations[k]
        cost = backward(code, faults, lengths, np.array([ends[k] for k in members]))
        letters, due, state = forward(cost, code, faults, lengths, np.array([starts[k] for k in members]), np.array([last[k] for k in members]))
        for c, k in enumerate(members):
            used = letters[:, c] > 0
            out[k] = (letters[used, c].tobytes(), due[used, c].tolist(), int(state[c]), cost[0, c])
    return out


def lines(audit: bytes, due: list[bool], roles: list[str], texts: list[str]) -> list[str]:
    """The repaired rows."""
    out, k = [], 0
    for edit, assistant in zip(audit, due):
        own = "assistant" if assistant else "user"
        if edit == ord("I"):
            out.append(f"{own}:")
            continue
        if edit != ord("D"):
            out.append(f"{roles[k] if edit == ord('K') else own}:{texts[k]}")
        k += 1
    return out


def illegal(code: list[int]) -> int:
    """Adjacent initials other than su, ua and au."""
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(code, code[1:]))


def gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


_FOUND = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Key and rows of each run of equal values in the first columns, across batches."""
    key, held = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            for r in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns)):
                if held and r[:keys] != key:
                    yield key, held
                    held = []
                key = r[:keys]
                held.append(r[keys:])
    if held:
        yield key, held


def _whole(batches: Iterator[pa.RecordBatch], kind: pa.DataType):
    """Rows (conv_id, turn, role, text, gone) in order -> a row for each conversation."""

    def flush(waiting):
        solved = solve([w[2:4] for w in waiting], [ENDED] * len(waiting), [0] * len(waiting), [True] * len(waiting))
        rows = []
        for (_, rows_, code, faults), (audit, due, _, cost) in zip(waiting, solved):
            text = "\n".join(lines(audit, due, [r[1] for r in rows_], [r[2] for r in rows_]))
            rows.append((gaps([r[0] for r in rows_]), faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal(code), int(cost[0]), audit.decode(), hashlib.sha256(text.encode()).hexdigest()))
        columns = zip(*rows) if rows else [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array([w[0] for w in waiting], kind), *(pa.array(list(c), t) for c, t in zip(columns, _TYPES))], ["conv_id", *_NAMES])

    waiting, size = [], 0
    for (conv,), rows in _runs(batches, 1):
        rows, seen, faults = [r for r in rows if not r[3]], set(), []
        for _, role, text, _ in rows:
            faults.append(fault(text, (role, text) in seen))
            seen.add((role, text))
        waiting.append((conv, rows, [initial(r[1]) for r in rows], faults))
        size += len(rows) + 1
        if size >= TOGETHER:
            yield flush(waiting)
            waiting, size = [], 0
    yield flush(waiting)


def _numbered(batches):
    """Rows in order get their task's number and their place in it."""
    part, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int64()), pa.array(range(k, k + n), pa.int64())], [*batch.schema.names, "part", "k"])
        k += n


def _tables(pdfs):
    """A piece's costs from each state to each state, with its counts and what meets the neighbouring pieces."""
    for pdf in pdfs:
        out = []
        for key, p in pdf.groupby(["c", "part", "piece"], sort=False):
            code, faults = [initial(r) for r in p["role"]], p["fault"].tolist()
            lengths = np.full(4, len(p))
            cost = backward(np.repeat(np.array(code)[:, None], 4, 1), np.repeat(np.array(faults)[:, None], 4, 1), lengths, np.where(np.eye(4, dtype=bool), 0, NEVER))[0]
            turns = p["turn"].dropna()
            out.append((*key, cost.T.reshape(-1).tolist(), faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal(code), code[0], code[-1], turns.nunique(), turns.min() if len(turns) else None, turns.max() if len(turns) else None))
        yield pd.DataFrame(out, columns=["c", "part", "piece", "costs", "blank", "duplicate", "truncated", "illegal", "first", "last", "turns", "low", "high"]).astype({"low": "Int64", "high": "Int64"})


def _chained(p: pd.DataFrame) -> pd.DataFrame:
    """One conversation's pieces -> each with the costs at its end; the first also has the conversation's figures."""
    p = p.sort_values(["part", "piece"]).reset_index(drop=True)
    end, ends = ENDED, []
    for costs in reversed(p["costs"].tolist()):
        ends.append(end)
        end = (np.asarray(costs).reshape(4, 4) + end).min(axis=1)
    known = p[p["turns"] > 0]
    shared = int((known["high"].to_numpy()[:-1] == known["low"].to_numpy()[1:]).sum())
    missing = int(known["high"].iloc[-1] - known["low"].iloc[0] + 1 - known["turns"].sum() + shared) if len(known) else 0
    met = sum(illegal([a, b]) for a, b in zip(p["last"][:-1], p["first"][1:]))
    sums = [int(p[c].sum()) for c in ("blank", "duplicate", "truncated", "illegal")]
    final = [False] * (len(p) - 1) + [True]
    return pd.DataFrame({"c": p["c"], "part": p["part"], "piece": p["piece"], "ends": [list(map(int, e)) for e in reversed(ends)], "final": final, "gaps": missing, "blank": sums[0], "duplicate": sums[1], "truncated": sums[2], "illegal": sums[3] + met, "cost": int(end[0])})


def _followed(pdfs):
    """The edits of a piece for each state in which it may be entered, and the states in which it is left."""
    for pdf in pdfs:
        out = []
        for key, p in pdf.groupby(["c", "part", "piece"], sort=False):
            one = ([initial(r) for r in p["role"]], p["fault"].tolist())
            got = solve([one] * 4, [np.asarray(p["ends"].iloc[0])] * 4, [0, 1, 2, 3], [bool(p["final"].iloc[0])] * 4)
            out.append((*key, [g[0].decode() for g in got], ["".join("ua"[d] for d in g[1]) for g in got], [g[2] for g in got]))
        yield pd.DataFrame(out, columns=["c", "part", "piece", "audits", "dues", "exits"])


def _entered(p: pd.DataFrame) -> pd.DataFrame:
    p, state, entry = p.sort_values(["part", "piece"]), 0, []
    for exits in p["exits"]:
        entry.append(state)
        state = int(exits[state])
    return pd.DataFrame({"c": p["c"], "part": p["part"], "piece": p["piece"], "entry": entry})


def _digested(batches):
    """Rows (c, k, audit, due, role, text), each piece's edits before its rows -> (c, audit, repaired_sha256), holding one piece's edits."""
    key, audit, digest, first, waiting, own = None, [], None, True, [], 0

    def line(text):
        nonlocal first
        digest.update((text if first else "\n" + text).encode())
        first = False

    def insertions():
        nonlocal own
        while own < len(waiting) and waiting[own][0] == "I":
            line("assistant:" if waiting[own][1] == "a" else "user:")
            own += 1

    def done():
        insertions()
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["c", "audit", "repaired_sha256"])

    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            for c, letters, due, role, text in zip(*(x.to_pylist() for x in batch.slice(at, 1000).columns)):
                if c != key:
                    if key is not None:
                        yield done()
                    key, audit, digest, first, waiting, own = c, [], hashlib.sha256(), True, [], 0
                if letters is not None:
                    insertions()
                    audit.append(letters)
                    waiting, own = list(zip(letters, due)), 0
                    continue
                insertions()
                edit, to = waiting[own]
                own += 1
                if edit != "D":
                    line(f"{role if edit == 'K' else 'assistant' if to == 'a' else 'user'}:{text}")
    if key is not None:
        yield done()


def _long(rows: DataFrame, piece: int) -> DataFrame:
    """Conversations of any length, in pieces. rows: (conv_id, c, turn, role, text), c being conv_id as a string that is never null."""
    order = ["c", "turn", "role", "text"]
    placed = materialize(rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, "c string, turn bigint, role string, text string, part bigint, k bigint"), "turns")
    same = F.sha2(F.concat_ws("\0", F.length("c").cast("string"), "c", F.length("role").cast("string"), "role", "text"), 256)
    keyed = placed.withColumn("same", same)
    first = keyed.groupBy("same").agg(F.min(F.struct("part", "k")).alias("at"))
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    sort = F.when(said == "", BLANK).when((F.col("at.part") != F.col("part")) | (F.col("at.k") != F.col("k")), DUPLICATE).when(F.right(said, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT)
    judged = materialize(hot_join(keyed, first, "same").select(*order, "part", "k", F.floor(F.col("k") / piece).alias("piece"), sort.alias("fault")), "turns")
    place = ["c", "part", "piece"]
    small = judged.select(*place, "k", "turn", "role", "fault")

    def together(df: DataFrame, work, schema: str) -> DataFrame:
        """Each piece in one data frame; a piece has at most `piece` rows."""
        return df.groupBy(*place).applyInPandas(lambda p: next(work([p.sort_values("k")])), schema)

    tables = together(small, _tables, "c string, part bigint, piece bigint, costs array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first bigint, last bigint, turns bigint, low bigint, high bigint")
    figures = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    chain = materialize(tables.groupBy("c").applyInPandas(_chained, f"c string, part bigint, piece bigint, ends array<bigint>, final boolean, {figures}"), "chain")
    followed = materialize(together(small.join(chain.select(*place, "ends", "final"), place), _followed, "c string, part bigint, piece bigint, audits array<string>, dues array<string>, exits array<bigint>"), "followed")
    entered = followed.select(*place, "exits").groupBy("c").applyInPandas(_entered, "c string, part bigint, piece bigint, entry bigint")
    chosen = followed.join(entered, place).select(*place, F.lit(-1).cast("bigint").alias("k"), F.expr("audits[int(entry)]").alias("audit"), F.expr("dues[int(entry)]").alias("due"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    none = F.lit(None).cast("string")
    stream = chosen.unionByName(judged.select(*place, "k", none.alias("audit"), none.alias("due"), "role", "text"))
    digests = stream.repartition("c").sortWithinPartitions(*place, "k").select("c", "audit", "due", "role", "text").mapInArrow(_digested, "c string, audit string, repaired_sha256 string")
    totals = chain.where("final").drop("part", "piece", "ends", "final")
    names = rows.select("conv_id", "c").distinct()
    return names.join(totals, "c").join(digests, "c").select("conv_id", *_NAMES)


def repair(turns: DataFrame, gone: str | None = None, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of (conv_id, turn,
    role, text).

    Rows are taken by turn, nulls first; ties by role and text, so repeated rows are adjacent. A null role or text is one space;
    null conv_ids are one conversation. gone names a boolean column that marks rows which are no more: they count for nothing, but
    their conversations get a row. A conversation without rows has zeros, an empty audit and the digest of nothing. Further columns
    of any name don't matter; an empty table gives no rows. long and piece bound what a task holds of one conversation.
    """
    kind = turns.schema["conv_id"].dataType
    rows = pick(turns, "conv_id", "turn", "role", "text", *([gone] if gone else []))
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"))
    arrow = to_arrow_type(kind)
    schema = f"conv_id {kind.simpleString()}, {_FOUND}"
    large = materialize(rows.where("NOT gone").groupBy("conv_id").count().where(F.col("count") > long).select("conv_id"), "long")
    work = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(lambda b: _whole(b, arrow), schema)
    if large.isEmpty():
        return work(rows)
    other = large.withColumnRenamed("conv_id", "x")
    short = rows.join(other, F.col("conv_id").eqNullSafe(F.col("x")), "left_anti")
    named = rows.join(other, F.col("conv_id").eqNullSafe(F.col("x")), "left_semi").where("NOT gone")
    return work(short).unionByName(_long(named.select("conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c"), "turn", "role", "text"), piece))


def damaged(turns: DataFrame, sides: int = 20) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows damaged by the crc32 of conv_id:turn, modulo sides. 0 marks a row as dropped, 1
    empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's; nulls are one space."""
    rows = pick(turns, "conv_id", "turn", "role", "text")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    side = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % sides
    said = F.when(side <= 1, "").when(side == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(side == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(side == 4, "user").otherwise(text("role")).alias("role"), said.alias("text"), (side == 0).alias("dropped"), times.alias("copy")).drop("copy")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")), gone="dropped")


def _option(cost: str, letter: str, rest: str, line: str | None = None, when: str = "TRUE") -> str:
    """SQL of an edit followed by what a later state has: cost, letters, lines; NULL where it isn't allowed."""
    told = f"list_prepend({line}, {rest}.r)" if line else f"{rest}.r"
    return f"CASE WHEN {when} THEN {{'c': {cost} + {rest}.c, 'w': '{letter}' || {rest}.w, 'r': {told}}} END"


def _oracle() -> str:
    names = ("user", "user", "assistant", "user")
    due, stays = (2, 2, 3, 2), "fault NOT IN (1, 2)"
    base = "{'c': 0, 'w': '', 'r': []::VARCHAR[]}, {'c': 6, 'w': 'II', 'r': ['user:', 'assistant:']}, {'c': 3, 'w': 'I', 'r': ['assistant:']}, {'c': 0, 'w': '', 'r': []::VARCHAR[]}".split(", {'c'")
    base = [base[0], *("{'c'" + x for x in base[1:])]
    least = lambda xs: f"list_sort(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))[1]"
    rows = []
    for s in range(4):
        keep = [f"WHEN i = '{x}' THEN d{to}" for x, to in zip("sua", KEPT[s][:3].tolist()) if to >= 0]
        allowed = f"{stays} AND i IN ({', '.join(repr(x) for x, to in zip('sua', KEPT[s][:3].tolist()) if to >= 0)})"
        kept = f"(CASE {' '.join(keep)} ELSE d0 END)"
        rows.append(least([_option("4", "D", f"d{s}"), _option("CASE WHEN fault = 3 THEN 3 ELSE 0 END", "K", kept, "role || ':' || text", allowed), _option("CASE WHEN fault = 3 THEN 6 ELSE 3 END", "R", f"d{due[s]}", f"'{names[s]}:' || text", stays)]) + f" AS n{s}")
    shut = [least([f"n{s}", _option("3", "I", f"n{due[s]}", f"'{names[s]}:'"), f"{{'c': 6 + n{due[due[s]]}.c, 'w': 'II' || n{due[due[s]]}.w, 'r': list_prepend('{names[s]}:', list_prepend('{names[due[s]]}:', n{due[due[s]]}.r))}}"]) + f" AS d{s}" for s in range(4)]
    return f"""WITH RECURSIVE bits AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS b))),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)) AS key FROM conversations),
sided AS (SELECT conv_id, turn, role, text, xor(list_reduce(key, lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % 20 AS side FROM given, bits),
bad AS (SELECT conv_id, turn, CASE WHEN side = 4 THEN 'user' ELSE role END AS role, CASE side WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN side = 3 THEN [0, 1] ELSE [0] END) AS copy FROM sided WHERE side <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM bad),
judged AS (SELECT conv_id, turn, role, text, k, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2 WHEN regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 0 ELSE 3 END AS fault,
  lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS j FROM placed),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
  count(*) FILTER (WHERE j IS NOT NULL AND i || j NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM judged GROUP BY conv_id),
back AS (SELECT conv_id, n + 1 AS k, {', '.join(f'{b} AS d{s}' for s, b in enumerate(base))} FROM figures
  UNION ALL SELECT conv_id, k, {', '.join(shut)} FROM (SELECT b.conv_id, b.k - 1 AS k, {', '.join(rows)} FROM back b JOIN judged g ON g.conv_id IS NOT DISTINCT FROM b.conv_id AND g.k = b.k - 1)),
best AS (SELECT conv_id, d0 FROM back WHERE k = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(d0.c, 0)::BIGINT AS cost, coalesce(d0.w, '') AS audit,
  sha256(coalesce(array_to_string(d0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best x ON x.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE = _oracle()
