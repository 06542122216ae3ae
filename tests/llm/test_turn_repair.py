import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from evidentia.llm import turn_repair as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string, gone string, c int"


def plain(rows):
    """The row of one conversation's (turn, role, text), by a recursion over (row, last role)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, r, x in rows:
        said = x.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not said else "duplicate" if (r, x) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((r, x))

    @lru_cache(None)
    def best(k, last, inserted):
        """(cost, audit, lines) from row k on, after a row of initial last."""
        due = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
        found = [(0, "", ())] if k == len(rows) and last in ("", "a") else []
        add = lambda cost, letter, line, rest: found.append((cost + rest[0], letter + rest[1], line + rest[2]))
        if inserted < 2:
            add(3, "I", (f"{due}:",), best(k, due[0], inserted + 1))
        if k < len(rows):
            _, r, x = rows[k]
            add(4, "D", (), best(k + 1, last, 0))
            if faults[k] not in ("blank", "duplicate"):
                extra = 3 * (faults[k] == "truncated")
                add(3 + extra, "R", (f"{due}:{x}",), best(k + 1, due[0], 0))
                if (last + r[:1] if r else "?") in ("s", "u", "su", "ua", "au"):
                    add(extra, "K", (f"{r}:{x}",), best(k + 1, r[0], 0))
        return min(found, default=(1 << 40, "", ()))

    cost, audit, lines = best(0, "", 0)
    initials = [r[:1] for _, r, _ in rows]
    known = {t for t, _, _ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, n, most):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", None, "", "umpire", "tool"]
    texts = ["Yes.", "no", "", "  \n", None, "So?", "wait!\t", "é", "x."]
    return {c: [(r.choice([None, *range(most)]), r.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], r.choice(texts) if r.random() < 0.5 else f"text {r.randrange(9)}" + r.choice([".", ""])) for _ in range(r.randrange(most + 1))] for c in range(n)}


@pytest.mark.parametrize("long, piece", [(8192, 4096), (3, 2), (0, 3)])
def test_equals_a_plain_search(spark, long, piece):
    given = made(1, 60, 9)
    given[None] = given[3] + given[4]
    rows = [(c, *r, "x", 1) for c, rs in given.items() for r in rs]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in T.repair(df, long=long, piece=piece).collect()}
    assert got == {c: plain(rs) for c, rs in given.items() if rs}


def test_very_long_conversations_come_in_pieces(spark):
    given = {1: made(2, 1, 1)[0] or [(0, "user", "a.")], 2: [r for c in made(3, 120, 30).values() for r in c][:900]}
    rows = [(c, *r, "x", 1) for c, rs in given.items() for r in rs]
    whole, cut = (T.repair(spark.createDataFrame(rows, SCHEMA), long=n, piece=50).orderBy("conv_id").collect() for n in (1000, 100))
    assert whole == cut and len(whole) == 2 and len(whole[1]["audit"]) > 400


def test_damage_and_dropped_conversations(spark):
    rows = [(c, t, r, "One. Two! Three?", None, None) for c in range(60) for t, r in enumerate(["user", "assistant"])] + [(None, None, None, None, None, None)] * 2
    out = T.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for c, t, r, x, _, _ in rows:
        c_, t_, r, x = (" " if v is None else v for v in (c, t, r, x))
        k = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        text = "" if k <= 1 else "One Two Three" if k == 2 and x != " " else x
        want += [(c, t, "user" if k == 4 else r, text, k == 0)] * (2 if k == 3 else 1)
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    got = T.repair(T.damaged(spark.createDataFrame(rows, SCHEMA)), gone="dropped").collect()
    assert {r.conv_id for r in got} == {r[0] for r in rows} and len(got) == 61
    gone = spark.createDataFrame([(5, 0, "user", "x", True)], "conv_id bigint, turn bigint, role string, text string, gone boolean")
    assert [tuple(r) for r in T.repair(gone, gone="gone").collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    assert T.repair(spark.createDataFrame([], SCHEMA)).count() == 0
