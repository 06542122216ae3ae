import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import chat_format as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, k string, segments int"
PARTS = ["\\", "#", "##", "###", "</turn>", "</turn", "<", "\n", " ", ": ", "### User: ", "@", "é😀", "ok", "### @", ":"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), st.sampled_from(["user", "assistant", "system", ""]) | st.lists(st.sampled_from(PARTS), max_size=4).map("".join))
def test_a_turn_is_read_back_and_holds_no_foreign_mark(text, role):
    t = C.Template()
    segments = t.write(role, text)
    assert t.read("".join(s for s, _ in segments)) == (role, text)
    body = t.escaped(text)
    unescaped = t._escaped.sub("\0", body)
    assert "###" not in unescaped and "</turn>" not in unescaped and "\\" not in unescaped
    assert [s for s, own in segments if own] == ([body] if role == "assistant" and text else [])


def test_what_the_template_never_writes_is_refused():
    for bad in ("", "### User: a", "### User: </turn> </turn>\n", "### Nobody: a</turn>\n", "### User: a\\</turn>\n"):
        with pytest.raises(ValueError):
            C.Template().read(bad)


def expected(rows):
    rows = sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    loss = "".join(x for _, r, x in rows if r == "assistant")
    roles = ["", *(r for _, r, _ in rows)]
    pairs = {("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
    first = all(r != "" for r in roles[1:])
    valid = first and all(p in pairs for p in zip(roles, roles[1:])) and roles[-1] == "assistant"
    return len(rows), sha("".join(f"{r}\n{x}\n" for _, r, x in rows)), len(loss), sha(loss), sum(len(s) for _, r, x in rows for s, _ in C.Template().write(r, x)), valid


def test_conversations_equal_a_plain_loop(spark):
    r = random.Random(4)
    convs = {c: [(r.choice([None, 0, 1, 2, 3]), r.choice(["user", "assistant", "system", None, "tool: #"]), r.choice([None, "", "x" * 5000, *PARTS])) for _ in range(r.randrange(1, 9))] for c in range(40)}
    convs |= {None: [(0, "user", "a"), (1, "assistant", "b")], 77: [(k, ("user", "assistant")[k % 2], f"text {k} \\ ###") for k in range(5000)], 78: [(0, "user", "long " * 100_000), (1, "assistant", "### " * 50_000)]}
    rows = [(c, *x, "clash", 3) for c, xs in convs.items() for x in xs]
    formatted = C.format_chat(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {x.conv_id: tuple(x)[1:] for x in C.digests(formatted).collect()}
    assert got == {c: expected(xs) for c, xs in convs.items()}
    assert got[77][-1] and got[None][-1]
    back = C.read_chat(formatted).where("conv_id = 77").orderBy("k").collect()
    assert [(x.role, x.text, x.trained) for x in back] == [(ro, t, t if ro == "assistant" else "") for _, ro, t in convs[77]]


def test_another_template(spark):
    t = C.Template(opens="[", says="|", closes="]", labels={"user": "U", "assistant": "A"}, loss=("user",), follows={"": ("user",), "user": ("user",)}, ends=("user",))
    rows = [(1, 0, "user", "a]b[\\", None, None), (1, 1, "user", "c|", None, None)]
    formatted = C.format_chat(spark.createDataFrame(rows, SCHEMA), t)
    assert ["".join(s.text for s in x.segments) for x in formatted.orderBy("k").collect()] == ["[U|a\\]b\\[\\\\]", "[U|c|]"]
    assert C.digests(formatted, t).first().valid


def test_empty_table(spark):
    empty = C.format_chat(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and C.digests(empty).count() == 0 and C.read_chat(empty).count() == 0
