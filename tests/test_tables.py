"""Golden cases of values in tables, and of ordered text algorithms."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from evidentia.operators import passages as P
from evidentia.operators import tables as B


PIPED = "| Model | Recall | Cost (ms) |\n|---|---|---|\n| Alpha (ours) | **71.5** | 12 |\n| Beta | 80.25 | 9 |"
LAID = "Models\nAlpha\nBeta [3]\nGamma\nRecall (%)\n71.5\n80.25\n64"
CASES = [
    # a column that lies line by line: as many numbers as models, or none counts
    (LAID, "Beta", 80.25, "Recall", [], True),
    (LAID, "Gamma", 80.25, "Recall", [], False),
    (LAID + "−12.5%", "Gamma", 64.0, "Recall", [], True),
    ("Models\nAlpha\nBeta\nRecall\n71.5", "Alpha", 71.5, "Recall", [], False),
    ("Models\nBeta\nOurs\nRecall\n80.25\n71.5", "Alpha", 71.5, "Recall", ["Ours"], True),
    ("Models\nBeta\nOurs\nRecall\n80.25\n71.5", "Alpha", 71.5, "Recall", [], False),
    # a piped table, by rows and by columns, with rules and bold numbers
    (PIPED, "Alpha", 71.5, "Recall", [], True),
    (PIPED, "Alpha", 12.0, "Recall", [], False),
    (PIPED, "Alpha", 12.0, "Cost (ms)", [], True),
    ("| Model | Alpha | Beta |\n| Recall | 71.5 | 80.25 |\n| Cost | 80.25 | 9 |", "Alpha", 80.25, "Recall", [], False),
    ("| Model | Alpha [1] | Beta |\n|:-|-|-|\n| Recall (%) | 71.5 | **80.25** |", "Beta", 80.25, "Recall", [], True),
    # a model may have several rows
    ("| Model | Recall | Cost |\n| Alpha | 70 | 1 |\n| Alpha | 71.5 | 2 |", "Alpha", 71.5, "Recall", [], True),
    # a row of four cells names its metric
    ("Beta [12] | Corpus | Recall | 80.25", "Beta [12]", 80.25, "Recall", [], True),
    ("Beta | Corpus | Cost | 80.25", "Beta", 80.25, "Recall", [], False),
    ("BetaXL | Corpus | Recall | 80.25", "Beta", 80.25, "Recall", [], False),
    # merged rows are split again where the parts match
    ("|Alpha<br>Beta|71.5<br>80.25|", "Beta", 80.25, "", [], True),
    ("|Alpha<br>Beta|71.5<br>80.25|", "Beta", 71.5, "", [], False),
    ("|7<br>8|Alpha<br>Beta|71.5<br>80.25|", "Alpha", 80.25, "Recall", [], False),
    # a name parted at its hyphen, in one cell or two
    ("|Alpha net-<br>2step|Aux|4|71.5|64|", "Alpha net-2step", 71.5, "Recall", [], True),
    ("Alpha net-|2step<br>Aux|Other|4|71.5<br>64", "Alpha net-2step", 71.5, "Recall", [], True),
    ("|Alpha net|Aux|8|**71.5**<br>64<br><br>|", "Alpha net", 71.5, "Recall (%)", [], True),
    # numbers below a model's own line, past ticks and blank lines but no words
    ("Alpha\n3\n71.5 (+2.0%)\nBeta", "Alpha", 71.5, "Recall", [], True),
    ("Alpha\n✓\n71.5\nBeta", "Alpha", 71.5, "Recall", [], True),
    ("Alpha\n\n  \n71.5\nBeta", "Alpha", 71.5, "Recall", [], True),
    ("Alpha\nBeta\n71.5", "Alpha", 71.5, "Recall", [], False),
    ("Alpha 3 71.5", "Alpha", 71.5, "Recall", [], True),
    (None, "Alpha", 71.5, "Recall", [], False),
    ("", "Alpha", 71.5, "Recall", None, False),
    ("Alpha 71.5", "Alpha", float("nan"), None, None, False),
    ("Alpha 71.5", "Alpha", None, None, None, False),
]


def test_tables_bind_models_and_metrics(spark):
    rows = spark.createDataFrame([(k, *c[:5]) for k, c in enumerate(CASES)], "row_id int, quote string, model string, value double, metric string, aliases array<string>")
    got = {r.row_id: r.source_bound for r in B.bind_values(rows).collect()}
    assert [k for k, c in enumerate(CASES) if got[k] != c[5]] == []
    assert B.bind_values(rows.limit(0)).count() == 0


def test_own_names_need_the_title_and_the_role(spark):
    cases = [("Alpha: a study of graphs", "proposed", True), ("_2025_Alpha_Journal_.pdf", "proposed", True), ("Beta: a study", "proposed", False), ("Alpha: a study", "baseline", False), ("Al-pha: a study", "proposed", True), (None, "proposed", False)]
    rows = spark.createDataFrame([(k, "Alpha (Ours)", t, r) for k, (t, r, _) in enumerate(cases)], "k int, model string, title string, role string")
    got = {r.k: r.n for r in rows.select("k", F.size(B.own_names(F.col("model"), F.col("title"), F.col("role"))).alias("n")).collect()}
    assert [got[k] > 0 for k in range(len(cases))] == [c[2] for c in cases]


def test_parent_spans_cover_blocks_and_keep_headings():
    text = "intro line\n\n# One\n\ntext of one\nmore\n\n## Two\n\n" + "long " * 29 + "end"
    spans = P.parents(text, 60)
    assert spans[0][2] == "" and [h for *_, h in spans][1] == "One" and spans[-1][2] == "Two"
    assert all(text[a:b].strip() == text[a:b] and a < b for a, b, _ in spans)
    assert P.parents("") == [(0, 0, "")]


def test_quotes_map_back_to_the_given_text(spark):
    text = "some  text\nwith 𝒳 odd\tspaces\u3000and a tail, with 𝒳odd spaces"
    docs = spark.createDataFrame([(1, text), (2, "nothing here of the kind"), (3, None), (4, "")], "id bigint, text string")
    quotes = spark.createDataFrame([(10, "with 𝒳odd spaces"), (11, "short"), (12, "nowhere to be found"), (13, "spaces and a tail"), (14, "with 𝒳 oddspaces"), (15, None)], "quote_id bigint, quote string")
    for block in (100_000, 1):
        got = {(r.id, r.quote_id): text[r.start : r.end] for r in P.bind_quotes(docs, quotes, block=block).collect()}
        assert got == {(1, 10): "with 𝒳 odd\tspaces", (1, 14): "with 𝒳 odd\tspaces", (1, 13): "spaces\u3000and a tail"}
    assert P.bind_quotes(docs, quotes.limit(0)).count() == 0


def test_chunks_overlap_and_lose_nothing():
    text = "\n\n".join(["a" * 500, "b" * 500, "c" * 5000, "d" * 1500, "e"])
    got = P.paragraph_chunks(text)
    assert got[0] == "a" * 500 and got[1].startswith("a" * 100 + "\n...\n") and max(map(len, got)) <= 1705
    bodies = [got[0], *(x.split("\n...\n", 1)[1] for x in got[1:])]
    assert "".join("".join(bodies).split()) == "".join(text.split())
    assert P.paragraph_chunks("  ") == [] and P.paragraph_chunks("x") == ["x"]


def plain_excerpt(text, question, most):
    """The windows by plain loops: score, rank, take what fits."""
    if len(text) <= most:
        return text
    parts = [(a, text[a : a + P.WINDOW].lower()) for a in range(0, len(text), P.WINDOW)]
    rare = {t: math.log(1 + len(parts) / (1 + sum(t in x for _, x in parts))) for t in P.question_terms(question)}
    spans = [(0, min(700, most // 5)), (len(text) - min(500, most // 5), len(text))]
    used = 250 + sum(b - a for a, b in spans)
    score = lambda x: sum(w for t, w in rare.items() if t in x)
    for a, x in sorted(parts, key=lambda p: (-round(score(p[1]), 9), p[0])):
        b = min(len(text), a + P.WINDOW)
        if score(x) and used + b - a + 60 <= most and not any(a < d and b > c for c, d in spans):
            spans.append((a, b))
            used += b - a + 60
    return "\n\n[...]\n\n".join(f"[{a + 1}-{b}]\n{text[a:b]}" for a, b in sorted(spans))


def test_excerpts_equal_plain_loops(spark):
    r = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "common", "common", "common", "é𝒳"]
    texts = [" ".join(r.choices(words[4:], k=n)) + " " + " ".join(r.choices(words, k=n // 40)) + " " + " ".join(r.choices(words[3:], k=n)) for n in (10, 900, 2500, 6000)]
    df = spark.createDataFrame([*enumerate(texts), (9, None), (10, "")], "id bigint, text string")
    for most in (2000, 6000, 9000):
        got = {x.id: x.excerpt for x in P.document_excerpt(df, "Alpha beta gamma delta", most).collect()}
        assert all(got[k] == plain_excerpt(t, "Alpha beta gamma delta", most) and len(got[k]) <= most for k, t in enumerate(texts) if len(t) > 0)
        assert got[9] is None and got[10] == ""
    assert [len(x.excerpt) for x in P.document_excerpt(df.where("id = 2"), "alpha", 100).collect()] == [100]


def test_reading_plans_pack_the_best_sections(spark):
    sections = [f"# Part {k}\n\n" + ("graph " if k in (3, 7) else "other ") * 60 for k in range(10)]
    text = "\n\n".join(sections)
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "x" * 9000)], "id bigint, text string")
    got = {r.id: r for r in P.reading_plan(df, "Graph parts", 1100, most=500).collect()}
    assert [got[k].mode for k in (1, 2, 3, 4)] == ["sections", "full", "empty", "too_large"]
    assert [text[s.start : s.end].count("graph") for s in got[1].spans] == [60, 60] and sum(s.end - s.start + 120 for s in got[1].spans) <= 1100
    assert [(s.start, s.end) for s in got[2].spans] == [(0, 5)] and got[4].spans == []


def timed(df):
    import time

    began = time.perf_counter()
    out = df.collect()
    return out, time.perf_counter() - began


def test_long_texts_and_long_quotes_take_linear_time(spark):
    schema = "row_id int, quote string, model string, value double, metric string, aliases array<string>"
    table = lambda n: "| Model | Recall |\n|---|---|\n" + "\n".join(f"| M{k} | {k}.5 |" for k in range(n))
    prose = lambda n: "\n".join(f"M{k} {k}.5 here" for k in range(n))
    make = lambda n: spark.createDataFrame([(1, table(n), f"M{n - 1}", n - 0.5, "Recall", []), (2, prose(n), f"M{n - 1}", n - 0.5, "", []), (3, LAID, "Beta", 80.25, "Recall", [])], schema)
    timed(B.bind_values(make(20)))
    out, seconds = timed(B.bind_values(make(5000)))
    assert {r.row_id: r.source_bound for r in out} == {1: True, 2: True, 3: True} and seconds < 8
    text = " ".join(f"word{k % 977} alpha{'' if k % 50 else ' gamma'}" for k in range(32_000))
    docs = spark.createDataFrame([(1, text)], "id bigint, text string")
    out, seconds = timed(P.document_excerpt(docs, "Alpha beta gamma delta epsilon zeta", 9000))
    assert len(text) > 400_000 and out[0].excerpt == plain_excerpt(text, "Alpha beta gamma delta epsilon zeta", 9000) and seconds < 5


def test_rows_of_one_file_are_dealt_over_tasks(spark):
    rows = spark.createDataFrame([(k, "m", 1.0, "price", "| Method | Price |\n| m | 1.0 |", []) for k in range(40)], "row_id int, model string, value double, metric string, quote string, aliases array<string>").coalesce(1)
    found = B.bind_values(rows)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and found.where("source_bound").count() == 40


def test_texts_are_taken_a_few_at_a_time(spark):
    frames = list(P.few([pd.DataFrame({"id": range(120)}), pd.DataFrame({"id": []})]))
    assert [len(x) for x in frames] == [50, 50, 20] and [i for x in frames for i in x["id"]] == list(range(120))
    docs = spark.createDataFrame([(k, f"# H{k}\n\ntext of {k}" if k % 7 else None) for k in range(120)], "id bigint, text string").coalesce(1)
    assert {(r.id, r.section) for r in P.chunk_markdown(docs).collect()} == {(k, f"H{k}") for k in range(120) if k % 7}
    assert {(r.id, r.mode) for r in P.reading_plan(docs, "text", 5).collect()} == {(k, "too_large" if k % 7 else "empty") for k in range(120)}
