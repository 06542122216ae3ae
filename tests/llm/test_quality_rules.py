from evidentia.llm import quality_rules as q

DOCS = "doc_id bigint, text string, n_words string, kept int, lines int"


def slow(text):
    """Plain counting, window by window."""
    text = text or ""
    words = text.encode().split()
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    chars = sum(len(w.decode()) for w in words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    upper = sum("A" <= c <= "Z" for c in text)
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    bad = base or 10 * symbols > 3 * len(words) or 10 * dup > 6 * len(lines) or not 2 * len(words) <= chars <= 15 * len(words) or 10 * upper > 3 * chars
    return len(words), chars, symbols, dup, len(covered), base, not bad


def texts():
    plain = " ".join(f"word{k}x" for k in range(80))
    return [None, "", " \n", plain, plain.upper(), plain.replace(" ", " && | "), "a b c " * 60, "same line here\n" * 40 + plain, "ü ß " * 70, " ".join(map(str, range(90))), "x" * 5000, plain + " " + plain[:200], "one two " + plain + " one two word3x"]


def test_report_and_filter_match_plain_counting(spark):
    rows = [(i, t, "z", 1, 2) for i, t in enumerate(texts())] + [(3, texts()[3], None, None, None), (None, texts()[3], None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted((tuple(r) for r in q.quality_report(df).collect()), key=str)
    assert got == sorted(((r[0], *slow(r[1])) for r in rows), key=str)
    kept = q.quality_filter(df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if slow(r.text)[-1])


def test_order_does_not_change_the_verdict():
    figures = [(1.0, 0.1)] * len(q.RULES)
    figures[-1] = (0.001, 0.9)
    assert q.ordered(q.RULES, figures)[0] == q.RULES[-1]
    for t in texts():
        assert len({any(test(q.TextStats(t)) for _, test in rules) for rules in (q.RULES, q.ordered(q.RULES, figures))}) == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert q.quality_report(empty).count() == 0 and q.quality_filter(empty).count() == 0
