import random
import zlib

from evidentia.llm import substring_dedup as sd

DOCS = "doc_id bigint, text string, span string, at int, n_chars bigint"


def brute(rows):
    """First occurrences in a plain dictionary over spans as texts; rows are (doc_id, text) with distinct ids."""
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        if t is None:
            out[i] = None
            continue
        bounds = sd.sentence_bounds(t)
        units = [t[a:b] for a, b in zip(bounds, bounds[1:])]
        norm = [" ".join(u.lower().rstrip().rstrip(sd.MARKS).split()) for u in units]
        gone = set()
        total = lambda a, b: sum(len(x.split()) for x in norm[a:b])
        enough = lambda a, b: 0 <= a and (b - a >= 2 and total(a, b) >= sd.MIN_WORDS or b - a >= sd.SEVERAL)
        for a in range(len(units)):
            for b in range(a + 2, len(units) + 1):
                if enough(a, b) and not (enough(a, b - 1) and enough(a + 1, b)):
                    key = tuple(norm[a:b])
                    if seen.setdefault(key, (i, a)) != (i, a):
                        gone |= set(range(a, b))
        out[i] = "".join(u for k, u in enumerate(units) if k not in gone)
    return out


def texts():
    r = random.Random(4)
    vocab = [f"v{k}" for k in range(300)]
    sentence = lambda: " ".join(r.choices(vocab, k=r.choice([1, 2, 4, 9, 20]))).capitalize() + r.choice([". ", ", ", "\n", "!\n", ".\n\n"])
    passage = ["".join(sentence() for _ in range(9)) for _ in range(3)]
    rows = []
    for i in range(40):
        parts = [sentence() for _ in range(12)]
        if i % 3 == 0:
            parts.insert(r.randrange(12), passage[i % 2])
        if i % 10 == 5:
            parts += [passage[2], passage[2]]
        rows.append((i, "".join(parts)))
    return rows + [(50, None), (51, ""), (52, " \n"), (53, rows[1][1]), (54, "no marks " * 40), (None, rows[2][1] + "One more")]


def test_matches_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)
    for n in (1, 7):
        out = sd.substring_dedup(df.repartition(n))
        assert out.columns == [*df.columns, "dedup"]
        assert {r.doc_id: r.text for r in out.collect()} == brute(rows)
    for r in out.collect():
        t = dict(rows)[r.doc_id]
        assert r.dedup.n_removed_chars == (len(t) - len(r.text) if t else 0)


def plain_bounds(text):
    """Ends of sentences character by character, then of the least words window by window."""
    ends, k = [], 0
    while k < len(text):
        j = k
        while j < len(text) and text[j] in ".!?,;:":
            j += 1
        q = j
        while j > k and q < len(text) and text[q] in "\"')]":
            q += 1
        if j > k and q < len(text) and text[q].isspace() or text[k] == "\n":
            k = q if j > k else k
            while k < len(text) and text[k].isspace():
                k += 1
            ends.append(k)
        else:
            k += 1
    out = {0, len(text), *ends}
    for a, b in zip([0, *ends], [*ends, len(text)]):
        places, k = [], a
        while k < b:
            w = k
            while k < b and not text[k].isspace():
                k += 1
            word = text[w:k]
            while k < b and text[k].isspace():
                k += 1
            if word:
                places.append((zlib.crc32(word.lower().rstrip(sd.MARKS).encode()), k))
        for i in range(len(places) - sd.WINDOW + 1):
            window = list(enumerate(places[i : i + sd.WINDOW]))
            n, (_, end) = min(window, key=lambda x: (x[1][0], -x[0]))
            if i + n < len(places) - 1:
                out.add(end)
    return sorted(out)


def test_bounds_equal_plain_loops():
    r = random.Random(2)
    word = lambda: r.choice(["a", "Bb", "ccc", "é", "dd.e", "ff,", "g!", "h.\")", "i", "j", "kk", "lll", "mm", "n1", "o2", "p3"])
    assert sd.sentence_bounds("") == [0, 0]
    for n in (1, 5, 12, 13, 14, 40, 300):
        for _ in range(6):
            text = "".join(word() + r.choice([" "] * 9 + ["  ", "\n", "\t"]) for _ in range(n)).strip(" ")
            assert sd.sentence_bounds(text) == plain_bounds(text), text


def test_repeated_rows_fare_alike(spark):
    t = "One two three four five six seven eight nine ten eleven twelve, thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty. The end of this text is near now."
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (2, "other " + t)], "doc_id bigint, text string")
    out = sorted((r.doc_id, r.text) for r in sd.substring_dedup(df).collect())
    assert out == [(1, t), (1, t), (2, ""), (2, "other " + t)]


def test_passage_inside_one_sentence_is_found(spark):
    r = random.Random(8)
    draw = lambda n: " ".join(f"u{r.randrange(10**6)}" for _ in range(n))
    rows = []
    for k in range(60):
        passage = draw(51 + k % 10)
        rows += [(2 * k, f"{draw(k % 15)} {passage} {draw(9)}"), (2 * k + 1, f"{draw(40)} {passage} {draw(k % 30)}. {draw(5)}")]
    out = {x.doc_id: x.dedup.n_removed_chars for x in sd.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all((out[i] > 100) == (i % 2 == 1) for i in out)


def test_runs_of_short_sentences_are_found(spark):
    short = "Go. Stop. Wait here. No. Yes. Come, please. "
    rows = [(1, "Own words of one. " + short + "End of one."), (2, short), (3, "Other, words. " + short[:30] + "and more of it.")]
    out = {r.doc_id: r.text for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[1] == rows[0][1] and out[2] == "" and out[3] == rows[2][1]


def test_a_frequent_span_leaves_few_rows():
    import pyarrow as pa

    passage = "One two three four five six seven, eight nine ten eleven twelve thirteen fourteen fifteen, sixteen seventeen eighteen nineteen twenty and some more words to it. "
    n, ids = 0, []
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 50)), pa.array(range(50)), pa.array([passage + f"x{i}. y{i}." for i in range(50)])], ["id", "h", "text"]) for k in range(0, 500, 50)]
    for b in sd._postings(batches):
        n += sum(x >= 0 for x in b.column(3).to_pylist())
        ids += b.column(1).to_pylist()
    assert set(ids) == set(range(500)) and n < len(ids) - 490


def test_clashing_names_and_a_very_long_text(spark):
    names = ["id", "text_hash", "span", "place", "turn", "at", "row"]
    long = " ".join(f"word{k} of{k % 7}" + (".", ",", "")[k % 3] for k in range(60_000))
    rows = [(k, t, *range(len(names))) for k, t in ((1, long), (2, "Before it. " + long), (3, None), (4, ""))]
    out = {r.doc_id: r for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` int" for n in names))).collect()}
    assert all(tuple(r)[2:-1] == tuple(range(len(names))) for r in out.values())
    assert out[1].text == long and out[2].text.startswith("Before it.") and len(out[2].text) < 60 and out[3].text is None and out[4].text == ""


def test_empty_table(spark):
    assert sd.substring_dedup(spark.createDataFrame([], DOCS)).count() == 0
