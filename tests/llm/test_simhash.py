import random
from itertools import combinations

import xxhash

from evidentia.llm import simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, root int"


def brute(texts):
    """Bits by counting, links by comparing all pairs."""
    fps = {}
    for i, text in texts:
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(fps, 2):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return {(i, f"{fps[i]:016x}", comp[i]) for i in fps}


def near_texts():
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(r.choices(words, k=120)) for _ in range(12)]
    texts = [(k, t) for k, t in enumerate(base)]
    for k in range(60):
        w = base[k % 12].split()
        for _ in range(k % 4):
            w[r.randrange(len(w))] = "NEW"
        texts.append((100 + k, " ".join(w)))
    return texts + [(300, None), (301, ""), (302, " \n"), (303, "One two"), (304, "one TWO")]


def test_matches_brute_force(spark):
    texts = near_texts()
    rows = [(i, t, None, None, None, "x", 1) for i, t in texts]
    got = {tuple(r) for r in simhash.simhash_components(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == brute(texts)


def test_large_bucket_is_dealt_over_several_trees(spark):
    r = random.Random(5)
    base = r.getrandbits(64)
    fps = {base} | {base ^ (1 << a) ^ (1 << b) for a, b in combinations(range(0, 40, 2), 2)}
    fps |= {r.getrandbits(64) for _ in range(50)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    df = spark.createDataFrame(signed, "fp bigint")
    one, many = (simhash.components(simhash.links(df, n)).collect() for n in (4096, 7))
    assert set(one) == set(many) and len(one) == 190


def test_one_row_of_each_group_stays(spark):
    texts = near_texts()
    rows = [(i, t, None, None, None, "x", 1) for i, t in texts] + [(0, texts[0][1], None, None, None, "x", 1), (None, "lone text of a null id here", None, None, None, None, None)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({c for _, _, c in brute(texts)} | {None}, key=str)


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.simhash_components(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_names_and_ids_of_any_kind_are_kept(spark):
    names = ["own", "low", "row", "turn", "fp", "root", "__id", "__missing", "__h", "__turn"]
    texts = [("-1", "a b c d e f"), (None, "a b c d e f"), ("x", "g h i j k l"), ("x", "g h i j k l"), (None, None), ("y", "")]
    df = spark.createDataFrame([(i, t, *range(len(names))) for i, t in texts], "doc_id string, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = simhash.drop_near_duplicates(df).collect()
    assert sorted(r.doc_id for r in out) == ["-1", "x", "y"] and all(tuple(r)[2:] == tuple(range(len(names))) for r in out)
    ids = spark.createDataFrame([(-1, "a b c d e f"), (None, "g h i j k l")], "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(ids).collect()} == {-1, None}


def test_large_stars_and_long_paths_settle(spark):
    star = [(0, k) for k in range(1, 900)] + [(5000 + k, 5001 + k) for k in range(300)] + [(7000, 7000)]
    got = {r.node: r.component_id for r in simhash.components(spark.createDataFrame(star, "u bigint, v bigint").repartition(7)).collect()}
    assert got == {**{k: 0 for k in range(1, 900)}, **{5001 + k: 5000 for k in range(300)}}


def test_a_very_long_text(spark):
    words = [f"w{k % 977}" for k in range(300_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-3]))], "doc_id bigint, text string")
    assert {r.component_id for r in simhash.simhash_components(df).collect()} == {1}
