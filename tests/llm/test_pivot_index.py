import numpy as np

from evidentia.llm import pivot_index

ROWS = "vec_id bigint, embedding array<float>, label int, node string, i int"


def corpus():
    r = np.random.default_rng(5)
    rows, n = [], 0
    for label in (0, 1, 2):
        centres = r.standard_normal((12, 48))
        for c in centres:
            for _ in range(r.integers(1, 9)):
                rows.append((n, (c + 0.13 * r.standard_normal(48)).astype(np.float32), label))
                n += 1
    rows += [(n + k, rows[k][1], rows[k][2]) for k in (3, 3, 8)]
    n += 10
    rows += [(n, rows[0][1], 1), (n + 1, rows[0][1] * 2, 0), (n + 2, rows[0][1], None)]
    return rows


def brute(rows):
    links = {i: set() for i, *_ in rows}
    for i, x, a in rows:
        for j, y, b in rows:
            if i < j and a is not None and a == b:
                x2, y2 = x.astype(float), y.astype(float)
                if x2 @ y2 / np.sqrt((x2 @ x2) * (y2 @ y2)) >= 0.98 - 1e-13:
                    links[i].add(j)
                    links[j].add(i)
    comp = {}
    for i in sorted(links):
        stack = [i]
        while stack:
            k = stack.pop()
            if k not in comp:
                comp[k] = i
                stack += links[k]
    return {(i, len(links[i]), comp[i], comp[i] == i) for i in links}


def test_matches_brute_force(spark):
    rows = [(r[0], r[1], r[2]) for r in corpus()]
    ids = {}
    rows = [(ids.setdefault(k, k), x, a) for k, (_, x, a) in enumerate(rows)]
    df = spark.createDataFrame([(i, x.tolist(), a, "x", 1) for i, x, a in rows], ROWS).repartition(3)
    want = brute(rows)
    assert sum(n for _, n, *_ in want) > 100
    exact = {i: n for i, n, *_ in want}
    one, many = ({tuple(r) for r in pivot_index.near_duplicates(df, block=block).collect()} for block in (2048, 3))
    assert one == many and len(one) == len(rows)
    assert all(n <= exact[i] for i, n, *_ in one) and sum(n for _, n, *_ in one) >= 0.97 * sum(exact.values())
    assert len(one & want) >= 0.9 * len(want)


def test_unsound_rows_link_with_nothing(spark):
    one = [1.0, 0.0, 2.0]
    rows = [(1, one, 0), (2, one, 0), (3, None, 0), (4, [0.0, 0.0, 0.0], 0), (5, [1.0, None, 2.0], 0), (6, [float("nan"), 0.0, 2.0], 0), (7, one, None), (None, one, 0), (8, [], 0), (9, [1.0, 0.0], 0), (2, one, 0)]
    out = pivot_index.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)).collect()
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in out)
    assert got == sorted([("1", 2, 1, True), ("2", 2, 1, False), ("2", 2, 1, False), ("None", 0, None, False), *((str(k), 0, k, True) for k in range(3, 10))])


def test_empty_table(spark):
    assert pivot_index.near_duplicates(spark.createDataFrame([], ROWS)).count() == 0
