"""The vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import retrieval as R
from evidentia.operators import vectors as X

SCHEMA = "id bigint, vector array<float>, label int"


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(3)
    middle = r.normal(size=(30, 16))
    rows = [(k, (middle[k % 30] + r.normal(size=16) * 0.3).astype(np.float32).tolist(), k % 4) for k in range(3000)]
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [float("inf")] + [1.0] * 15, 1), (9005, [None] * 16, 1), (9006, rows[0][1], 0)]
    return spark.createDataFrame(rows + odd, SCHEMA), rows


def nearest(rows, k):
    return R.top(rows, [F.asc("distance"), F.asc("id")], k)


def test_few_cells_hold_nearly_all_neighbours(spark, clustered, tmp_path):
    df, rows = clustered
    folder = str(tmp_path / "v")
    told = X.build(df, folder)
    assert told["cells"] == 55 and told["probes"] <= 12 and told["recall"] >= 0.95
    shares = []
    for k in (0, 7, 500, 1234, 2999):
        probe = rows[k][1]
        brute = nearest(df.where("id < 9000 OR id = 9006").withColumn("distance", R.cosine_distance(F.col("vector"), probe)), 40)
        shares.append(X.measured_recall(nearest(X.search(spark, folder, probe), 40), brute))
        exact = nearest(X.search(spark, folder, probe, exact=True), 40)
        assert [(r.id, round(r.distance, 12)) for r in exact.orderBy("rank").collect()] == [(r.id, round(r.distance, 12)) for r in brute.orderBy("rank").collect()]
    assert np.mean(shares) >= 0.9
    plan = spark._jvm.PythonSQLUtils.explainString(X.search(spark, folder, rows[0][1])._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [cell#" in plan
    scope = spark.createDataFrame([(0,), (9006,), (4,)], "id bigint")
    assert {r.id for r in X.search(spark, folder, rows[0][1], exact=True, scope=scope).collect()} == {0, 4, 9006}
    assert X.search(spark, folder, [0.0] * 16).count() == 0 and "label" in X.search(spark, folder, rows[0][1]).columns


def test_small_and_empty_tables(spark, tmp_path):
    X.build(spark.createDataFrame([(1, [1.0, 0.0], 1)], SCHEMA), str(tmp_path / "one"))
    assert [r.id for r in X.search(spark, str(tmp_path / "one"), [1.0, 1.0]).collect()] == [1]
    X.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert X.search(spark, str(tmp_path / "none"), [1.0, 1.0]).count() == 0
