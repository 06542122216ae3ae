import json

from pyspark.sql import functions as F

from evidentia.sources import files, sinks


def test_files_and_uploads(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\ntext")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "c.pdf").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[-1]: r.length for r in files.listing(spark, str(tmp_path)).collect()}
    assert got == {"a.md": 8, "b.pdf": 10, "c.pdf": 7} and files.latest(files.listing(spark, str(tmp_path)), 2).count() == 2
    assert [r.text for r in files.texts(spark, str(tmp_path)).collect()] == ["# A\ntext"]
    assert {r.path.rsplit("/", 1)[-1]: r.accepted for r in files.uploads(spark, str(tmp_path)).collect()} == {"a.md": False, "b.pdf": True, "c.pdf": False}


def test_metadata_payloads(spark):
    body = json.dumps({"message": {"items": [{"DOI": "10.1/x", "title": ["T"], "abstract": "<p>A b</p>", "issued": {"date-parts": [[2021, 3]]}}, {"DOI": "10.1/y", "title": ["U"], "issued": {"date-parts": [[2020]]}}]}})
    rows = spark.createDataFrame([(body,)], "p string").select(F.inline(files.crossref_records(F.col("p")))).collect()
    assert [tuple(r) for r in rows] == [("10.1/x", "T", "2021-03", "A b"), ("10.1/y", "U", "2020", None)]
    feed = "<feed><entry><id>1</id><title> One </title><published>2020-01-02T00:00:00Z</published></entry><entry><id>2</id><title>Two</title><published>2021-01-02</published></entry></feed>"
    rows = spark.createDataFrame([(feed,)], "p string").select(F.inline(files.atom_records(F.col("p")))).collect()
    assert [tuple(r) for r in rows] == [("1", "One", "2020-01-02"), ("2", "Two", "2021-01-02")]


def test_writes_can_be_repeated(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, v string")
    for _ in range(2):
        sinks.append_new(rows, str(tmp_path / "t"), ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.replace_partitions(rows, str(tmp_path / "p"), ["id"])
    sinks.replace_partitions(spark.createDataFrame([(2, "c")], "id bigint, v string").select("v", "id"), str(tmp_path / "p"), ["id"])
    assert {(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, "a"), (2, "c")}
    for k in (1, 2):
        sinks.publish(rows.limit(k), str(tmp_path / "g"))
    assert sinks.published(spark, str(tmp_path / "g")).count() == 2
