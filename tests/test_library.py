import pytest
from pyspark.sql import functions as F

from evidentia.library import Library


def make(spark):
    papers = spark.createDataFrame(
        [(1, "alpha beta gamma words of one", "parsed", "a", "f1"), (2, "alpha beta gamma words of one", None, "a", None), (3, "delta_x epsilon alpha", None, "b", None), (4, "hidden alpha", "off_topic", "b", "f4"), (5, "nothing here", "downloaded", "b", None)],
        "id bigint, text string, status string, category string, fulltext_path string",
    )
    organisation = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)], "paper_id bigint, canonical_id bigint")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.9, 0.1]), (4, [1.0, 0.0]), (5, [0.0, 1.0])], "id bigint, vector array<double>")
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q")], "conv_id bigint, turn bigint, role string, text string")
    events = spark.createDataFrame([(k, 1) for k in range(10)], "event_id bigint, user_id bigint")
    return Library(papers, organisation, vectors, turns, events)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_catalog(spark):
    lib = make(spark)
    assert ids(lib.visible()) == [1, 3, 5] and ids(lib.page(0, 2)) == [1, 3] and ids(lib.page(1, 2)) == [5]
    assert ids(lib.page(0, text="BETA")) == [1] and ids(lib.page(0, text="delta_")) == [3] and ids(lib.page(0, text="delta%")) == []
    assert ids(lib.page(0, status="metadata_only")) == [3] and ids(lib.missing()) == [3, 5] and ids(lib.detail(2)) == [1, 2]
    assert {r.id: r.status for r in lib.set_status([3, 3, 99], "parsed").collect()}[3] == "parsed"
    assert {r.category: r.n for r in lib.categories().collect()} == {"a": 1, "b": 2}


def test_search_stays_in_scope(spark):
    lib = make(spark)
    hits = [r.id for r in lib.search("alpha delta", [1.0, 0.0]).orderBy("rank").collect()]
    assert set(hits) == {1, 3, 5} and hits[0] in (1, 3) and 4 not in hits
    assert ids(lib.search("alpha", [1.0, 0.0], ids=[3])) == [3]


def test_no_id_is_dropped_silently(spark):
    lib = make(spark)
    with pytest.raises(ValueError):
        lib.set_status(range(501), "parsed")
    assert ids(lib.search("alpha", [1.0, 0.0], ids=[*range(1000, 1200), 3, 3])) == [3]


def test_sessions_quotes_and_index(spark):
    lib = make(spark)
    assert [r.turn_id for r in lib.numbered_turns().orderBy("conv_id", "turn").collect()] == [1, 1, 1]
    assert lib.without_sessions(spark.createDataFrame([(1,)], "conv_id bigint")).count() == 1
    assert [r.event_id for r in lib.events_after(6, 2).orderBy("event_id").collect()] == [7, 8]
    quotes = spark.createDataFrame([(1, "beta  gammawords of"), (2, "too short")], "quote_id bigint, quote string")
    assert sorted((r.id, r.start, r.end) for r in lib.quotes(quotes).collect()) == [(1, 6, 25), (2, 6, 25)]
    current = lib.papers.where("id <> 5").select("id", F.sha2("text", 256).alias("sha"))
    assert ids(lib.outdated(current)) == [5]


def test_a_stored_index_answers_for_visible_papers_as_they_are_now(spark, tmp_path):
    lib, folder = make(spark), str(tmp_path / "index")
    assert lib.index(folder) == {"reused": 0, "indexed": 5, "pruned": 0} and lib.index(folder)["reused"] == 5
    assert ids(lib.find(folder, "alpha")) == [1, 3] and ids(lib.find(folder, "alpha", ids=[3, 4])) == [3]
    hit = lib.find(folder, "epsilon").first()
    assert (hit.id, hit.start, hit.end, hit.methods) == (3, 0, 21, ["text"])
    lib.papers = lib.papers.withColumn("text", F.when(F.col("id") == 3, "other words").otherwise(F.col("text"))).where("id <> 1")
    assert ids(lib.find(folder, "alpha")) == []
    assert lib.index(folder) == {"reused": 3, "indexed": 1, "pruned": 1} and ids(lib.find(folder, "other")) == [3]
