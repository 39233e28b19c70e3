"""Tables by key: overwriting, failed writes, races, compaction."""

import os

import pytest
from pyspark.sql import functions as F

from kappaforge.sources import keyed, readers, writers

ONE = readers.BUNDLE


def bundles(spark, rows):
    return spark.createDataFrame([(e, [("2024-01-05", "Letter", True, t) for t in texts]) for e, texts in rows], ONE)


def texts(df):
    return {r.episode_id: [n.text for n in r.notes] for r in df.collect()}


def test_last_write_wins(spark, tmp_path):
    path = str(tmp_path / "b")
    assert writers.bundle_json(bundles(spark, [("1", ["a"]), ("2", ["b"]), (None, ["n"])]), path) == 1
    assert writers.bundle_json(bundles(spark, [("2", ["c"]), ("3", ["d"]), ("3", ["e", "f"])]), path) == 2
    assert texts(readers.bundles(spark, path)) == {"1": ["a"], "2": ["c"], "3": ["e", "f"], None: ["n"]}
    # the same write again changes nothing
    assert writers.bundle_json(bundles(spark, [("2", ["c"]), ("3", ["e", "f"])]), path) == 3
    assert texts(readers.bundles(spark, path, exclude=["1"])) == {"2": ["c"], "3": ["e", "f"]}
    asked = spark.createDataFrame([("3",), ("9",)], "episode_id string")
    assert texts(readers.bundle_store(spark, path).read(asked)) == {"3": ["e", "f"]}


def test_no_folder_of_a_key(spark, tmp_path):
    path = str(tmp_path / "b")
    writers.bundle_json(bundles(spark, [(str(k), ["x"]) for k in range(500)]), path)
    assert sum(len(files) for _, _, files in os.walk(path)) < 60 and len(texts(readers.bundles(spark, path))) == 500


def test_nothing_of_a_failed_write_is_seen(spark, tmp_path):
    path = str(tmp_path / "b")
    writers.bundle_json(bundles(spark, [("1", ["a"])]), path)
    bad = bundles(spark, [(str(k), ["x"]) for k in range(50)]).withColumn("episode_id", F.when(F.col("episode_id") == "33", F.raise_error(F.lit("lost"))).otherwise(F.col("episode_id")))
    with pytest.raises(Exception, match="lost"):
        writers.bundle_json(bad, path)
    assert texts(readers.bundles(spark, path)) == {"1": ["a"]}
    # and nothing of a write that has its files but no commit
    store = readers.bundle_store(spark, path)
    bundles(spark, [("1", ["half"])]).write.parquet(f"{path}/data/unfinished")
    assert texts(store.read()) == {"1": ["a"]}
    writers.bundle_json(bundles(spark, [("2", ["b"])]), path)
    assert texts(store.read()) == {"1": ["a"], "2": ["b"]}
    store.compact()
    assert texts(store.read()) == {"1": ["a"], "2": ["b"]} and len(os.listdir(f"{path}/data")) == 1 and len(store.commits()) == 1


def test_two_writers_take_different_numbers(spark, tmp_path, monkeypatch):
    store = keyed.Store(spark, str(tmp_path / "s"), ["k"], "k string, v int")
    store.write(spark.createDataFrame([("a", 1)], "k string, v int"))
    monkeypatch.setattr(keyed.Store, "commits", lambda self: [])  # as one sees it that listed before the other's commit
    assert store.write(spark.createDataFrame([("a", 2)], "k string, v int")) == 2
    monkeypatch.undo()
    assert [tuple(r) for r in store.read().collect()] == [("a", 2)] and [n for n, _ in store.commits()] == [1, 2]


def test_search_results(spark, tmp_path):
    path = str(tmp_path / "s")
    assert readers.search_results(spark, path).collect() == []
    rows = [("e", 0, "ear", 1, [("Ear", "1"), ("Ear ache", "2")]), ("e", 0, "ear", 2, []), ("e", 1, "nose", 1, None)]
    writers.search_results(spark.createDataFrame(rows, readers.SEARCH), path)
    writers.search_results(spark.createDataFrame([("e", 0, "ears", 2, [("Both ears", "3")])], readers.SEARCH), path)
    got = {(r.label_idx, r.round): (r.term, None if r["items"] is None else [tuple(x) for x in r["items"]]) for r in readers.search_results(spark, path).collect()}
    assert got == {(0, 1): ("ear", [("Ear", "1"), ("Ear ache", "2")]), (0, 2): ("ears", [("Both ears", "3")]), (1, 1): ("nose", None)}
