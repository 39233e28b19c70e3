"""Containment of probes and as-of joins against plain search."""

import random

import numpy as np
import pytest

from kappaforge.operators import asof, containment


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "p", 5) for k, t in enumerate(texts)], "id int, body string, _probe string, slot int")


def plain(texts, probes):
    return sorted((k, p) for k, t in enumerate(texts) for p in set(probes) if t is not None and p in t)


@pytest.mark.parametrize("places", [(20, 24), (3, 6)])
def test_contained(spark, places):
    """Tables with places enough, and so small that nearly all windows pass: the result is the same."""
    rng = random.Random(places[0])
    texts = ["".join(rng.choice("ab  ") for _ in range(rng.randint(0, 300))) for _ in range(80)] + [None, "", "x" * 5000, "abc"]
    probes = []
    for _ in range(60):
        t = rng.choice(texts[:80])
        at = rng.randint(0, max(0, len(t) - 12))
        probes.append(t[at : at + rng.randint(12, 60)])
    probes = [p for p in probes if len(p) >= 12] + ["x" * 12, "x" * 60, "x" * 59 + "y", probes[0]]
    got = containment.contained(frame(spark, texts), "body", spark.createDataFrame([(p, 1) for p in probes], "probe string, n int"), places)
    assert got.columns == ["probe", "id", "_probe", "slot"]
    assert sorted((r.id, r.probe) for r in got.collect()) == plain(texts, probes)


def test_contained_over_steps_and_nothing(spark):
    text = "".join(random.Random(2).choice("abcdef ") for _ in range(3000))
    probes = [text[k : k + n] for k, n in ((0, 60), (10, 60), (60, 12), (63, 13), (64, 60), (2940, 60), (2988, 12))]
    ask = spark.createDataFrame([(p,) for p in probes], "probe string")
    assert sorted((r.id, r.probe) for r in containment.contained(frame(spark, [text, text[::-1]]), "body", ask, step=64).collect()) == plain([text, text[::-1]], probes)
    assert containment.contained(frame(spark, [text]), "body", ask.limit(0)).collect() == []
    assert containment.contained(frame(spark, []), "body", ask).collect() == []


def test_no_more_windows_than_hits_leave_a_task(spark):
    """The tables let through what probes are, and next to nothing else: 200 probes, texts of common words."""
    sf = "/root/testdata/sf0.01"
    from kappaforge.functions.texts import canon, probe
    from pyspark.sql import functions as F

    probes = spark.read.parquet(f"{sf}/benchmark.parquet").select(probe(canon(F.col("text"))).alias("probe")).where("probe is not null")
    texts = [r.t.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select(canon(F.col("text")).alias("t")).where("t is not null").collect()]
    tables = containment._tables(probes).value
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    windows = sum(len(rows) for rows, _, _ in containment._windows(np.frombuffer(b"".join(texts), np.uint8), offsets, tables))
    asked = {r.probe.encode() for r in probes.collect()}
    hits = sum(p in t for p in asked for t in texts)
    assert hits and windows <= 2 * hits


def test_around(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 400)) for _ in range(500)] + [("c", 5), ("d", None), ("a", None)]
    values = [(rng.choice(["a", "a", "b", None]), rng.randint(0, 400)) for _ in range(90)] + [("a", None), ("e", 3), ("a", 7), ("a", 7)]
    got = asof.around(spark.createDataFrame(rows, "g string, t int").repartition(5), spark.createDataFrame(values, "g string, v int"), ["g"], "t", "v").collect()
    of = lambda g: [v for h, v in values if h == g and v is not None]
    want = {(g, t): (max((v for v in of(g) if v <= t), default=None), min((v for v in of(g) if v >= t), default=None)) for g, t in rows if t is not None}
    assert {(r.g, r.t): (r.before, r.after) for r in got} == want and len(got) == len(want)


def test_around_deals_a_large_group(spark):
    """A group of all rows is in several tasks, and values are found over their borders."""
    rows = spark.range(20_000).selectExpr("'one' as g", "id * 10 as t")
    values = spark.createDataFrame([("one", 5), ("one", 100_005), ("one", 199_995)], "g string, v long")
    found = asof.around(rows, values, ["g"], "t", "v")
    # the windows that look beyond a task see one row a group and task
    assert found.where("before is null").count() == 1 and found.where("after is null").count() == 0
    assert found.where("t = 100000").first()[2:] == (5, 100_005) and found.where("t = 199990").first()[2:] == (100_005, 199_995)
