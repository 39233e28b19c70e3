"""Word vectors against a dense decomposition, and the closest allowed value."""

import random
from collections import Counter

import numpy as np
import pytest

from kappaforge.functions import labels
from kappaforge.operators import vectors
from kappaforge.plans import registry


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    topics = [[f"a{k}" for k in range(8)], [f"b{k}" for k in range(8)], [f"c{k}" for k in range(8)]]
    out = [" ".join(rng.choice(topics[k % 3]) for _ in range(rng.randint(1, 40))) for k in range(120)]
    return [*out, None, "", "...", "É é A0, a1; B2_c3", out[0]]


def tokens(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def dense(texts, known, reach):
    """The positive mutual information of every pair of words, by plain loops."""
    at = {w: k for k, w in enumerate(known)}
    n = np.zeros((len(known), len(known)))
    for t in texts:
        w = tokens(t)
        for i, x in enumerate(w):
            for j in range(max(0, i - reach), min(len(w), i + reach + 1)):
                if j != i and x in at and w[j] in at:
                    n[at[x], at[w[j]]] += 1
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.maximum(0, np.log(n * n.sum() / np.outer(n.sum(1), n.sum(0)))), nan=0, posinf=0, neginf=0)


def test_against_dense(spark, texts):
    frame = spark.createDataFrame([(t, "w", 1) for t in texts], "text string, words string, a int").repartition(5)
    found = vectors.learned(frame, size=25, dim=25, reach=3)
    counts = Counter(w for t in texts for w in tokens(t))
    known = sorted(counts, key=lambda w: (-counts[w], w))[:25]
    assert list(found.words) == known
    matrix = dense(texts, known, 3)
    values, basis = np.linalg.eigh(matrix)
    want = basis * np.sqrt(np.abs(values))
    # vectors are told up to a rotation: compare their products
    assert np.allclose(found.matrix @ found.matrix.T, want @ want.T, atol=1e-6)


def test_a_sketch_keeps_the_largest_directions(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    found = vectors.learned(frame, size=25, dim=3)
    assert found.matrix.shape == (25, 3)
    near, far = found.similarity("a0 a1", "A2"), found.similarity("a0 a1", "b2")
    assert near > 0.5 > far and found.similarity("a0", "unknown") == 0.0 and found.similarity("", "a0") == 0.0


def test_nothing_to_learn(spark):
    found = vectors.learned(spark.createDataFrame([(None,), ("...",)], "text string"))
    assert found.words == {} and found.similarity("a", "b") == 0.0


def test_closest(spark):
    same = vectors.Vectors({"operation": 0, "procedures": 0}, np.ones((1, 1)))
    assert labels.closest("left-sided ear", labels.ALLOWED["laterality"], "laterality") == ("left", 1.0)
    raw = spark.createDataFrame([("qualifier", "operation"), ("qualifier", "na"), ("qualifier", None), ("laterality", "RIGHT ear"), ("context", "left alone")], "field string, raw string")
    got = {(r.field, r.raw): (r.best, r.score) for r in labels.closest_values(raw, spark.sparkContext.broadcast(same)).collect()}
    assert got.keys() == {("qualifier", "operation"), ("qualifier", "na"), ("qualifier", None), ("laterality", "RIGHT ear")}
    assert got["qualifier", "operation"][0] == "Procedures" and got["qualifier", "operation"][1] == pytest.approx(0.4 + 0.3 * 2 * labels.ratio("operation", "procedures"))
    assert got["qualifier", "na"] == got["qualifier", None] == ("NA", 0.0) and got["laterality", "RIGHT ear"] == ("right", 1.0)


def test_query(spark):
    rows = registry.q_closest_match(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 20 and {r.best for r in rows if r.field == "qualifier"} <= {"Diagnoses", "Procedures", "NA"}
    assert {r.raw: r.best for r in rows if r.field == "laterality"}["left-sided"] == "left" and all(0 <= r.score <= 1.2 for r in rows)
