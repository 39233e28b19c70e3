"""Ranked search against sums over every document, and against SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from kappaforge.llm import lexical_search, registry

DOCS = "doc_id long, text string, n int, terms string, tfs string, score double, rank string, item_id long"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def frame(spark, rows):
    """Documents with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(d, t, 1, "t", "f", 0.5, "r", 9) for d, t in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "item_id long, text string, doc_id int, terms string")


def terms(text):
    return re.findall(TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, asked, keep=50):
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n_docs, length = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    own = {}
    for i, t in asked:
        own.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in own.items():
        scored = []
        for d, c, n in found:
            m = 100 - 50 + (50 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if t in c)
            if score > 0:
                scored.append((-score, d is not None, d or 0))
        out += [(i, k + 1, d if there else None, -s) for k, (s, there, d) in enumerate(sorted(scored)[:keep])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    """Repeated rows and ids, null, empty, odd and long texts, rare and common words."""
    rng = random.Random(5)
    word = lambda: f"w{min(rng.randrange(400), rng.randrange(400), rng.randrange(400))}"
    docs = [(k, " ".join(word() for _ in range(rng.randint(1, 80)))) for k in range(300)]
    docs += [(400, None), (401, ""), (402, "..."), (403, "É É w1-w2 W3"), (404, "w5 " * 30_000), (5, docs[5][1]), (5, docs[6][1]), (None, docs[7][1]), (None, docs[7][1])]
    asked = [(k, " ".join(word() for _ in range(rng.randint(1, 30)))) for k in range(25)] + [(100, None), (101, ""), (102, "nowhere"), (103, "É w1"), (104, "W5"), (None, "w7 w8"), (3, "w9 w10")]
    return docs, asked


@pytest.mark.parametrize(("keep", "max_terms", "size"), [(50, 1_000_000, 1 << 20), (3, 60, 200), (50, 1_000_000, 1)])
def test_against_every_document(spark, rows, keep, max_terms, size):
    docs, asked = rows
    got = lexical_search.search(frame(spark, docs), items(spark, asked), keep, max_terms, size)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, asked, keep)


def test_empty(spark, rows):
    docs, asked = rows
    assert lexical_search.search(frame(spark, []), items(spark, asked)).collect() == []
    assert lexical_search.search(frame(spark, docs), items(spark, [])).collect() == []


@pytest.mark.parametrize("waiting", [1, 1 << 22])
def test_treap(monkeypatch, waiting):
    monkeypatch.setattr(lexical_search, "WAITING", waiting)
    rng = np.random.default_rng(2)
    grid = np.where(rng.random((50, 300)) < 0.1, rng.integers(1, 100, (50, 300)), 0)
    row, col = np.nonzero(grid)
    treap = lexical_search.Treap(row, col, grid[row, col])
    order = rng.permutation(300)
    for _ in range(10):
        rows = np.unique(rng.integers(0, 50, 12))
        total = grid[rows].sum(0)
        want = [int(c) for c in np.lexsort((order, -total)) if total[c] > 0][:20]
        got, score = treap.search(rows, 20, 1, order)
        assert got.tolist() == want and score.tolist() == total[want].tolist()


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    words = [b"aa", b"bb", b"ccc"]
    d = lexical_search.Dictionary(words)
    buf = np.frombuffer(b"bb zz aa ccc", np.uint8)
    found = d.numbers(buf, np.array([0, 3, 6, 9]), np.array([2, 5, 8, 12]))
    assert [words[k] if k >= 0 else None for k in found] == [b"bb", None, b"aa", b"ccc"]
    keys = dict(zip(words, d.keys[np.argsort(d.order)]))
    monkeypatch.setattr(d.hashing, "words", lambda buf, starts, ends: np.array([keys.get(bytes(buf[a:b]), keys[b"aa"]) for a, b in zip(starts, ends)]))
    assert d.numbers(buf, np.array([3]), np.array([5])).tolist() == [-1]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {name} as select * from '{sf}/{name}.parquet'")
    got = registry.op12_lexical_search(spark, sf)
    want = duckdb.sql(registry.ORACLES["op12_lexical_search"])
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) and got.columns == want.columns
