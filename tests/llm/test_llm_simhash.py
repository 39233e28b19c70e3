"""SimHash against every pair of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from kappaforge.llm import registry, simhash

DOCS = "doc_id long, text string, print string, first_id string, component_id int, label string, node string, tile int, c0 int"


def frame(spark, rows):
    """Documents with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(d, t, "p", "f", 1, "l", "n", 1, 2) for d, t in rows], DOCS)


def fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = np.array([fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints) <= 4
    label = np.arange(len(rows))
    while True:
        new = np.where(near, label[None], len(rows)).min(1)
        if (new == label).all():
            break
        label = new
    ids = {x: min((rows[k][0] for k in np.flatnonzero(label == x) if rows[k][0] is not None), default=None) for x in set(label.tolist())}
    return sorted(((d, f"{int(p):016x}", ids[x]) for (d, _), p, x in zip(rows, prints, label.tolist())), key=str)


def changed(rng, words):
    out = list(words)
    for _ in range(rng.randint(0, 3)):
        out[rng.randrange(len(out))] = f"n{rng.randrange(9)}"
    return " ".join(out)


@pytest.mark.parametrize("size", [8, 4096])
def test_components(spark, size):
    """Near copies in groups, repeated rows and ids, short, empty, null, long and upper-case texts; tiles of any size."""
    rng = random.Random(3)
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.randint(60, 300))] for _ in range(25)]
    rows = [(k, changed(rng, rng.choice(base))) for k in range(240)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "One two"), (304, "one  TWO"), (305, "É È ÀÉ x y"), (306, "é è àé x y"), (None, rows[3][1]), (None, "alone of all texts here"), (7, rows[7][1]), (7, rows[11][1])]
    rows += [(400, "Long Text " * 40_000), (401, "long text\x1cé " * 3000)]
    got = sorted(map(tuple, simhash.near_duplicates(frame(spark, rows), size=size).collect()), key=str)
    want = brute(rows)
    assert got == want and len({c for _, _, c in want}) < 200


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("n", [1, 40, 700])
def test_forest_joins_what_pairs_join(n):
    rng = np.random.default_rng(n)
    seed = rng.integers(0, 1 << 64, 5, np.uint64)
    near = np.unique(seed[rng.integers(0, 5, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)))
    half = len(near) // 2 or 1
    for a, b in ((near, None), (near[:half], near[half:])):
        if b is not None and not len(b):
            continue
        every = near
        x, y = simhash.forest(a, b)
        assert len(x) < max(1, len(every)) and all(bin(int(p ^ q)).count("1") <= 64 for p, q in zip(x, y))
        up = {int(p): int(p) for p in every}

        def find(p):
            while up[p] != p:
                p = up[p]
            return p

        want = dict(up)
        for p, q in zip(x.tolist(), y.tolist()):
            up[find(p)] = find(q)
        got = {p: find(p) for p in up}
        up = want
        for p in (a if b is None else a).tolist():
            for q in (a if b is None else b).tolist():
                if bin(p ^ q).count("1") <= 4:
                    up[find(p)] = find(q)
        groups = lambda f: sorted(sorted(p for p in f if f[p] == r) for r in set(f.values()))
        assert groups(got) == groups({p: find(p) for p in up})


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, registry.op11_simhash(spark, sf).collect()), key=str) == brute(rows)
