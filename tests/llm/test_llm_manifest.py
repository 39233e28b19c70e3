"""Merkle manifests against plain trees."""

import hashlib
import random
import zlib

import duckdb
import pytest

from kappaforge.llm import merkle_manifest, registry

DOCS = "doc_id long, source string, lang string, n_chars long, text string, grp string, digest string, path string, size int, _task int, lo int"


def frame(spark, rows):
    """Documents with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, "g", "d", "p", 1, 2, 3) for r in rows], DOCS)


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path_of(levels, i):
    path = []
    for level in levels[:-1]:
        a = i // 16 * 16
        run = level[a : a + 16]
        path.append(("".join(run[: i - a]), "".join(run[i - a + 1 :])))
        i //= 16
    return path


def plain(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels_of([leaf(r) for r in groups[g]]) for g in order}
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path, folded = path_of(trees[g], i) + path_of(top, k), leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                folded = leaf((*r[:4], None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in path:
                folded = H(a + folded + b)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], H("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


def test_drill_against_plain_trees(spark):
    """A group of three levels, groups of one row, null fields, ids and groups, equal ids and equal rows, long and empty texts."""
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", "ä", None, "src", "src"]), "en", k, f"Text {k} É" if k % 7 else None) for k in range(700)]
    rows += [(k + 1000, f"s{k}", "en", 1, "X" * (k % 2)) for k in range(40)] + [(None, "a", None, None, "N")] * 2 + [(5, "a", "en", 5, "other"), (6000, "b", "en", 1, "Long É " * 50_000)]
    got = merkle_manifest.drill(frame(spark, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain(rows)
    assert ordered(got.collect()) == ordered(want) and any(not r[-1] for r in want)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_sizes(spark, n):
    rows = [(k, "one", "en", k, "A") for k in range(n)]
    assert ordered(merkle_manifest.drill(frame(spark, rows)).collect()) == ordered(plain(rows))


def test_empty(spark):
    assert merkle_manifest.drill(frame(spark, [])).collect() == []


def test_manifest_nodes(spark):
    leaves = spark.createDataFrame([("a" if k % 3 else None, k, H(str(k))) for k in range(100)], "grp string, key long, digest string")
    found = merkle_manifest.build(leaves, 4)
    nodes = found.nodes().collect()
    own = [r for r in nodes if r.tree == "group" and r.grp == "a"]
    assert sorted((r.level, r.lo, r.hi) for r in own if r.level) == sorted((k, a, min(a + 4**k, 66)) for k in range(1, 5) for a in range(0, 66, 4**k))
    assert [r.digest for r in nodes if r.tree == "top" and r.level == 1] == [found.root] and sum(r.level == 0 for r in nodes) == 102
    assert all(r.h == found.root for r in found.proofs().select(merkle_manifest.fold(merkle_manifest.F.col("digest"), merkle_manifest.F.col("path")).alias("h")).collect())


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    got = registry.op13_merkle_manifest(spark, sf)
    want = duckdb.sql(registry.ORACLES["op13_merkle_manifest"])
    assert ordered(got.collect()) == ordered(want.fetchall()) and got.columns == want.columns
