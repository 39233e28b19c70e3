"""Substring and near-duplicate removal against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from kappaforge.llm import components, near_dedup, registry, substring_dedup
from kappaforge.llm.words import Hash

DOCS = "doc_id long, text string, lang string, _text string, anchors string, node string, label string"


def frame(spark, rows):
    """Documents with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(d, t, "en", "x", "y", "z", "w") for d, t in rows], DOCS)


def prose(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    shared = [prose(rng, rng.randint(30, 90)) for _ in range(6)]
    for d in range(60):
        w = prose(rng, rng.randint(0, 150))
        for s in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w = w[:at] + s[rng.randint(0, 5) :] + w[at:]
        out.append((d, rng.choice([" ", "\n", " \t"]).join(w)))
    out += [(100 + k, out[k][1]) for k in (3, 3, 9)] + [(200, None), (201, ""), (202, " \n "), (None, out[3][1]), (None, None), (7, out[7][1]), (7, out[9][1])]
    out += [(300, " ".join(prose(rng, 3000))), (301, "é ü 漢字 " * 60), (302, "é ü 漢字 " * 60 + "end")]
    # one passage in a third of all rows
    return out + [(400 + k, " ".join(prose(rng, 5) + shared[0] + prose(rng, 5))) for k in range(30)]


def removed(rows, width):
    first, words = {}, [(t or "").encode().split() for _, t in rows]
    for (d, _), w in zip(rows, words):
        for k in range(len(w) - width + 1):
            if d is not None:
                first[tuple(w[k : k + width])] = min(first.get(tuple(w[k : k + width]), d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1 if d is not None else 0):
            if first[tuple(w[k : k + width])] < d:
                gone[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [50, 20])
def test_substrings(spark, rows, width):
    got = substring_dedup.deduplicate(frame(spark, rows), width=width).collect()
    assert sorted(map(tuple, got), key=str) == removed(rows, width)


def test_substrings_by_sql(spark):
    """The SQL over a whole table, run by another engine."""
    con = duckdb.connect()
    con.execute("create view documents as select * from read_parquet('/root/testdata/sf0.001/documents.parquet')")
    got = registry.op1_substring_dedup(spark, "/root/testdata/sf0.001").select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = con.execute(registry.ORACLES["op1_substring_dedup"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and sum(x[2] for x in want) > 0


def test_substrings_empty(spark):
    assert substring_dedup.deduplicate(frame(spark, [])).collect() == []


def test_covers():
    for period, cover in substring_dedup.COVERS.items():
        assert all(any((i + s) % period in cover and (j + s) % period in cover for s in range(period)) for i in range(period) for j in range(period))


def test_hash_of_slices():
    buf = np.frombuffer(b"abc abc abd", np.uint8)
    h = Hash(1).words(buf, np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert h[0] == h[1] != h[2]


def jaccard_classes(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    return sorted((d, min((x for x in groups[find(k)] if x is not None), default=None)) for k, (d, _) in enumerate(rows) if d is not None)


def near_rows():
    rng = random.Random(3)
    out = [(k, " ".join(prose(rng, rng.randint(20, 200), 5000))) for k in range(40)]
    for k in range(40, 110):  # many near copies of one text, some of a copy
        w = out[rng.choice([0, 0, 0, 1, k - 1])][1].split()
        w[rng.randrange(len(w))] = f"n{k}"
        out.append((k, " ".join(w)))
    return out + [(200, None), (201, ""), (202, "one two"), (203, "one  two"), (None, out[5][1]), (6, out[6][1]), (6, out[6][1])]


def test_near_duplicates(spark):
    rows = near_rows()
    got = [(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    assert sorted(x for x in got if x[0] is not None) == jaccard_classes(rows)


def repeating_rows(pairs=60):
    """Texts, and copies that repeat one of their lines a hundred times and more."""
    rng = random.Random(11)
    out = []
    for k in range(pairs):
        w = prose(rng, 50, 100_000)
        out += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w + w[10:24] * rng.choice([100, 200, 300])))]
    return out


def test_near_copies_with_a_repeated_line(spark):
    rows = repeating_rows()
    got = sorted((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(frame(spark, rows)).collect())
    assert got == jaccard_classes(rows) == [(k, k - k % 2) for k in range(len(rows))]


def test_near_copies_without_ids(spark):
    rng = random.Random(12)
    rows = []
    for k in range(4):
        w = prose(rng, 80, 100_000)
        rows += [(k, " ".join(w)), (None, " ".join([*w[:-1], "end"]))]
    w = prose(rng, 80, 100_000)
    rows += [(None, " ".join(w)), (None, " ".join([*w[:-1], "end"]))]
    kept = [r.doc_id for r in near_dedup.first_of_each(frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == [0, 1, 2, 3, None]
    sizes = [(r.class_id, r.class_size) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(sizes, key=str) == [(k, 2) for k in range(4) for _ in range(2)] + [(None, 2)] * 2


def test_candidate_keys():
    rng = np.random.default_rng(6)
    doc, key = np.repeat(np.arange(4), 50), rng.integers(0, 1 << 62, 200).astype(np.uint64)
    weight = np.ones(200)
    weight[50:60], weight[150:] = 6.0, 2.0
    keys, begin = near_dedup.candidate_keys(doc, key, weight, 4)
    each = [keys[a:b] for a, b in zip(begin, begin[1:])]
    assert all(len(set(x.tolist())) == len(x) for x in each) and len(each[0]) == len(each[2]) == near_dedup.BANDS < len(each[1])
    one = near_dedup.band_keys(near_dedup.signatures(doc, key, np.ones(200), 4))
    assert all(set(a.tolist()) <= set(b.tolist()) for a, b in zip(one, each))


def linked(a, b):
    """Whether two weighted sets (shingle to weight) are linked, by the definitions."""
    both = a.keys() & b.keys()
    if not both:
        return False
    if len(both) >= 0.8 * len(a.keys() | b.keys()) - 1e-9:
        return True
    if min(sum(d[e] for e in both) / sum(d.values()) for d in (a, b)) < 0.8:
        return False  # too much of one text is not in the other
    every = [*both, *(a.keys() ^ b.keys())]
    x, y = (np.array([d.get(e, 0.0) for e in every]) for d in (a, b))
    own = np.maximum(x / x[: len(both), None], y / y[: len(both), None]).sum(1)
    return (1 / own).sum() >= 0.8 - 1e-9


def weights(text):
    w = text.split()
    count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else {tuple(w): 1} if w else {}
    return {e: 1 + math.log(n) for e, n in count.items()}


def crowd(rows=2200):
    """Families of edited copies from none to many edits, with repeated lines; families share passages; and texts of their own."""
    rng = random.Random(21)
    passages = [prose(rng, 60, 100_000) for _ in range(4)]
    out = []
    while len(out) < rows:
        base = prose(rng, rng.randint(40, 160), 100_000)
        base[10:10] = rng.choice(passages)[: rng.choice([0, 0, 30, 60])]
        for _ in range(rng.choice([1, 1, 2, 5, 60])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5, 8])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:  # other counts of the same terms
                at = rng.randrange(len(w) - 12)
                w += w[at : at + rng.randint(6, 12)] * rng.choice([1, 2, 20])
            out.append((len(out), " ".join(w)))
    return out[:rows]


def test_recall_against_every_pair(spark):
    rows = crowd()
    sets = [weights(t) for _, t in rows]
    at = defaultdict(list)
    for k, s in enumerate(sets):
        for e in s:
            at[e].append(k)
    pairs = Counter((a, b) for own in at.values() if len(own) < 400 for a in own for b in own if a < b)
    links = [(a, b) for (a, b), n in pairs.items() if n >= 5 and linked(sets[a], sets[b])]
    assert len(links) > 3000
    mixed = [x for x in links if any(w > 1 for k in x for w in sets[k].values())]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for some in (links, mixed):
        assert len(some) > 1000 and sum(got[a] == got[b] for a, b in some) >= 0.999 * len(some)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    # and no text is in a class that no chain of links leads to
    assert all(find(k) == find(c) for k, c in got.items())


def test_prefix_and_bits_lose_no_link():
    rng = random.Random(22)
    pairs = 0
    for _ in range(1500):
        w = prose(rng, rng.randint(5, 120), 10_000)
        v = list(w)
        for _ in range(rng.choice([0, 1, 2])):
            v[rng.randrange(len(v))] = "edit"
        if rng.random() < 0.5:
            at = rng.randrange(len(v))
            v += v[at : at + 12] * rng.choice([1, 3])
        a, b = weights(" ".join(w)), weights(" ".join(v))
        if not linked(a, b):
            continue
        pairs += 1
        texts = [" ".join(w).encode(), " ".join(v).encode()]
        doc, key, weight = near_dedup.shingles(np.frombuffer(b"".join(texts), np.uint8), np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])]))
        size, total = np.bincount(doc), np.bincount(doc, weight)
        bits = near_dedup.parity(doc, key, 2)
        differ = sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64))
        alone = len(set(key[doc == 0].tolist()) ^ set(key[doc == 1].tolist()))
        root = np.sqrt(total[0]) + np.sqrt(total[1])
        most = max(size.sum() / 9, (total.sum() - root * root / 2.25) if (total > size + 1e-9).any() else 0)
        assert differ <= alone <= most + 1e-6
        d, e, before, share = near_dedup.prefixes(doc, key, weight, 2, np.arange(1 << 10) % 7)
        one, two = ({k: (n, s) for x, k, n, s in zip(d, e, before, share) if x == side} for side in (0, 1))
        first = next(k for k in one if k in two)
        (ca, sa), (cb, sb) = one[first], two[first]
        plain = 1.8 * min(size[0] - ca, size[1] - cb) >= 0.8 * size.sum() - 1e-6
        assert plain or (1 - sa) * (1 - sb) >= 0.8 * (1 - sa * sb) - 1e-6
    assert pairs > 500


def test_near_rows_of_other_kinds(spark):
    """Very long texts, a table of repeated rows only, and columns with the names of inner ones."""
    rng = random.Random(23)
    long_ = prose(rng, 40_000, 10**6)
    rows = [(1, " ".join(long_)), (2, " ".join([*long_[:-50], *["x"] * 50])), (3, " ".join(long_[:20_000])), (4, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g")]
    names = "doc_id long, text string, node string, _node string, _id int, first_id int, NODE_ string, class_id long, bands string"
    docs = spark.createDataFrame([(d, t, "n", "m", k, 1, "o", 5, "b") for k, (d, t) in enumerate(rows)], names)
    kept = near_dedup.first_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert sorted((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(docs).collect()) == [(1, 1), (2, 1), (3, 3), (4, 4), (4, 4), (4, 4)]


def test_first_of_each(spark):
    rows = near_rows()
    kept = near_dedup.first_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({c for d, c in jaccard_classes(rows)})
    assert near_dedup.first_of_each(frame(spark, [])).count() == 0


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    a, b = keys[:250], keys[50:]
    wa, wb = 1 + rng.random(250) * 3, 1 + rng.random(250) * 3
    doc = np.repeat([0, 1], 250)
    agree = []
    for salt in range(30):
        s = near_dedup.signatures(doc, np.concatenate([a, b]) ^ np.uint64(salt * 7919), np.concatenate([wa, wb]), 2)
        agree.append((s[0] == s[1]).mean())
    pa, pb = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    want = sum(1 / sum(max(pa.get(e, 0) / pa[d], pb.get(e, 0) / pb[d]) for e in {*pa, *pb}) for d in set(pa) & set(pb))
    assert abs(np.mean(agree) - want) < 0.03
    plain = len(set(pa) & set(pb)) / len({*pa, *pb})
    assert abs(near_dedup.similarity((a, wa), (b, wb)) - max(want, plain)) < 1e-6


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 30)] + [(100, 50), (50, 75), (5, 5), (200, 201), (201, 200)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {50: 50, 75: 50, 100: 50, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_windows_that_differ_in_one_likely_colliding_word(spark):
    """Two words of 1,024 letters that a polynomial modulo 2**64 gives one hash."""
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    x, y = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    same = " ".join(f"w{k}" for k in range(49))
    got = {r.doc_id: r.n_removed for r in substring_dedup.deduplicate(frame(spark, [(1, f"{same} {x}"), (2, f"{same} {y}"), (3, f"{same} {x}")])).collect()}
    assert got == {1: 0, 2: 0, 3: 50}


def test_one_very_long_text(spark):
    """A passage of 60 words in the middle of 200,000 others."""
    passage = " ".join(f"p{k}" for k in range(60))
    words = " ".join(f"u{k}" for k in range(100_000))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.deduplicate(frame(spark, [(1, passage), (2, f"{words} {passage} {words[::-1]}")])).collect()}
    assert got == {1: (60, 0), 2: (200_060, 60)}
