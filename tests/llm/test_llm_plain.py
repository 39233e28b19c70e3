"""Scores of the classifiers against plain scorers: one text at a time, from the fitted tables and weights."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from kappaforge.llm import license_templates, quality_gam, quality_rules, text_stats, toxicity_pu

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "word", "a b c d e f g h i j", "x # $ %\nline\nline\n\nline ", "é漢 😀 |" * 3, "rep eat ed wo rds " * 9, "#" * 700, "SHOUT Shout! Really? Yes. 12 3", "tab\tand\x0bfeed\n\n\nx " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(1_000_000 + k, t) for k, t in enumerate(ODD)] + [(1_000_003, "again one id"), (None, "no id")], "doc_id long, text string")
    return some.unionByName(odd)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-30, min(30, x))))


def hashed(hashing, word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hashing.words(data, np.array([0]), np.array([len(data)]))[0])


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_toxicity(docs, labels):
    model = toxicity_pu.train(docs, labels)
    weights = dict(zip(model.words.tolist(), model.weights.tolist()))
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    got = sorted(((r.doc_id, r.score, r.predicted) for r in toxicity_pu.classify(docs, labels).collect()), key=str)
    want = []
    for d, t in texts:
        words = {hashed(toxicity_pu._WORD, w) % (1 << toxicity_pu.BITS) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))}
        want.append((d, sigmoid(model.bias + sum(weights.get(w, 0.0) for w in words))))
    by = lambda rows: sorted((str(r[0]), round(r[1], 9)) for r in rows)
    assert by(got) == by(want) and all(p == (s >= 0.5) for _, s, p in got)


def plain_features(text):
    """text_stats.FEATURES of one text, by strings."""
    data = text.encode()
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    size, some = max(len(data), 1), max(len(words), 1)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = len(lines) - len(set(lines))
    upper, digit, symbols = set(range(65, 91)), set(range(48, 58)), set(b"#*$%&|<>")
    punct = set(b"!\"#$%&'()*+,-./") | set(b":;<=>?@") | set(b"[\\]^_`") | set(b"{|}~")
    share = lambda chosen: sum(b in chosen for b in data) / size
    of = lambda test: sum(map(test, words)) / some
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    again = {i for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for i in range(k, k + 5)}
    return [
        math.log1p(len(words)), sum(map(len, words)) / some, of(lambda w: len(w) > 12), of(lambda w: len(w) <= 3), share(symbols), share(upper), of(lambda w: len(w) > 1 and w[0] in upper and w[1] in upper), share(digit), share(punct),
        share(b"!"), share(b"|"), sum(b >= 0xC0 for b in data) / size, sum(b in b".!?" for b in data) / some, data.count(b"\n") / some, dup / max(len(lines), 1), len(again) / some,
        len(set(words)) / some, len(words) / max(len(lines), 1), of(lambda w: w[0] in symbols or w[-1] in symbols), of(lambda w: w[0] in upper),
    ]


def test_quality_gam(docs, labels):
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    names = text_stats.FEATURES
    rows = {(r.doc_id, tuple(np.float32(x) for x in r.features)) for r in quality_gam.feature_rows(docs).collect()}
    plain = {(d, tuple(np.float32(x) for x in plain_features(t))) for d, t in texts}
    near = lambda a, b: sorted(map(str, {d for d, _ in a})) == sorted(map(str, {d for d, _ in b}))
    assert near(rows, plain) and len(names) == len(plain_features("x"))
    for (d, got), (e, want) in zip(sorted(rows, key=str), sorted(plain, key=str)):
        assert d == e and np.allclose(got, want, rtol=1e-5, atol=1e-6), [(n, a, b) for n, a, b in zip(names, got, want) if abs(a - b) > 1e-5]
    # scores: a sum of table entries found by counting the edges that a feature reaches
    known = quality_gam.sampled(quality_gam.feature_rows(docs), quality_gam.first_by_hash(quality_gam.known_labels(labels, "quality", 4, 2), quality_gam.MAX_ROWS), "features").select("features", "y").toArrow()
    model = quality_gam.fit(quality_gam._matrix(known.column("features")), np.asarray(known.column("y"), np.float64))
    bin_of = lambda edges, x: sum(e <= x for e in edges)
    want = []
    for d, x in rows:
        total = model.intercept + sum(float(t[bin_of(e, v)]) for e, t, v in zip(model.edges, model.tables, x))
        total += sum(float(t[bin_of(model.pair_edges[i], x[i]), bin_of(model.pair_edges[j], x[j])]) for (i, j), t in zip(model.pairs, model.pair_tables))
        want.append((str(d), round(sigmoid(total), 6)))
    got = {(str(r.doc_id), round(r.score, 6)) for r in quality_gam.classify(docs, labels).collect()}
    assert got == set(want) and len(model.pairs) == quality_gam.PAIRS


def test_quality_rules(docs, labels):
    model = quality_rules.train(docs, labels)
    buckets = (1 << quality_rules.BITS) // quality_rules._FAMILIES
    step, top = int(quality_rules._STEP), (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ x >> 27) * 0x94D049BB133111EB & top
        return x ^ x >> 31

    def score(text):
        words = [hashed(quality_rules._WORD, w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        pairs = [int(quality_rules._PAIR.slices(np.array(words[k : k + 2], np.uint64), np.array([0]), np.array([2]))[0]) for k in range(len(words) - 1)]
        points = [int.from_bytes(c.encode(), "little") for c in text]
        grams = []
        for size in (3, 5):
            found = []
            for k in range(len(points) - size + 1):
                key = 0
                for p in points[k : k + size]:
                    key = (key * step + p) & top
                found.append(mixed(key))
            grams.append(found)
        total = model.bias
        for family, keys in enumerate((words, pairs, *grams)):
            total += sum(float(model.weights[k % buckets + family * buckets]) for k in keys) / max(1, len(keys))
        return sigmoid(model.slope * total + model.shift), words

    texts = [(r.doc_id, r.text or "") for r in docs.where("length(text) < 3000 or text is null").collect()]
    got = sorted(((str(r.doc_id), round(r.probability, 6), r.base_failed, r.kept) for r in quality_rules.judge(docs.where("length(text) < 3000 or text is null"), model).collect()))
    want = []
    for d, t in texts:
        p, words = score(t)
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        again = {i for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for i in range(k, k + 5)}
        failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
        want.append((str(d), round(p, 6), failed, not failed and p >= quality_rules.THRESHOLD))
    assert got == sorted(want) and len({x[3] for x in want}) == 2


def test_licences_of_empty_repeated_and_long(spark):
    """No rows, a row repeated, and a text of 300,000 words with a notice at its end."""
    schema = "doc_id long, text string, n_words long, labels string"
    assert license_templates.scan(spark.createDataFrame([], schema)).collect() == []
    notice = "under the mit license"
    long = "word " * 300_000 + notice + " apache license version 2"
    rows = [(1, notice), (1, notice), (2, long), (3, (notice + "\n") * 2000)]
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_templates.scan(spark.createDataFrame([(*r, 5, "x") for r in rows], schema)).collect())
    assert got == [(1, 4, 1, 0, 0, "mit"), (1, 4, 1, 0, 0, "mit"), (2, 300_008, 2, 300_000, 300_004, "apache-2,mit"), (3, 8000, 2000, 0, 7996, "mit")]
