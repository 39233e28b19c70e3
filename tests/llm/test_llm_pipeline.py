"""The pipeline's stages, each on its predecessor's rows."""

import hashlib
import random
import re
import struct

import public_tokenizers
import tiktoken

import corpus_pipeline
from kappaforge.llm import byte_bpe, decontamination, near_dedup, pii_surrogates, quality_rules
from kappaforge.llm.registry import surrogate_key, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF)
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    raw, good, near, clean, private, ids = seen
    assert all(set(x.columns) == set(docs.columns) for x in seen[:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = {r.doc_id: r for r in quality_rules.judge(raw, quality_rules.train(raw, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert {r.doc_id for r in good.collect()} == {k for k, r in judged.items() if r.kept}
    assert all(labels.get(k, 1) == 1 or not r.kept for k, r in judged.items()) or sum(labels.get(k, 1) == 0 and r.kept for k, r in judged.items()) < 3
    classes = near_dedup.near_duplicates(good).collect()
    assert {r.doc_id for r in near.collect()} == {r.class_id for r in classes}
    leaking = {r.doc_id for r in decontamination.leaks(near, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} - leaking
    texts = {r.doc_id: r.text for r in private.collect()}
    before = {r.doc_id: r.text for r in clean.collect()}
    assert texts.keys() == before.keys() and all((texts[k] == t) == (not pii_surrogates.entities(t)) for k, t in before.items())
    assert {r.doc_id: r.decoded_sha256 for r in ids.collect()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in texts.items()}


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def shingled(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def plain_run(spark):
    """run() by loops over lists: the verdicts and names come from the operators, all else is done plainly."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_rules.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality_rules.judge(docs, model).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    sets = {k: shingled(t) for k, t in texts.items()}
    up = {k: k for k in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    texts = {k: texts[k] for k in ids if find(k) == k}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    number = {}
    code = lambda w: [number.setdefault(x, len(number)) for x in w]
    items = [code(w) for w in items if len(w) >= 5]
    for k, t in list(texts.items()):
        own = code(words(t))
        fives = {tuple(own[j : j + 5]) for j in range(len(own) - 4)}
        for item in items:
            if any(tuple(item[j : j + 5]) in fives for j in range(len(item) - 4)) and sum(n for _, _, n in decontamination.tiles(item, own)) >= 0.5 * len(item):
                texts.pop(k, None)
    ranks = byte_bpe.codec(tokenizer_path("byte_bpe_multi_50k.tiktoken")).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return texts, library


def test_run(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    texts, library = plain_run(spark)
    assert got.keys() == texts.keys()
    key = surrogate_key(spark)
    for k, t in texts.items():
        new = pii_surrogates._rewrite(t, {}, key)[0]  # no value of this small table collides
        ids = library.encode(new, disallowed_special=())
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and got[k].decoded_sha256 == hashlib.sha256(new.encode()).hexdigest()


def test_stages_of_odd_rows(spark):
    """Null, empty and very long texts, repeated rows, null ids and further columns with the names of inner ones; and an empty table."""
    rng = random.Random(2)
    prose = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 300").orderBy("doc_id").limit(12).collect()]
    texts = [None, "", " \n ", *prose, prose[0], " ".join(rng.choice(prose) for _ in range(60)), prose[3] + " mail ab@cd.org"]
    rows = [(k if k % 5 else None, t, "en", "s", len(t or ""), "node", 1, None) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, *rows[:6]], "doc_id long, text string, lang string, source string, n_chars long, node string, _text int, entities string")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            some = stage(spark, some, SF)
            assert some.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, some, SF)
        found = last.collect()
    assert found == []
    kept = near_dedup.first_of_each(docs).collect()
    assert sum(not (r.text or "").strip() for r in kept) == 6 and len(kept) < docs.count() - 4
