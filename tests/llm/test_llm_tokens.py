"""Encoding and counting against the public libraries."""

import hashlib
import struct

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import regex
import tiktoken

from kappaforge.llm import byte_bpe, pieces, token_counts
from kappaforge.llm.registry import tokenizer_path
from kappaforge.llm.words import blocks, raw

TEXTS = [
    "", None, "'s", "don't 'tis we'll I've x'rex ''s 's's 'T", "  a  b\n\n c \n", "  x  y", "\x1c a\x1d", "日本語 test １２３ ½ 😀😀 é", "a", "  ", " \t x", "x'", "'", "'l", "x\n 'll", "　　漢", "\x85 a\x85 b",
    "a <|endoftext|> b", "w" * 300, " " * 700 + "x", "é" * 900, "The quick brown fox. " * 400, "thndor erst inghe " * 900, "abc" * 4000,
]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids int")


def test_split_follows_the_pattern():
    some = [t or "" for t in TEXTS]
    buf, offsets = raw(pa.array(some, pa.large_string()))
    starts = pieces.split(buf, offsets)
    want, at = [], 0
    for t in some:
        for m in regex.findall(P.PATTERN, t):
            want.append(at)
            at += len(m.encode())
    assert starts.tolist() == want


def test_encode_and_decode(spark):
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.codec(path).ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.digest(docs(spark), path).collect()}
    lists = byte_bpe.encode(docs(spark), path)
    ids = {r.doc_id: r.ids for r in lists.collect()}
    back = {r.doc_id: r.text for r in byte_bpe.decode(lists, path).collect()}
    for k, t in enumerate(TEXTS):
        want = library.encode_ordinary(t or "")
        assert ids[k] == want and got[k].n_tokens == len(want) and back[k] == (t or "")
        assert got[k].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.digest(docs(spark, []), path).count() == 0


def test_heaps_agree_and_small_tables_suffice(monkeypatch):
    c = byte_bpe.codec(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    some = [b"thndorerst", b"x" * 5, bytes(range(33, 97)), bytes(range(160, 250)), b"inghe", "漢字漢字".encode()]
    buf = np.frombuffer(b"".join(some), np.uint8)
    ends = np.cumsum([len(s) for s in some])
    ids, n = c.merge_all(buf, ends - [len(s) for s in some], ends)
    assert ids.tolist() == [i for s in some for i in c.merge(s)] and n.tolist() == [len(c.merge(s)) for s in some]
    monkeypatch.setattr(byte_bpe, "ARENA", 4)
    c._forget()
    text = np.frombuffer(b"qzxv erqq thndor erst qqq", np.uint8)
    one, _ = c.encode(text, np.array([0, len(text)]))
    assert c.decode(one) == text.tobytes()
    monkeypatch.undo()
    c._forget()


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 3000).astype(np.uint64))
    h = byte_bpe.PerfectHash(keys)
    assert sorted(h.find(keys).tolist()) == list(range(len(keys))) and h.n == len(keys)
    assert (h.find(keys + np.uint64(1)) < 0).all()


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 256), (1000, 16), (64, 4)])
def test_counts(spark, chunk, overlap):
    path = tokenizer_path("byte_bpe_50k.json")
    library = token_counts.counter(path).library
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark), path, chunk=chunk, overlap=overlap).collect()}
    for k, t in enumerate(TEXTS):
        want = len(library.encode(t or "", add_special_tokens=False))
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (want, len((t or "").encode()), want > 512), (k, t)
    assert token_counts.count_tokens(docs(spark, []), path).count() == 0


def test_blocks_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * k for k in (0, 5, 900, 0, 3)])], names=["text"])
    parts = [(rows.num_rows, bytes(buf)) for rows, buf, _ in blocks(batch, "text", 10)]
    assert sum(n for n, _ in parts) == 5 and b"".join(b for _, b in parts) == b"a" * 908


def morse(letters, n):
    """The Thue-Morse string of two letters, and its complement: a polynomial modulo 2**64 gives both one hash from some length on."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


@pytest.mark.parametrize("n", [8, 64, 512, 1024, 4096])
def test_texts_like_each_other_do_not_take_each_others_ids(spark, n):
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.codec(path).ranks, special_tokens={})
    pair = morse("ab", n)
    got = byte_bpe.encode(docs(spark, pair).coalesce(1), path).orderBy("doc_id").collect()
    assert [r.ids for r in got] == [library.encode_ordinary(t) for t in pair]
    path = tokenizer_path("byte_bpe_50k.json")
    library, pair = token_counts.counter(path).library, morse("et", n)
    got = token_counts.count_tokens(docs(spark, pair).coalesce(1), path).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(library.encode(t, add_special_tokens=False)) for t in pair]


def test_equal_hashes_are_no_equal_pieces(monkeypatch):
    """Every piece of a length has one hash: the bytes alone tell them apart."""
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    c, k = byte_bpe.codec(path), token_counts.counter(tokenizer_path("byte_bpe_50k.json"))
    texts = ["qzxv jjkq wwyz qzxv zzzz", "vvqz qzxv kqjj"]
    buf, offsets = raw(pa.array(texts, pa.large_string()))
    want = [x.tolist() for x in c.encode(buf, offsets)], k.totals(buf, offsets).tolist()
    flat = lambda self, buf, starts, ends: (ends - starts).astype(np.uint64)
    monkeypatch.setattr(byte_bpe.Hash, "words", flat)
    monkeypatch.setattr(c, "hash", byte_bpe.PerfectHash(np.unique(np.arange(1, 4).astype(np.uint64))))
    for memo in (c.memo, k.memo):
        memo.forget()
    tokens = {t: i for i, t in enumerate(c.ranks)}
    monkeypatch.setattr(c, "tokens", lambda keys, room, starts, sizes: np.array([tokens.get(room[a : a + n].tobytes(), -1) for a, n in zip(starts, sizes)]))
    for _ in range(2):  # the second time the tables know some of them
        assert ([x.tolist() for x in c.encode(buf, offsets)], k.totals(buf, offsets).tolist()) == want
    monkeypatch.undo()
    for memo in (c.memo, k.memo):
        memo.forget()


def test_long_texts_are_spliced_at_the_real_size(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    library = token_counts.counter(path).library
    long = "".join(f"word{k % 977} and {'x' * (k % 40)} thndor, " for k in range(12_000))
    texts = [long, "é" * 100_000, "a" * 150_000, long[:70_000] + "<|endoftext|>" + long[:90_000] + "<|endoftext|>", " " * 140_000 + "b"]
    assert min(len(t.encode()) for t in texts) > 2 * token_counts.CHUNK
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(spark, texts), path).collect()}
    assert got == {k: len(library.encode(t, add_special_tokens=False)) for k, t in enumerate(texts)}
