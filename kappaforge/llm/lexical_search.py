"""Ranked lexical search over K2-treaps.

The grid has a row for each asked term and a column for each document; a cell
holds the term's impact on the document's score. A K2-treap keeps it as a
quadtree without empty cells, in which every cell knows the largest impact below
it. An item's terms are rows: for a range of documents each row's path leads to
one cell, and the sum of their maxima bounds the score of every document of the
range. Ranges are opened best first, all of an item's rows together, until no
bound reaches the lowest score kept. Equal bounds are opened too, so ties are
exact.

1. Documents are read once for how often each asked term occurs (postings).
2. Counts of documents by term and of all terms are summed; rows stand in the
   order of these counts, so that cells hold terms of like weight.
3. Every task makes treaps of up to ``POSTINGS`` postings and searches them for
   all items; the lowest score kept so far carries over to the next treap. Only
   the best of each task are shuffled.

Asked terms are broadcast, ``MAX_TERMS`` at most (more only if one item alone
has more); items beyond that are asked in further passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaforge.llm.store import written
from kappaforge.llm.words import ALNUM_LOWER, LOWER, Hash, blocks, padded, same_bytes, spans

TOP = 50
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: distinct terms asked in one pass, and postings of one treap
MAX_TERMS, POSTINGS = 1_000_000, 1 << 20
#: ranges opened at once, and numbers of waiting ranges beyond which the deepest come first
OPENED, WAITING = 128, 1 << 22
_BITS_BELOW = np.array([[bin(m & ((1 << b) - 1)).count("1") for b in range(4)] for m in range(16)], np.int64)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers at even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


class Treap:
    """A quadtree over (row, column) with the largest impact of every cell; cells without any are not stored."""

    def __init__(self, row: np.ndarray, col: np.ndarray, impact: np.ndarray):
        self.height = max(1, int(max(row.max(initial=0), col.max(initial=0))).bit_length())
        key = _spread(row) << np.uint64(1) | _spread(col)
        order = np.argsort(key)
        key, most = key[order], impact[order]
        levels = [(most, np.zeros(len(key), np.int64), np.zeros(len(key), np.uint8))]
        for _ in range(self.height):
            first = np.flatnonzero(np.append(True, key[1:] >> np.uint64(2) != key[:-1] >> np.uint64(2))[: len(key)])
            mask = np.bitwise_or.reduceat((1 << (key & np.uint64(3)).astype(np.uint8)).astype(np.uint8), first) if len(first) else np.zeros(0, np.uint8)
            most = np.maximum.reduceat(most, first) if len(first) else most
            key = key[first] >> np.uint64(2)
            levels.append((most, first, mask))
        levels.reverse()  # the root is cell 0
        begin = np.cumsum([len(x[0]) for x in levels])
        self.most = np.concatenate([x[0] for x in levels])
        self.child = np.concatenate([x[1] + b for x, b in zip(levels, begin)])
        self.mask = np.concatenate([x[2] for x in levels])

    def search(self, rows: np.ndarray, keep: int, least: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of the ``keep`` best columns over ``rows`` with a score of ``least`` or more; ties by ``order`` of columns."""
        got_col, got = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.most) or not len(rows):
            return got_col, got
        at_once = max(1, min(OPENED, WAITING // len(rows)))
        cells, bound = np.zeros((1, len(rows)), np.int64), np.full(1, len(rows) * int(self.most[0]))
        col, level = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(bound):
            rank = bound if cells.size <= WAITING else level
            best = np.argpartition(rank, len(rank) - at_once)[-at_once:] if len(rank) > at_once else np.arange(len(rank))
            rest = np.ones(len(rank), bool)
            rest[best] = False
            x, deep = cells[best], level[best]
            half = (rows >> (self.height - 1 - deep)[:, None]) & 1
            mask = np.where(x >= 0, self.mask[x], 0)
            opened = []
            for right in (0, 1):
                quarter = 2 * half + right
                there = (mask >> quarter) & 1 == 1
                below = np.where(there, self.child[x] + _BITS_BELOW[mask, quarter], -1)
                total = np.where(there, self.most[below], 0).sum(1)
                go = (total >= least) & (total > 0)
                opened.append((below[go], total[go], 2 * col[best][go] + right, deep[go] + 1))
            below, total, at, deep = (np.concatenate([a, b]) for a, b in zip(*opened))
            done = deep == self.height
            if done.any():
                got_col, got = np.append(got_col, at[done]), np.append(got, total[done])
                first = np.lexsort((order[got_col], -got))[:keep]
                got_col, got = got_col[first], got[first]
                if len(got) == keep:
                    least = max(least, int(got[-1]))
            stay = rest & (bound >= least)
            new = ~done & (total >= least)
            cells, bound = np.concatenate([cells[stay], below[new]]), np.append(bound[stay], total[new])
            col, level = np.append(col[stay], at[new]), np.append(level[stay], deep[new])
        return got_col, got


@dataclass
class Dictionary:
    """The asked terms: a number for each, found by hash and told by its bytes."""

    terms: list[bytes]

    def __post_init__(self) -> None:
        self.room = padded(b"".join(self.terms))
        self.size = np.fromiter(map(len, self.terms), np.int64, len(self.terms))
        self.start = np.cumsum(self.size) - self.size
        for seed in count(121):  # the first seed that tells all terms apart
            self.hashing = Hash(seed)
            keys = self.hashing.words(self.room[:-8], self.start, self.start + self.size)
            self.order = np.argsort(keys)
            self.keys = keys[self.order]
            if (self.keys[1:] != self.keys[:-1]).all():
                break

    def numbers(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of every word, -1 for one that is not asked."""
        if not self.terms:
            return np.full(len(starts), -1)
        keys, room, sizes = self.hashing.words(buf, starts, ends), padded(buf), ends - starts
        found = self.order[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)]
        found[self.size[found] != sizes] = -1
        may = np.flatnonzero(found >= 0)
        found[may[~same_bytes(self.room, self.start[found[may]], room, starts[may], sizes[may])]] = -1
        return found


def terms_of(text: Column) -> Column:
    """The distinct terms of a text; null has none."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit(TERM), F.lit(0)), F.array().cast("array<string>")))


def postings(docs: DataFrame, asked: Broadcast) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: the numbers of asked terms it has, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in blocks(batch, "_text"):
                low = LOWER[buf]
                starts, ends, first = spans(low, offsets, ALNUM_LOWER)
                n = np.diff(first)
                term = asked.value.numbers(low, starts, ends)
                of = np.repeat(np.arange(len(n)), n)[term >= 0]
                both, tf = np.unique(of << 32 | term[term >= 0], return_counts=True)
                begin = np.searchsorted(both >> 32, np.arange(len(n) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(begin), pa.array(x.astype(np.int32))) for x in (both & 0xFFFFFFFF, tf)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    part = docs.select("doc_id", F.col("text").alias("_text"))
    schema = T.StructType([part.schema["doc_id"], *T.StructType.fromDDL("n long, terms array<int>, tfs array<int>").fields])
    return part.mapInArrow(run, schema)


def _documents_by_term(found: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each asked term occurs; tasks send one row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    got = found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(n_terms, np.int64)
    df[np.asarray(got.column("term"), np.int64)] = np.asarray(got.column("df"), np.int64)
    return df


def _best(found: DataFrame, by: list[str], keep: int) -> DataFrame:
    window = W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= keep)


def _pass(docs: DataFrame, items: DataFrame, keep: int, size: int) -> DataFrame:
    """(item_id, doc_id, score) of the best of every task for ``items`` (item_id, terms)."""
    spark = docs.sparkSession
    got = items.orderBy("item_id").toArrow()
    ids = pa.array(got.column("item_id").to_pylist(), got.schema.field("item_id").type)
    words = [[t.encode() for t in x] for x in got.column("terms").to_pylist()]
    terms = sorted({t for x in words for t in x})
    found = written(postings(docs, spark.sparkContext.broadcast(Dictionary(terms))), "postings")
    n_docs, length = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _documents_by_term(found, len(terms))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    row = np.empty(len(terms), np.int64)
    row[np.argsort(df, kind="stable")] = np.arange(len(terms))
    number = {t: k for k, t in enumerate(terms)}
    asked = spark.sparkContext.broadcast((row, weight, [np.sort(row[[number[t] for t in x]]) if x else np.zeros(0, np.int64) for x in words]))
    kind = found.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, weight, items = asked.value
        kept = np.zeros((len(items), keep), np.int64)  # the best scores so far, ascending
        for part in _gathered(batches, size):
            n = np.asarray(part.column("n"))
            part = part.take(pa.array(np.argsort(n, kind="stable")))  # documents of like length stand together
            n = np.asarray(part.column("n"))
            terms, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            doc = np.repeat(np.arange(len(n)), np.diff(part.column("terms").offsets.to_numpy()))
            m = 50 + 50 * n * n_docs // length
            impact = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
            own = part.column("doc_id")
            order = np.empty(len(n), np.int64)
            order[pc.sort_indices(own, null_placement="at_start").to_numpy()] = np.arange(len(n))
            treap = Treap(row[terms], doc, impact)
            of, cols, scores = [], [], []
            for k, rows in enumerate(items):
                col, score = treap.search(rows, keep, max(1, int(kept[k, 0])), order)
                if len(col):
                    kept[k] = np.sort(np.append(kept[k], score))[-keep:]
                    of.append(np.full(len(col), k))
                    cols.append(col)
                    scores.append(score)
            if of:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(of))), own.take(pa.array(np.concatenate(cols))), pa.array(np.concatenate(scores))], names=["item_id", "doc_id", "score"])

    return found.mapInArrow(run, T.StructType([items.schema["item_id"], kind, T.StructField("score", T.LongType())]))


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of up to about ``size`` postings; one document has one batch whatever its size."""
    rows, total = [], 0
    for batch in batches:
        while batch.num_rows:
            ends = batch.column("terms").offsets.to_numpy()[1:] - batch.column("terms").offsets[0].as_py()
            k = min(batch.num_rows, max(int(np.searchsorted(ends, size - total, "right")), 0 if rows else 1))
            if k:
                rows.append(batch.slice(0, k))
                total += int(ends[k - 1])
                batch = batch.slice(k)
            if batch.num_rows:
                yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
                rows, total = [], 0
    if rows:
        yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]


def search(docs: DataFrame, items: DataFrame, keep: int = TOP, max_terms: int = MAX_TERMS, size: int = POSTINGS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``keep`` best documents of every item.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not
    read. Null texts have no terms; an item without terms finds nothing; rows of
    one item_id are one item with the terms of all of them; rows of one doc_id are
    documents each; rows without a doc_id come first among equal scores. Empty
    tables give an empty result.
    """
    asked = items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    asked = written(asked, "items")
    passes = max(1, -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // max_terms))
    found = None
    for k in range(passes):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        # what tasks found is some rows an item and task: the best of parts of them first
        part = _best(_pass(docs, own, keep, size).withColumn("part", F.spark_partition_id() % 64), ["item_id", "part"], keep)
        found = part if found is None else found.unionByName(part)
    return _best(found.drop("rank", "part"), ["item_id"], keep).select("item_id", F.col("rank").cast("int"), "doc_id", "score")
