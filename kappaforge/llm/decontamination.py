"""Benchmark decontamination by greedy string tiling.

Seeds are the hashes of ``min_tile`` consecutive words of benchmark items; they
are joined with the documents' running hashes. An item is looked for by its
telling seeds only: the most common ones are left out as long as they cover less
than the threshold alone, so that a leak has a telling seed in any case, and a
line that many items share does not lead to all of them. For every pair whose
seeds cover enough, greedy string tiling over Karp-Rabin matches marks the longest common
runs of unmarked words first, down to ``min_tile`` words, so passages in another
order count as well. A document leaks an item if its tiles cover at least
``threshold`` of the item's words.

A benchmark of up to ``max_broadcast`` words, counted first, is broadcast and
the documents are read once. A larger one stays a table: documents pass a bit
filter of fixed size that Spark builds of its seeds, and what passes is joined
with them, so the number of scans does not grow with the benchmark.

Words are digits, letters a-z after lower-casing, and non-ASCII characters.
Items of fewer than ``min_tile`` words match nothing; equal items count once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kappaforge.llm.store import unused, written
from kappaforge.llm.words import ALNUM_LOWER, LOWER, Hash, U, blocks, spans, window_starts

MIN_TILE, THRESHOLD = 5, 0.5
#: words of a benchmark that is broadcast, and bits of the filter of a larger one
MAX_BROADCAST, FILTER_BITS = 1_000_000, 24
_WORD, _SEED = Hash(51), Hash(52)
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of the first word of each text)."""
    low = LOWER[buf]
    starts, ends, first = spans(low, offsets, ALNUM_LOWER)
    return _WORD.words(low, starts, ends), first


def _running(words: list[int], size: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of every window of ``size`` words."""
    top, value = pow(_BASE, size - 1, _PRIME), 0
    for i, w in enumerate(words):
        if i >= size:
            value = (value - words[i - size] * top) % _PRIME
        value = (value * _BASE + w) % _PRIME
        if i + 1 >= size:
            yield i - size + 1, value


def tiles(item: list[int], text: list[int], min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (item start, text start, length), no word in two tiles.

    The longest match of unmarked words is marked, of equal ones the leftmost, until
    none of ``min_tile`` words is left. Matches are those that go on at neither end;
    one that a tile cuts comes back as the pieces that are left of it, so no search
    is repeated.
    """
    at = defaultdict(list)
    for i, h in _running(item, min_tile):
        at[h].append(i)
    heap = []
    for t, h in _running(text, min_tile) if at else ():
        for i in at.get(h, ()):
            if i and t and item[i - 1] == text[t - 1]:
                continue  # within the match that begins a word earlier
            k = 0
            while i + k < len(item) and t + k < len(text) and item[i + k] == text[t + k]:
                k += 1
            if k >= min_tile:
                heap.append((-k, i, t))
    heapify(heap)
    mark_i, mark_t = bytearray(len(item)), bytearray(len(text))
    out: list[tuple[int, int, int]] = []
    while heap:
        k, i, t = heappop(heap)
        k = -k
        if not any(mark_i[i : i + k]) and not any(mark_t[t : t + k]):
            mark_i[i : i + k] = mark_t[t : t + k] = b"\1" * k
            out.append((i, t, k))
            continue
        run = 0
        for j in range(k + 1):
            if j < k and not mark_i[i + j] and not mark_t[t + j]:
                run += 1
                continue
            if run >= min_tile:
                heappush(heap, (-run, i + j - run, t + j - run))
            run = 0
    return out


def telling(common: np.ndarray, n: int, min_tile: int, threshold: float) -> np.ndarray:
    """Flags of an item's seeds, of which ``common`` says in how many items each occurs: a leak has one of them.

    The others, the most common, cover less than ``threshold`` of the item's ``n`` words.
    """
    flags = np.ones(len(common), bool)
    covered, total = bytearray(n), 0
    for k in np.argsort(-common, kind="stable").tolist():
        total += covered.count(0, k, k + min_tile)
        covered[k : k + min_tile] = b"\1" * min_tile
        if total >= threshold * n:
            break
        flags[k] = False
    return flags


@dataclass
class Items:
    """A block of benchmark items in memory of the tasks."""

    ids: list
    words: list[np.ndarray]
    min_tile: int
    threshold: float

    def __post_init__(self) -> None:
        self.first = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        flat = np.concatenate([*self.words, np.zeros(0, np.uint64)])
        at, item = window_starts(self.first, self.min_tile)
        seeds = _SEED.slices(flat, at, at + self.min_tile)
        self.begin = np.searchsorted(item, np.arange(len(self.words) + 1))
        self.own = [seeds[a:b] for a, b in zip(self.begin, self.begin[1:])]  # by place in the item
        both = np.unique(np.stack([seeds, item.astype(np.uint64)]), axis=1)[0] if len(seeds) else seeds
        every, common = np.unique(both, return_counts=True)
        common = common[np.searchsorted(every, seeds)]
        use = np.concatenate([telling(common[a:b], len(w), self.min_tile, self.threshold) for a, b, w in zip(self.begin, self.begin[1:], self.words)] or [np.zeros(0, bool)])
        order = np.argsort(seeds[use], kind="stable")
        self.seeds, self.item = seeds[use][order], item[use][order]
        self.mask = U((1 << min(22, max(8, 4 + len(seeds).bit_length()))) - 1)
        self.filter = np.zeros(int(self.mask) + 1, bool)
        self.filter[(self.seeds & self.mask).astype(np.int64)] = True

    def leaks(self, buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(text, item, coverage, words covered, tiles, longest tile) of every leaking pair."""
        words, first = word_hashes(buf, offsets)
        at, doc = window_starts(first, self.min_tile)
        if not len(at) or not len(self.seeds):
            return
        keys = _SEED.slices(words, at, at + self.min_tile)
        may = np.flatnonzero(self.filter[(keys & self.mask).astype(np.int64)])
        for d in np.unique(doc[may]).tolist():
            a, b = np.searchsorted(doc[may], (d, d + 1))
            asked = np.unique(keys[may[a:b]])  # a seed counts once, however often the text has it
            low, high = (np.searchsorted(self.seeds, asked, side) for side in ("left", "right"))
            n = high - low
            items = np.unique(self.item[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]).tolist()
            if items:
                a, b = np.searchsorted(doc, (d, d + 1))
                order = np.argsort(keys[a:b], kind="stable")
                yield from ((d, i, *found) for i in items if (found := self._leak(i, words, at[a:b], keys[a:b][order], order)))

    def _leak(self, i: int, words: np.ndarray, at: np.ndarray, keys: np.ndarray, order: np.ndarray) -> tuple[float, int, int, int] | None:
        """(coverage, words covered, tiles, longest tile) if a text, of sorted window ``keys`` that begin at ``at[order]``, leaks item ``i``."""
        item, own = self.words[i], self.own[i]
        low, high = (np.searchsorted(keys, own, side) for side in ("left", "right"))
        if len(self._around(np.flatnonzero(high > low))) < self.threshold * len(item):
            return None  # the seeds found cannot cover enough
        _, one = np.unique(own, return_index=True)
        low, n = low[one], (high - low)[one]
        places = self._around(np.sort(at[order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]]))
        text: list[int] = []
        for k, p in enumerate(places.tolist()):
            if k and p != places[k - 1] + 1:
                text.append(-1 - k)  # a word like no other
            text.append(int(words[p]))
        found = tiles(item.tolist(), text, self.min_tile)
        covered = sum(x[2] for x in found)
        return (covered / len(item), covered, len(found), max(x[2] for x in found)) if covered >= self.threshold * len(item) else None

    def _around(self, starts: np.ndarray) -> np.ndarray:
        """The words of windows that begin at the sorted ``starts``."""
        return np.unique((starts[:, None] + np.arange(self.min_tile)).ravel())


def benchmark_items(benchmark: DataFrame, min_tile: int = MIN_TILE) -> DataFrame:
    """(item_id, n, words): the word hashes of every item of ``min_tile`` words or more. Null texts have no words."""
    part = benchmark.select("item_id", F.col("text").alias("_text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in blocks(batch, "_text"):
                words, first = word_hashes(buf, offsets)
                yield pa.RecordBatch.from_arrays([rows.column("item_id"), pa.array(np.diff(first), pa.int64()), pa.array([words[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], names=["item_id", "n", "words"])

    rows = part.mapInArrow(hashed, part.drop("_text").schema.add("n", "long").add("words", "binary"))
    return rows.where(F.col("n") >= min_tile).dropDuplicates(["item_id", "words"])


def _small(items: DataFrame, min_tile: int, threshold: float, max_broadcast: int) -> Broadcast | None:
    """The items in memory, if they have at most ``max_broadcast`` words together."""
    if (items.agg(F.sum("n")).first()[0] or 0) > max_broadcast:
        return None
    got = items.orderBy("item_id", "words").toArrow()
    found = Items(got.column("item_id").to_pylist(), [np.frombuffer(x.as_py(), np.uint64) for x in got.column("words")], min_tile, threshold)
    return items.sparkSession.sparkContext.broadcast(found)


def _digest(text: str) -> Column:
    """Sixteen bytes that tell a text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))


def _seed_filter(seeds: DataFrame) -> np.ndarray:
    """A flag for each remainder of a seed modulo 2 ** FILTER_BITS: a megabyte or two at any size."""
    at = F.col("seed").bitwiseAND((1 << FILTER_BITS) - 1)
    got = seeds.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    flags = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    flags[np.asarray(got.column("at"), np.int64)] = np.asarray(got.column("bits"), np.int64)
    return flags.view(np.uint64)


def _candidates(part: DataFrame, items: DataFrame, min_tile: int, threshold: float) -> DataFrame:
    """(digest, item_id, words) of the texts and items that share a telling seed, by joins."""
    items = written(items.withColumn("item", F.md5(F.concat(F.coalesce(F.col("item_id").cast("string"), F.lit("")).cast("binary"), F.col("words")))), "items")

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column("item"), batch.column("words")):
                words = np.frombuffer(data.as_py(), np.uint64)
                at, _ = window_starts(np.array([0, len(words)]), min_tile)
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(at)), pa.array([len(words)] * len(at)), pa.array(at), pa.array(_SEED.slices(words, at, at + min_tile).view(np.int64))], names=["item", "n", "at", "seed"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, n, seeds in zip(batch.column("item"), batch.column("n").to_pylist(), batch.column("seeds").to_pylist()):
                seed, common = (np.array([x[c] for x in seeds], np.int64) for c in ("seed", "items"))
                use = np.unique(seed[telling(common, n, min_tile, threshold)])
                yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(use)), pa.array(use)], names=["item", "seed"])

    placed = written(items.select("item", "words").mapInArrow(of_items, "item string, n long, at long, seed long"), "placed")
    common = written(placed.groupBy("seed").agg(F.count_distinct("item").alias("items")), "common")
    lists = placed.join(common, "seed").groupBy("item", "n").agg(F.array_sort(F.collect_list(F.struct("at", "seed", "items"))).alias("seeds"))
    seeds = written(lists.mapInArrow(chosen, "item string, seed long"), "seeds")
    shared = part.sparkSession.sparkContext.broadcast(_seed_filter(seeds))

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in blocks(batch, "_text"):
                words, first = word_hashes(buf, offsets)
                at, doc = window_starts(first, min_tile)
                keys = _SEED.slices(words, at, at + min_tile)
                low = keys & U((1 << FILTER_BITS) - 1)
                may = np.flatnonzero(shared.value[(low >> U(6)).astype(np.int64)] >> (low & U(63)) & U(1))
                doc, keys = doc[may], keys[may]
                order = np.lexsort((keys, doc))
                doc, keys = doc[order], keys[order]
                once = np.append(True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))[: len(keys)]
                yield pa.RecordBatch.from_arrays([rows.column("digest").take(pa.array(doc[once])), pa.array(keys[once].view(np.int64))], names=["digest", "seed"])

    texts = part.select("_text", _digest("_text").alias("digest")).mapInArrow(of_texts, "digest binary, seed long")
    return texts.join(seeds, "seed").select("digest", "item").distinct().join(items, "item").select("digest", "item_id", "words")


_FOUND = ("coverage double", "n_covered long", "n_tiles long", "longest_tile long")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_tile: int = MIN_TILE, threshold: float = THRESHOLD, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, item_id, coverage, n_covered, n_tiles and longest_tile of every leaking pair.

    Null and empty texts leak nothing; repeated rows give repeated pairs; empty
    tables give an empty result; other columns are not read.
    """
    part = docs.select("doc_id", F.col(text).alias("_text"))
    items = benchmark_items(benchmark, min_tile)
    schema = T.StructType([part.schema["doc_id"], benchmark.schema["item_id"], *T.StructType.fromDDL(", ".join(_FOUND)).fields])
    names, kind = schema.names, to_arrow_type(benchmark.schema["item_id"].dataType)
    shared = _small(items, min_tile, threshold, max_broadcast)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in blocks(batch, "_text"):
                found = list(zip(*shared.value.leaks(buf, offsets)))
                if found:
                    ids = [shared.value.ids[i] for i in found[1]]
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(found[0])), pa.array(ids, kind), *(pa.array(x) for x in found[2:])], names=names)

    if shared is not None:
        return part.mapInArrow(run, schema)
    pairs = _candidates(part, items, min_tile, threshold)
    own = part.withColumn("digest", _digest("_text")).join(pairs, "digest").select("doc_id", "_text", "item_id", "words")

    def by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[bytes, Items] | None = None
        for batch in batches:
            for k in range(batch.num_rows):
                row, words = batch.slice(k, 1), batch.column("words")[k].as_py()
                if known is None or known[0] != words:
                    known = words, Items([None], [np.frombuffer(words, np.uint64)], min_tile, threshold)
                for rows, buf, offsets in blocks(row, "_text"):
                    for found in known[1].leaks(buf, offsets):
                        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("item_id"), *(pa.array([x]) for x in found[2:])], names=names)

    return own.mapInArrow(by_pair, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", min_tile: int = MIN_TILE, threshold: float = THRESHOLD, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that leak no item. Columns may have any names."""
    items = benchmark_items(benchmark, min_tile)
    shared = _small(items, min_tile, threshold, max_broadcast)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in blocks(batch, text):
                stay = np.ones(rows.num_rows, bool)
                for found in shared.value.leaks(buf, offsets):
                    stay[found[0]] = False
                yield rows.filter(pa.array(stay))

    if shared is not None:
        return docs.mapInArrow(run, docs.schema)
    # the same text leaks whichever row it stands in
    leaking = leaks(docs.select(F.hex(_digest(text)).alias("doc_id"), F.col(text).alias("text")), benchmark, "text", min_tile, threshold, max_broadcast)
    (digest,) = unused(docs.columns, "digest")
    return docs.withColumn(digest, F.hex(_digest(text))).join(leaking.select(F.col("doc_id").alias(digest)).distinct(), digest, "left_anti").select(*docs.columns)
