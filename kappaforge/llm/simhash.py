"""SimHash near-duplicate detection by tiled exact comparison.

A fingerprint has a bit for each of 64: 1 if it is set in over half of the
hashes of a text's shingles. Two fingerprints are linked if they differ in
``RADIUS`` bits or fewer, and they are compared as they are, not by parts of
them: distinct fingerprints are dealt to tiles, and tiles are compared in pairs
with numpy's exclusive-or and bit counts.

A fingerprint's cell is its population counts: of the whole, of a half and of
two quarters. Cells stand in the order of these counts and are cut into tiles of
about ``TILE`` fingerprints, large cells into several. Two fingerprints differ
in at least as many bits as their population counts do, part by part, so a pair
of tiles whose ranges are further apart than the radius is skipped; in a task
the same is done again for rows of ``ROW`` fingerprints, by the counts of all
eight bytes too.

A pair of tiles does not emit its links, of which a group of near copies has as
many as pairs, but what of a spanning forest joins its fingerprints: components
are the same. The number of comparisons grows with the square of the number of
distinct fingerprints, divided by what the counts skip.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kappaforge.llm.components import components
from kappaforge.llm.store import dropped, written
from kappaforge.llm.words import LOWER, NON_SPACE, blocks, spans, window_starts

SHINGLE, RADIUS, SEED = 4, 4, 42
#: fingerprints of a tile (about) and of a row of one; shingles hashed at a time
TILE, ROW, HASHED = 4096, 256, 1 << 16
#: parts whose population counts order the cells: masks of the whole, a half and two quarters
_PARTS = (-1, 0xFFFFFFFF, 0xFFFF, 0xFFFF << 32)


def fingerprints(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of every text, as uint64."""
    low = LOWER[buf]
    starts, ends, first = spans(low, offsets, NON_SPACE)
    # words joined by one space: each keeps itself and one byte behind it
    size = ends - starts + 1
    at = np.cumsum(size) - size
    joined = np.full(int(size.sum()), 0x20, np.uint8)
    own = np.arange(len(joined)) - np.repeat(at, size) < np.repeat(size - 1, size)
    joined[own] = low[NON_SPACE[low]]
    text = joined.tobytes()
    begin, doc = window_starts(first, SHINGLE)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE))
    last = np.append(begin + SHINGLE - 1, first[short + 1] - 1)
    begin, doc = np.append(begin, first[short]), np.append(doc, short)
    ones, total = np.zeros((len(offsets) - 1, 64), np.int64), np.bincount(doc, minlength=len(offsets) - 1)
    a, b = at[begin].tolist(), (at[last] + size[last] - 1).tolist()
    for k in range(0, len(a), HASHED):
        shingles = map(text.__getitem__, map(slice, a[k : k + HASHED], b[k : k + HASHED]))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(a[k : k + HASHED]))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = doc[k : k + HASHED]
        cut = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        np.add.at(ones, of[cut], np.add.reduceat(bits, cut, axis=0, dtype=np.int64))
    return np.packbits((2 * ones > total[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and print (a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in blocks(batch, "_text"):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fingerprints(buf, offsets).view(np.int64))], names=["doc_id", "print"])

    part = docs.select("doc_id", F.col(text).alias("_text"))
    return part.mapInArrow(run, part.select("doc_id").schema.add("print", "long"))


def _counts(print_: Column) -> list[Column]:
    return [F.bit_count(print_.bitwiseAND(F.lit(m))).alias(f"c{k}") for k, m in enumerate(_PARTS)]


def tiles(prints: DataFrame, size: int = TILE) -> tuple[DataFrame, DataFrame]:
    """((tile, print), (tile, low and high of every part's count)) of distinct fingerprints.

    How many fingerprints a cell has is a table of at most 65 * 33 * 17 * 17 rows, whatever the input.
    """
    spark = prints.sparkSession
    cells = prints.groupBy(*_counts(F.col("print"))).agg(F.count("*").alias("n")).orderBy("c0", "c1", "c2", "c3").toPandas()
    upto = cells.n.cumsum()
    cells["first"] = (upto - cells.n) // size
    cells["pieces"] = np.maximum((upto - 1) // size - cells["first"] + 1, 1)
    plan = spark.createDataFrame(cells[["c0", "c1", "c2", "c3", "first", "pieces"]], "c0 int, c1 int, c2 int, c3 int, first long, pieces long")
    dealt = prints.select("print", *_counts(F.col("print"))).join(F.broadcast(plan), ["c0", "c1", "c2", "c3"])
    dealt = dealt.select((F.col("first") + F.pmod(F.xxhash64("print"), "pieces")).alias("tile"), "print")
    spread = plan.select(F.explode(F.sequence("first", F.col("first") + F.col("pieces") - 1)).alias("tile"), *(f"c{k}" for k in range(len(_PARTS))))
    ends = [f(f"c{k}").alias(f"{x}{k}") for k in range(len(_PARTS)) for x, f in (("low", F.min), ("high", F.max))]
    return dealt, spread.groupBy("tile").agg(*ends)


def tile_pairs(ranges: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of tiles, a <= b, whose fingerprints' population counts may be within the radius."""
    x = ranges.withColumn("count", F.explode(F.sequence(F.col("low0"), F.col("high0")))).alias("x")
    y = ranges.withColumn("count", F.explode(F.sequence(F.col("low0"), F.col("high0") + radius))).alias("y")
    gap = lambda k: F.greatest(F.col(f"x.low{k}") - F.col(f"y.high{k}"), F.col(f"y.low{k}") - F.col(f"x.high{k}"), F.lit(0))
    near = (gap(0) <= radius) & (gap(1) <= radius) & (gap(2) + gap(3) <= radius)
    met = x.join(y, (F.col("x.count") == F.col("y.count")) & near)
    # tiles are numbered by their counts, so the one with the smaller count has the smaller number or the same counts
    return met.select(F.least("x.tile", "y.tile").alias("a"), F.greatest("x.tile", "y.tile").alias("b")).distinct()


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Makes components of ``label`` that pairs (i, j) link one, with the smallest number as their label."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def forest(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, y) of fingerprints that join all of ``a`` and ``b`` (``a`` with itself without ``b``) that the radius links."""

    def ordered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = np.bitwise_count(x[:, None].view(np.uint8)).astype(np.int16)
        q = parts.reshape(-1, 4, 2).sum(2)
        by = np.lexsort((*parts.T, *q.T, q[:, 0] + q[:, 1], q.sum(1)))
        return x[by], parts[by]

    def bounds(parts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        cut = np.arange(0, len(parts), ROW)
        out = []
        for width in (8, 4, 2, 1):
            p = parts.reshape(len(parts), -1, width).sum(2)
            out.append((np.minimum.reduceat(p, cut, axis=0), np.maximum.reduceat(p, cut, axis=0)))
        return out

    a, of_a = ordered(a)
    b, of_b = (a, of_a) if b is None else ordered(b)
    label = np.arange(len(a) if b is a else len(a) + len(b))
    shift = 0 if b is a else len(a)
    near = None
    for (low_a, high_a), (low_b, high_b) in zip(bounds(of_a), bounds(of_b)):
        gap = np.maximum(low_a[:, None] - high_b[None], low_b[None] - high_a[:, None]).clip(0).sum(2)
        near = gap <= radius if near is None else near & (gap <= radius)
    if b is a:
        near = np.triu(near)
    for s in np.flatnonzero(near.any(1)).tolist():
        x = a[s * ROW : (s + 1) * ROW, None]
        for t in np.flatnonzero(near[s]).tolist():
            differ = np.bitwise_count(x ^ b[t * ROW : (t + 1) * ROW])
            if differ.min() <= radius:
                i, j = np.nonzero(differ <= radius)
                _joined(label, i + s * ROW, j + t * ROW + shift)
    both = a if b is a else np.append(a, b)
    child = np.flatnonzero(label != np.arange(len(label)))
    return both[child], both[label[child]]


def links(prints: DataFrame, radius: int = RADIUS, size: int = TILE) -> DataFrame:
    """(a, b) of distinct fingerprints, a column ``print``, that join all within the radius."""
    dealt, ranges = tiles(prints, size)
    packed = written(dealt.groupBy("tile").agg(F.collect_list("print").alias("prints")), "tiles")
    pairs = written(tile_pairs(ranges, radius), "tile-pairs")
    left, right = (packed.select(F.col("tile").alias(x), F.col("prints").alias(f"prints_{x}")) for x in "ab")
    met = pairs.join(left, "a").join(right, "b").select((F.col("a") == F.col("b")).alias("same"), "prints_a", "prints_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in ("prints_a", "prints_b"))
                x, y = forest(a, None if batch.column("same")[k].as_py() else b, radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = RADIUS, size: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row.

    Null texts and texts without words have fingerprint 0, linked like any other.
    Rows of one text, or of one doc_id, are linked by their fingerprints as other
    rows are; a row without a doc_id has the component of its fingerprint, null
    if no row of it has a doc_id. An empty table gives an empty result; other
    columns are not read.
    """
    rows = written(with_fingerprints(docs, text), "prints")
    first = written(rows.groupBy("print").agg(F.min("doc_id").alias("first_id")), "first")
    found = components(links(first.select("print"), radius, size))
    labels = first.join(found, F.col("print") == F.col("node"), "left").select("print", "first_id", F.coalesce("label", "print").alias("label"))
    labels = written(labels, "labels")
    ids = labels.groupBy("label").agg(F.min("first_id").alias("component_id"))
    # beside a written table, the rows of a common fingerprint can be split
    of_print = written(labels.join(ids, "label").select(F.col("print").alias("own"), "component_id"), "components")
    dropped(first, labels)
    return rows.join(of_print, F.col("print") == F.col("own")).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
