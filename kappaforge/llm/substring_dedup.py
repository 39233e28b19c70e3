"""Substring dedup with difference-cover anchors.

A window is ``width`` consecutive words. Positions whose number modulo the
period is in a difference cover are cover positions: for any two positions
there is a shift below the period that takes both onto cover positions. So two
equal windows, wherever they begin, share an anchor: ``width - period + 1``
words that begin at a cover position of either document.

1. Anchors are hashed and counted, with partial sums before the shuffle. An
   anchor that more rows have than the document has exact copies links it to
   another text.
2. Shared anchors are extended to all windows around them. The smallest doc_id
   of every such window is again a pre-aggregated minimum, joined back, so a
   passage in a third of all documents is never gathered in one place.
3. Words covered by a window that a smaller doc_id has are removed.

Exact copies (equal word sequences) are found first by digest; all but the one
with the smallest doc_id lose every word if they have a window at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaforge.llm.store import release, written
from kappaforge.llm.words import NON_SPACE, Hash, blocks, spans, window_starts

WIDTH = 50
#: perfect difference sets: period -> cover (fixed values)
COVERS = {3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
#: windows are told by hashes that have nothing in common, of words that are hashed twice
_WORD, _OTHER, _ANCHOR, _LOW, _HIGH = Hash(71), Hash(75), Hash(72), Hash(73), Hash(74)


def period_for(width: int) -> int:
    """The largest period that leaves anchors of at least a third of the window."""
    return max(p for p in COVERS if p == 3 or width - p + 1 >= width / 3)


def _anchors(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, document) of the anchors of documents that have a window."""
    period = period_for(width)
    size = width - period + 1
    at, doc = window_starts(first, size)
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True
    use = cover[(at - first[doc]) % period] & (np.diff(first)[doc] >= width)
    at, doc = at[use], doc[use]
    return _ANCHOR.slices(words, at, at + size), at, doc


def _windows(words: np.ndarray, others: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits that stand for the word sequence of each window: 64 by one hash of the words, 32 by another."""
    return _LOW.slices(words, at, at + width).view(np.int64), (_HIGH.slices(others, at, at + width) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _hashed(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, another hash of every word, number of each text's first word)."""
    starts, ends, first = spans(buf, offsets, NON_SPACE)
    return _WORD.words(buf, starts, ends), _OTHER.words(buf, starts, ends), first


def _list_of(column: pa.Array, i: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[i].as_py() : column.offsets[i + 1].as_py()] if column[i].is_valid else np.zeros(0, np.int64)


def exact_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, digest (of the words), first_id and class_size of every row with a doc_id."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for text in batch.column("_text"):
                words = (text.as_py() or "").encode().split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.binary())], names=["doc_id", "n_words", "digest"])

    part = docs.where("doc_id is not null")
    rows = written(part.mapInArrow(digests, part.select("doc_id").schema.add("n_words", "long").add("digest", "binary")), "digests")
    several = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("class_size")).where("class_size > 1")
    # both sides are read, so that the rows of a large class can be split; a text of one row needs no class
    out = rows.join(written(several, "several"), "digest", "left")
    return out.withColumns({"first_id": F.coalesce("first_id", "doc_id"), "class_size": F.coalesce("class_size", F.lit(1))})


def earlier_windows(docs: DataFrame, classes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, low, high): windows of first copies that a smaller doc_id has too."""
    spark = docs.sparkSession
    part = docs.where("doc_id is not null")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in blocks(batch, "_text"):
                starts, ends, first = spans(buf, offsets, NON_SPACE)
                keys, _, doc = _anchors(_WORD.words(buf, starts, ends), first, width)
                order = np.lexsort((keys, doc))
                keys, doc = keys[order], doc[order]
                once = np.append(True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))[: len(keys)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[once].view(np.int64)), rows.column("doc_id").take(pa.array(doc[once]))], names=["anchor", "doc_id"])

    own = part.mapInArrow(anchors, part.select(F.lit(0).cast("long").alias("anchor"), "doc_id").schema)
    shared = own.groupBy("anchor").agg(F.count("*").alias("rows")).where("rows > 1")
    known = classes.where("n_words >= %d" % width).groupBy("doc_id").agg(F.min("class_size").alias("class_size"), F.max(F.col("first_id") == F.col("doc_id")).alias("is_first"))
    linked = own.join(shared, "anchor").groupBy("doc_id", "rows").agg(F.collect_list("anchor").alias("anchors"))
    linked = linked.join(known.where("is_first"), "doc_id").where("rows > class_size").groupBy("doc_id").agg(F.flatten(F.collect_list("anchors")).alias("anchors"))
    linked = written(linked, "anchors")
    release(spark)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        period = period_for(width)
        for batch in batches:
            for rows, buf, offsets in blocks(batch, "_text"):
                words, others, first = _hashed(buf, offsets)
                keys, at, doc = _anchors(words, first, width)
                known = rows.column("anchors")
                hit = np.zeros(len(words) + 1, np.int64)
                for d in range(rows.num_rows):
                    a, b = np.searchsorted(doc, (d, d + 1))
                    found = at[a:b][np.isin(keys[a:b].view(np.int64), _list_of(known, d))]
                    np.add.at(hit, np.maximum(found - period + 1, first[d]), 1)
                    np.add.at(hit, found + 1, -1)
                starts, doc = window_starts(first, width)
                use = (np.cumsum(hit) > 0)[starts]  # windows that hold a shared anchor
                low, high = _windows(words, others, starts[use], width)
                key = np.stack([doc[use], low, high.astype(np.int64)])
                once = np.unique(key, axis=1) if key.shape[1] else key
                yield pa.RecordBatch.from_arrays([pa.array(once[1]), pa.array(once[2].astype(np.int32)), rows.column("doc_id").take(pa.array(once[0]))], names=["low", "high", "doc_id"])

    around = part.join(linked, "doc_id").select("doc_id", "_text", "anchors")
    schema = part.select(F.lit(0).cast("long").alias("low"), F.lit(0).alias("high"), "doc_id").schema
    found = written(around.mapInArrow(windows, schema), "windows")
    release(spark)
    first = found.groupBy("low", "high").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    return found.join(first, ["low", "high"]).where("doc_id > first_id").select("doc_id", "low", "high")


def deduplicate(docs: DataFrame, text: str = "text", width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the words left, if ``with_text``) of every row.

    Null texts have no words. A row without a doc_id is kept whole and is no
    earlier document; rows of equal doc_id are not earlier than each other. An
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    part = docs.select("doc_id", F.col(text).alias("_text"))
    classes = exact_classes(part)
    windows = earlier_windows(part, classes, width)
    whole = classes.where(f"doc_id > first_id and n_words >= {width}").groupBy("doc_id").agg(F.collect_set("digest").alias("copies"))
    marks = windows.groupBy("doc_id").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    marks = written(marks.join(whole, "doc_id", "full_outer"), "marks")
    release(spark)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in blocks(batch, "_text"):
                hashes, others, first = _hashed(buf, offsets)
                text = buf.tobytes()
                n, removed, sha, kept = np.diff(first), [], [], []
                for d in range(rows.num_rows):
                    words = text[offsets[d] : offsets[d + 1]].split()
                    copies = rows.column("copies")[d].as_py()
                    low = _list_of(rows.column("low"), d)
                    if copies and hashlib.sha256(b" ".join(words)).digest() in copies:
                        gone, words = len(words), []
                    elif len(low) and len(words) >= width:
                        at = np.arange(first[d], first[d + 1] - width + 1)
                        mine_low, mine_high = _windows(hashes, others, at, width)
                        bad = np.zeros((len(low), 2), np.int64)
                        bad[:, 0], bad[:, 1] = low, _list_of(rows.column("high"), d)
                        mine = np.stack([mine_low, mine_high.astype(np.int64)], 1)
                        start = np.isin(np.ascontiguousarray(mine).view("V16").ravel(), bad.view("V16").ravel())
                        cover = np.zeros(len(words) + 1, np.int64)
                        cover[: len(start)] += start
                        cover[width : width + len(start)] -= start
                        stay = np.cumsum(cover[:-1]) == 0
                        gone, words = int((~stay).sum()), list(compress(words, stay))
                    else:
                        gone = 0
                    body = b" ".join(words)
                    removed.append(gone)
                    sha.append(hashlib.sha256(body).hexdigest())
                    if with_text:
                        kept.append(body.decode())
                out = [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)]
                yield pa.RecordBatch.from_arrays([*out, pa.array(kept, pa.string())][: 5 if with_text else 4], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 5 if with_text else 4])

    schema = part.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if with_text:
        schema.add("kept", "string")
    return part.join(marks, "doc_id", "left").select("doc_id", "_text", "low", "high", "copies").mapInArrow(keep, schema)
