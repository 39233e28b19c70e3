"""Word vectors learned from a corpus: co-occurrence counts, positive mutual information, randomised SVD.

Words near each other are counted by tasks over their own texts, and counts are
summed before they are shuffled. The matrix of mutual information stays a table
of rows; it is only ever multiplied with a thin matrix, words by ``dim`` and a
few, which with the vocabulary bounds what is broadcast and gathered: 20,000
words by 60 numbers are 10 MB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaforge.sources.scratch import kept

WORD = r"[\p{L}\p{N}]+"
#: words of the vocabulary, reach of a word's neighbourhood, numbers of a vector, further columns of the sketch, and its passes
VOCABULARY, REACH, DIM, MORE, PASSES = 20_000, 4, 50, 10, 2


@dataclass
class Vectors:
    """A vector for every word of the vocabulary; rows of ``matrix`` in the order of ``words``."""

    words: dict[str, int]
    matrix: np.ndarray

    def of(self, text: str) -> np.ndarray:
        """The mean of the vectors of a text's words; zeros if none is known."""
        known = [self.words[w] for w in re.findall(r"[^\W_]+", text.lower()) if w in self.words]
        return self.matrix[known].mean(0) if known else np.zeros(self.matrix.shape[1])

    def similarity(self, a: str, b: str) -> float:
        """Cosine of two texts' vectors, 0 if one has none."""
        x, y = self.of(a), self.of(b)
        size = float(np.linalg.norm(x) * np.linalg.norm(y))
        return float(x @ y) / size if size else 0.0


def words_of(texts: DataFrame, text: str) -> DataFrame:
    """One column, words: the words of every text, lower case; null texts are left out."""
    return texts.where(F.col(text).isNotNull()).select(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)).alias("words"))


def vocabulary(words: DataFrame, size: int = VOCABULARY) -> list[str]:
    """The ``size`` most frequent words, equal counts by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.value_counts(batch.column("words").flatten())
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    # words are counted by batch, as a row for each of them is most of the work
    counts = words.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]


def cooccurrences(words: DataFrame, known: list[str], reach: int = REACH) -> DataFrame:
    """(a, b, n): how often two words of the vocabulary, by number, stand within ``reach`` places of each other; both orders."""
    value_set = words.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(value_set.value, pa.string())
        for batch in batches:
            lists = batch.column("words")
            ids = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            found = []
            for k in range(1, reach + 1):
                a, b = ids[:-k], ids[k:]
                go = (a >= 0) & (b >= 0) & (doc[:-k] == doc[k:])
                found += [a[go] << 32 | b[go], b[go] << 32 | a[go]]
            pair, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair >> 32), pa.array(pair & 0xFFFFFFFF), pa.array(n)], names=["a", "b", "n"])

    return words.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def mutual_information(pairs: DataFrame) -> DataFrame:
    """(a, bs, values): the rows of the positive mutual information of (a, b, n)."""
    pairs = kept(pairs)
    sums = pairs.groupBy("a").agg(F.sum("n").alias("sum"))
    total = sums.agg(F.sum("sum")).first()[0] or 0
    of_b = F.broadcast(sums.select(F.col("a").alias("b"), F.col("sum").alias("sum_b")))  # a row a word of the vocabulary
    value = F.log(F.col("n") * F.lit(float(total)) / (F.col("sum") * F.col("sum_b")))
    rows = pairs.join(F.broadcast(sums), "a").join(of_b, "b").withColumn("value", value).where("value > 0")
    return kept(rows.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "value"))).alias("x")).select("a", F.col("x.b").alias("bs"), F.col("x.value").alias("values")))


def times(rows: DataFrame, thin: np.ndarray) -> np.ndarray:
    """The matrix of ``rows`` (a, bs, values) times a thin one."""
    shared = rows.sparkSession.sparkContext.broadcast(thin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = batch.column("bs").flatten().to_numpy(), batch.column("values").flatten().to_numpy()
            begin = np.append(0, np.cumsum(pc.list_value_length(batch.column("bs")).to_numpy(zero_copy_only=False)))
            out = np.stack([x[i:j] @ shared.value[at[i:j]] for i, j in zip(begin, begin[1:])]) if batch.num_rows else np.zeros((0, thin.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * thin.shape[1], pa.int32()), pa.array(out.ravel()))], names=["a", "y"])

    got = rows.mapInArrow(run, "a long, y array<double>").toArrow()
    out = np.zeros_like(thin)
    out[np.asarray(got.column("a"), np.int64)] = np.array(got.column("y").to_pylist(), float).reshape(-1, thin.shape[1])
    return out


def learned(texts: DataFrame, text: str = "text", size: int = VOCABULARY, dim: int = DIM, reach: int = REACH, seed: int = 0) -> Vectors:
    """Vectors of the most frequent words of ``texts``; without any word, of none."""
    words = words_of(texts, text)
    known = vocabulary(words, size)
    if not known:
        return Vectors({}, np.zeros((0, dim)))
    rows = mutual_information(cooccurrences(words, known, reach))
    width = min(dim + MORE, len(known))
    thin = times(rows, np.random.default_rng(seed).standard_normal((len(known), width)))
    for _ in range(PASSES):
        thin = times(rows, np.linalg.qr(thin)[0])
    basis = np.linalg.qr(thin)[0]
    left, sizes, _ = np.linalg.svd(times(rows, basis).T, full_matrices=False)  # symmetric: basis' * matrix
    matrix = (basis @ left) * np.sqrt(sizes)
    return Vectors({w: k for k, w in enumerate(known)}, matrix[:, :dim])
