"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all texts, their labels
unread, is the unlabelled set. A linear model over hashed words (present or
not) minimises the non-negative risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

where the class prior is the toxic share of the labelled rows unless given.
The fit uses at most ``max_positive`` and ``max_unlabelled`` texts; candidate
words are those that positives have at least ``MIN_RATIO`` times as often as
unlabelled texts, by ``MIN_Z`` standard errors or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaforge.llm.labelled import first_by_hash, known_labels, remainder, sampled, split_column
from kappaforge.llm.words import ALNUM_LOWER, LOWER, Hash, U, blocks, spans

BITS = 22
MAX_POSITIVE, MAX_UNLABELLED = 3000, 6000
THRESHOLD = 0.5
MODULUS, HELD_OUT = 5, 0
MIN_RATIO, MIN_Z = 1.5, 4.0
_WORD = Hash(41)


def _buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, its document) of lower-cased text."""
    low = LOWER[buf]
    starts, ends, first = spans(low, offsets, ALNUM_LOWER)
    return (_WORD.words(low, starts, ends) & U((1 << BITS) - 1)).astype(np.int64), np.repeat(np.arange(len(offsets) - 1), np.diff(first))


@dataclass
class Model:
    """Sorted ``words`` (buckets) with their ``weights``."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.at = None

    def margin(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.at is None:
            self.at = np.full(1 << BITS, -1, np.int32)
            self.at[self.words] = np.arange(len(self.words))
        bucket, doc = _buckets(buf, offsets)
        found = self.at[bucket]
        hit = found >= 0
        n, k = len(offsets) - 1, max(1, len(self.words))
        once = np.unique(doc[hit] * k + found[hit])  # a word counts once in a text
        return self.bias + np.bincount(once // k, self.weights[once % k], n)

    def probability(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(buf, offsets), -30, 30)))


def _dense(rows: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), len(words)), np.float32)
    for i, r in enumerate(rows):
        at = np.searchsorted(words, r)
        at[at == len(words)] = 0
        x[i, at[words[at] == r]] = 1
    return x


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, max_words: int = 400, steps: int = 400, l2: float = 2e-4) -> Model:
    """nnPU with logistic loss; each row is the sorted distinct buckets of a text."""
    none = np.zeros(0, np.int64)
    prior = float(np.clip(prior, 1e-4, 0.9))
    if not positive or not unlabelled:
        return Model(none, np.zeros(0), float(np.log(prior / (1 - prior))))
    np_, nu = len(positive), len(unlabelled)
    in_p, n_p = np.unique(np.concatenate(positive), return_counts=True)
    in_u, n_u = np.unique(np.concatenate(unlabelled), return_counts=True)
    at = np.searchsorted(in_u, in_p)
    at[at == len(in_u)] = 0
    seen = np.where(in_u[at] == in_p, n_u[at], 0) if len(in_u) else np.zeros(len(in_p))
    share_p, share_u = n_p / np_, (seen + 1) / (nu + 2)
    pooled = (n_p + seen) / (np_ + nu)
    z = (share_p - seen / nu) / np.sqrt(pooled * (1 - pooled) * (1 / np_ + 1 / nu) + 1e-12)
    good = (n_p >= 3) & (share_p >= MIN_RATIO * share_u) & (z >= MIN_Z)
    words = np.sort(in_p[np.argsort(np.where(good, -z, 0))[: min(max_words, int(good.sum()))]])
    p, u = _dense(positive, words), _dense(unlabelled, words)
    w, b = np.zeros(len(words)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        dp, du = sig(zp), sig(zu)  # slopes of the loss for label -1
        if negative >= 0:
            cp, cu = prior * (dp - 1) / np_ - prior * dp / np_, du / nu
        else:  # the corrected part is overfitted: step back on it alone
            cp, cu = prior * dp / np_, -du / nu
        grad = np.append(p.T @ cp + u.T @ cu + l2 * w, cp.sum() + cu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.1 / np.sqrt(1 + t / 50) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - float(step[-1])
    return Model(words, w, b)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit from labels of rows that are not held out, and from texts alone."""
    known = known_labels(labels, "toxic", MODULUS, HELD_OUT)
    if prior is None:
        prior = known.agg(((F.sum("y") + 1) / (F.count("y") + 2)).alias("p")).first().p or 0.5
    positives = first_by_hash(known.where("y = 1").select("doc_id"), max_positive)
    unlabelled = first_by_hash(docs.select("doc_id").where(F.col("doc_id").isNotNull() & (remainder("doc_id", MODULUS) != HELD_OUT)).distinct(), max_unlabelled, seed=2)
    ids = positives.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False)))
    rows = sampled(docs.select("doc_id", F.col(text).alias("_text")), ids, "_text").select("positive", "_text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in blocks(batch, "_text"):
                bucket, doc = _buckets(buf, offsets)
                key = np.unique(doc << BITS | bucket)
                at = np.searchsorted(key, np.arange(part.num_rows + 1) << BITS)
                low = (key & ((1 << BITS) - 1)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([part.column("positive"), pa.array([low[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["positive", "words"])

    got = rows.mapInArrow(words, "positive boolean, words binary").toArrow()
    sides: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for flag, data in zip(got.column("positive").to_pylist(), got.column("words")):
        sides[flag].append(np.frombuffer(data.as_py(), np.uint32).astype(np.int64))
    return fit(sides[True], sides[False], prior)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null and empty texts are scored from no words; null ids are not held out;
    repeated rows stay; without positives every score is the class prior.
    """
    model = train(docs, labels, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    part = docs.select("doc_id", split_column("doc_id", MODULUS, HELD_OUT).alias("held_out"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in blocks(batch, "_text"):
                score = shared.value.probability(buf, offsets)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return part.mapInArrow(run, part.drop("_text").schema.add("score", "double").add("predicted", "integer"))
