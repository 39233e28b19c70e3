"""Quality rules: fixed counting rules and a hashed n-gram classifier.

The classifier is a logistic regression over hashed word 1- and 2-grams and
3- and 5-grams of code points, each family as relative frequencies. A hash of
the id deals labelled rows into four folds, at every size: three are fitted on,
at most ``max_rows`` rows of each class, and Platt scaling takes at most
``max_calibration`` rows, in their natural mix, of the fourth. Text is scored in Arrow batches: a document's score is the sum of its n-grams' mean
weights. A document stays if no counting rule fails and its probability of
good quality reaches ``threshold``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaforge.llm.labelled import first_by_hash, known_labels, sampled
from kappaforge.llm.text_stats import base_counts
from kappaforge.llm.words import NON_SPACE, Hash, U, blocks, code_points, mix, spans, window_starts

BITS = 16
MAX_ROWS, MAX_CALIBRATION = 1200, 4000
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MODULUS, HELD_OUT = 4, 2
_WORD, _PAIR = Hash(31), Hash(32)
_STEP = U(0x9E3779B97F4A7C15)
_FAMILIES = 4
#: entries of a step of the fit, so that its temporaries stay small beside the rows
_CHUNK = 1 << 18
FOLDS = 4


def _grams(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every family: (bucket of each n-gram, its document)."""
    mask = U((1 << BITS) // _FAMILIES - 1)
    starts, ends, first = spans(buf, offsets, NON_SPACE)
    words = _WORD.words(buf, starts, ends)
    n = len(offsets) - 1
    family = 0

    def out(keys, doc):
        nonlocal family
        family += 1
        return (keys & mask).astype(np.int64) + (family - 1) * (int(mask) + 1), doc

    yield out(words, np.repeat(np.arange(n), np.diff(first)))
    at, doc = window_starts(first, 2)
    yield out(_PAIR.slices(words, at, at + 2), doc)
    points, begin = code_points(buf, offsets)
    for size in (3, 5):
        at, doc = window_starts(begin, size)
        keys = np.zeros(len(at), np.uint64)
        for k in range(size):
            keys = keys * _STEP + points[at + k]
        yield out(mix(keys), doc)


def _rows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (document, bucket, relative frequency)."""
    docs, buckets, values = [], [], []
    for bucket, doc in _grams(buf, offsets):
        key, count = np.unique(doc << BITS | bucket, return_counts=True)
        d = key >> BITS
        total = np.bincount(doc, minlength=len(offsets) - 1)
        docs.append(d)
        buckets.append(key & ((1 << BITS) - 1))
        values.append(count / total[d])
    return np.concatenate(docs), np.concatenate(buckets), np.concatenate(values).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total = np.full(n, self.bias)
        for bucket, doc in _grams(buf, offsets):
            count = np.bincount(doc, minlength=n)
            total += np.bincount(doc, self.weights[bucket], n) / np.maximum(count, 1)
        return total

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _fit(begin: np.ndarray, bucket: np.ndarray, value: np.ndarray, y: np.ndarray, steps: int = 120, l2: float = 1e-6, rate: float = 1.0) -> Model:
    """Full-batch Adam on balanced log loss. Row k has the entries begin[k] to begin[k + 1] of ``bucket`` and ``value``."""
    n, k = len(y), 1 << BITS
    w, b = np.zeros(k), 0.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    cuts = np.unique(np.append(np.searchsorted(begin, np.arange(0, begin[-1], _CHUNK)), n))
    for t in range(1, steps + 1):
        grad = np.append(l2 * w, 0.0)
        for first, last in zip(np.append(0, cuts), cuts):
            own = slice(begin[first], begin[last])
            doc = np.repeat(np.arange(last - first), np.diff(begin[first : last + 1]))
            z = b + np.bincount(doc, value[own] * w[bucket[own]], last - first)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[first:last]) * each[first:last]
            grad[:k] += np.bincount(bucket[own], value[own] * g[doc], k)
            grad[k] += g.sum()
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        step = rate * 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) / np.sqrt(1 + t / 20)
        w -= step[:k]
        b -= step[k]
    return Model(w, float(b))


def _platt(margin: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of the calibrated probability, by Newton's method with smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-9, float(margin.std()))
    x = margin / scale
    loss = lambda a, b: float((np.logaddexp(0, a * x + b) - target * (a * x + b)).sum() + 5e-4 * a * a)
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-6)
        G = np.array([(g * x).sum() + 1e-3 * a, g.sum()])
        H = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum()]])
        step, size = np.linalg.solve(H, G), 1.0
        # a whole step may overshoot, above all on few rows
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > loss(a, b):
            size /= 2
        a, b = a - size * float(step[0]), b - size * float(step[1])
    return max(a, 1e-3) / scale, b


def folds(known: DataFrame, max_rows: int = MAX_ROWS, max_calibration: int = MAX_CALIBRATION) -> DataFrame:
    """(doc_id, y, fit) of the rows to fit on and, ``fit`` false, to calibrate on; no id is in both.

    The calibration fold is the first that has, and leaves, rows of both classes.
    Where there is none (a class of a single row, say) all rows are fitted on.
    """
    dealt = known.withColumn("_fold", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(FOLDS)))
    n = {(r["_fold"], r.y): r["count"] for r in dealt.groupBy("_fold", "y").count().collect()}
    total = [sum(k for (_, y), k in n.items() if y == c) for c in (0, 1)]
    held = next((f for f in range(FOLDS) if all(0 < n.get((f, c), 0) < total[c] for c in (0, 1))), -1)
    rest = dealt.where(F.col("_fold") != held).drop("_fold")
    chosen = [first_by_hash(rest.where(F.col("y") == y), max_rows) for y in (0, 1)]
    further = first_by_hash(dealt.where(F.col("_fold") == held).drop("_fold"), max_calibration, seed=1)
    return chosen[0].unionByName(chosen[1]).withColumn("fit", F.lit(True)).unionByName(further.withColumn("fit", F.lit(False)))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", max_rows: int = MAX_ROWS, max_calibration: int = MAX_CALIBRATION) -> Model:
    """Fit on labelled rows. Without rows of both classes the model accepts all texts."""
    ids = folds(known_labels(labels, "quality", MODULUS, HELD_OUT), max_rows, max_calibration)
    rows = sampled(docs.select("doc_id", F.col(text).alias("_text")), ids, "_text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in blocks(batch, "_text"):
                doc, bucket, value = _rows(buf, offsets)
                at = np.searchsorted(np.sort(doc), np.arange(part.num_rows + 1))
                order = np.argsort(doc, kind="stable")
                bucket, value = bucket[order].astype(np.uint16), value[order]
                yield pa.RecordBatch.from_arrays(
                    [part.column("y"), pa.array([bucket[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()), pa.array([value[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["y", "buckets", "values"]
                )

    got = rows.where("fit").select("y", "_text").mapInArrow(sparse, "y int, buckets binary, values binary").toArrow()
    y = np.asarray(got.column("y"), np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), 10.0)
    bucket = [np.frombuffer(x.as_buffer(), np.uint16) for x in got.column("buckets")]
    value = [np.frombuffer(x.as_buffer(), np.float32) for x in got.column("values")]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in bucket])]).astype(np.int64)
    bucket, value = np.concatenate(bucket), np.concatenate(value)
    del got
    model = _fit(begin, bucket, value, y)
    del bucket, value

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in blocks(batch, "_text"):
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(model.margin(buf, offsets))], names=["y", "margin"])

    more = rows.where("not fit").select("y", "_text").mapInArrow(margins, "y int, margin double").toArrow()
    cal_y = np.asarray(more.column("y"), np.int64)
    if len(cal_y) and cal_y.min() != cal_y.max():
        model.slope, model.shift = _platt(np.asarray(more.column("margin")), cal_y)
    return model


def _judge(model: Model, buf: np.ndarray, offsets: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    out = base_counts(buf, offsets)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["probability"] = model.probability(model.margin(buf, offsets))
    out["kept"] = ~out["base_failed"] & (out["probability"] >= threshold)
    return out


_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def judge(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns with counts, base_failed, probability and kept of every text.

    Null and empty texts have no words and fail; repeated rows stay; an empty
    table gives an empty result; columns beyond ``keep`` are dropped.
    """
    part = docs.select(*keep, F.col(text).alias("_text"))
    schema = part.drop("_text").schema
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    for x in _SCHEMA.split(", "):
        schema = schema.add(*x.split())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in blocks(batch, "_text"):
                found = _judge(shared.value, buf, offsets, threshold)
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keep), *(pa.array(found[x]) for x in names)], names=[*keep, *names])

    return part.mapInArrow(run, schema)


def passing(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that judge() keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in blocks(batch, text):
                yield rows.filter(pa.array(_judge(shared.value, buf, offsets, threshold)["kept"]))

    return docs.mapInArrow(run, docs.schema)
