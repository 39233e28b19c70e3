"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another; each visit fits a tree of at
most four leaves to the gradient summed in the feature's bins and adds it to
the feature's lookup table. Pairs are then ranked by the gain of one split on
each side of the residual, and the best get two-dimensional tables in the same
way. A score is the sum of looked-up bins, through the logistic function. The
fit uses at most ``max_rows`` labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kappaforge.llm.labelled import first_by_hash, known_labels, sampled, split_column
from kappaforge.llm.store import written
from kappaforge.llm.text_stats import FEATURES, features
from kappaforge.llm.words import blocks

MAX_ROWS = 20_000
THRESHOLD = 0.7
MODULUS, HELD_OUT = 4, 2
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LAMBDA, MIN_ROWS = 32, 8, 6, 80, 40, 0.15, 1.0, 4


@dataclass
class Gam:
    """Lookup tables: ``edges`` cut features into bins, ``tables`` hold their terms."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """(gain, bins to the left) of the best cut of ordered bins; gain 0 for none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = gl**2 / (hl + LAMBDA) + (g.sum() - gl) ** 2 / (h.sum() - hl + LAMBDA) - g.sum() ** 2 / (h.sum() + LAMBDA)
    gain = np.where((nl >= MIN_ROWS) & (n.sum() - nl >= MIN_ROWS), gain, 0)
    best = int(gain.argmax())
    return float(gain[best]), best + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values per bin of a tree of depth two."""
    out = np.zeros(len(g))

    def leaf(a: int, b: int, depth: int) -> None:
        gain, cut = _split(g[a:b], h[a:b], n[a:b]) if depth else (0.0, 0)
        if gain > 1e-6:
            leaf(a, a + cut, depth - 1)
            leaf(a + cut, b, depth - 1)
        else:
            out[a:b] = -g[a:b].sum() / (h[a:b].sum() + LAMBDA)

    leaf(0, len(g), 2)
    return out


def _cross(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values per cell) of one cut of the rows and then one of the columns on each side."""
    best, values = 0.0, np.zeros(g.shape)
    base = g.sum() ** 2 / (h.sum() + LAMBDA)
    for r in range(1, g.shape[0]):
        gain, out = -base, np.zeros(g.shape)
        for a, b in ((0, r), (r, g.shape[0])):
            gs, hs, ns = g[a:b].sum(0), h[a:b].sum(0), n[a:b].sum(0)
            own, cut = _split(gs, hs, ns)
            gain += own + gs.sum() ** 2 / (hs.sum() + LAMBDA)
            for c, d in ((0, cut), (cut, len(gs))):
                if d > c:
                    out[a:b, c:d] = -gs[c:d].sum() / (hs[c:d].sum() + LAMBDA)
        if gain > best and min(n[:r].sum(), n[r:].sum()) >= MIN_ROWS:
            best, values = gain, out
    return best, values


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Boost main terms, then pairs. One class only (or no rows) gives a constant of one half or that class's smoothed rate."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(rate / (1 - rate))))
    if not len(y) or y.min() == y.max():
        return model
    k = x.shape[1]
    model.edges = [_edges(x[:, f], BINS) for f in range(k)]
    model.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    margin = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[f], g, len(table)), np.bincount(bins[f], h, len(table)), counts[f])
            table += step
            margin += step[bins[f]]

    def grid(i: int, j: int, weights=None):
        a, b = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
        return np.bincount(coarse[i] * b + coarse[j], weights, a * b).reshape(a, b)

    g, h = slopes()
    ranked = sorted(combinations(range(k), 2), key=lambda p: -_cross(grid(*p, g), grid(*p, h), grid(*p))[0])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = RATE * _cross(grid(i, j, g), grid(i, j, h), grid(i, j))[1]
            table += step
            margin += step[coarse[i], coarse[j]]
    return model


def feature_rows(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the feature vector of every text."""
    part = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in blocks(batch, "_text"):
                x = features(buf, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keep), lists], names=[*keep, "features"])

    return part.mapInArrow(run, part.drop("_text").schema.add("features", T.ArrayType(T.FloatType())))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float32).reshape(-1, len(FEATURES))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null and empty texts are scored from zero features; null ids are not held
    out; repeated rows stay; without labels every score is one half. Columns of
    ``docs`` other than doc_id and ``text`` are not read.
    """
    rows = written(feature_rows(docs, text), "gam")
    known = sampled(rows, first_by_hash(known_labels(labels, "quality", MODULUS, HELD_OUT), max_rows), "features").select("features", "y").toArrow()
    model = fit(_matrix(known.column("features")), np.asarray(known.column("y"), np.float64))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.probability(_matrix(batch.column("features")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    part = rows.select("doc_id", split_column("doc_id", MODULUS, HELD_OUT).alias("held_out"), "features")
    return part.mapInArrow(run, part.select("doc_id", "held_out").schema.add("score", "double").add("predicted", "integer"))
