"""Power of study designs: post hoc by exact sums, before a study by simulation spread over tasks.

A grid of settings is a DataFrame; each setting is split into batches of
simulations with their own random streams, so a result depends on the seed and
the setting only, and a lost task is drawn again alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED, P_CODER = 42, 0.52
DELTAS, PHIS, TARGETS = (0.10, 0.15, 0.20, 0.25, 0.30), (0.2, 0.4, 0.6), (0.80, 0.90, 0.95)
BATCH = 500
_NORMAL = NormalDist()


def _batches(grid: DataFrame, sims: int) -> DataFrame:
    first = F.explode(F.sequence(F.lit(0), F.lit(sims - 1), F.lit(BATCH)))
    rows = grid.withColumn("first", first)
    return rows.withColumn("size", F.least(F.lit(BATCH), F.lit(sims) - F.col("first"))).withColumn("stream", F.xxhash64(*grid.columns, "first")).repartition("stream")


def _rate(grid: DataFrame, sims: int, one, out: str, seed: int) -> DataFrame:
    """Mean of ``one(rng, setting, size)``, the number of successes, over all simulations of a setting."""
    columns = grid.columns
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grid.schema) + ", hits long, size long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hits = [int(one(np.random.default_rng([seed, r.stream & (2**63 - 1)]), r, int(r.size_))) for r in frame.rename(columns={"size": "size_"}).itertuples()]
            yield frame[columns].assign(hits=hits, size=frame["size"].astype("int64"))

    return _batches(grid, sims).mapInPandas(run, ddl).groupBy(*columns).agg((F.sum("hits") / F.sum("size")).alias(out))


def _cells(p_model: float, p_coder: float, phi: float) -> list[float]:
    """Probabilities of both, model only, coder only and neither of a pair with latent correlation ``phi``."""
    if 0 < p_model < 1 and 0 < p_coder < 1:
        both = bivariate_cdf(_NORMAL.inv_cdf(p_model), _NORMAL.inv_cdf(p_coder), phi)
    else:
        both = p_model * p_coder
    both = min(max(both, p_model + p_coder - 1, 0.0), p_model, p_coder)
    return [both, p_model - both, p_coder - both, max(0.0, 1 - p_model - p_coder + both)]


def _rejections(rng: np.random.Generator, r, size: int) -> int:
    critical = 3.841458820694124
    # the test reads the counts of the 2x2 table only, so these are drawn and not n pairs
    b, d = rng.multinomial(int(r.n), _cells(r.p_model, r.p_coder, r.phi), size)[:, 1:3].T
    chi2 = np.where(b + d == 0, 0.0, (np.abs(b - d) - 1.0) ** 2 / np.maximum(b + d, 1))
    return (chi2 > critical).sum()


def mcnemar_power(grid: DataFrame, sims: int = 20_000, seed: int = SEED) -> DataFrame:
    """Power at alpha 0.05 of the continuity-corrected test for every (n, p_model, p_coder, phi) of ``grid``."""
    return _rate(grid.select("n", "p_model", "p_coder", "phi"), sims, _rejections, "power", seed)


def episodes_needed(spark: SparkSession, settings: list[tuple[float, float, float]], sims: int = 20_000, cap: int = 1000) -> list[tuple[float, float, float, float]]:
    """(target, delta, phi, episodes): binary search over n for all settings side by side, one job a step; infinity beyond ``cap``."""
    span = {s: (10, cap) for s in settings}
    while open_ := {s: (a + b) // 2 for s, (a, b) in span.items() if a < b}:
        rows = [(n, min(P_CODER + delta, 0.98), P_CODER, phi) for (_, delta, phi), n in open_.items()]
        grid = spark.createDataFrame(sorted(set(rows)), "n int, p_model double, p_coder double, phi double")
        power = {(r.n, r.p_model, r.phi): r.power for r in mcnemar_power(grid, sims).collect()}
        for (target, delta, phi), n in open_.items():
            low, high = span[target, delta, phi]
            enough = power[n, min(P_CODER + delta, 0.98), phi] >= target
            span[target, delta, phi] = (low, n) if enough else (n + 1, high)
    return [(*s, float(a) if a < cap else math.inf) for s, (a, _) in span.items()]


def apriori(spark: SparkSession, sims: int = 20_000) -> DataFrame:
    """Episodes needed by power target, effect and correlation."""
    rows = episodes_needed(spark, [(t, d, p) for t in TARGETS for d in DELTAS for p in PHIS], sims)
    return spark.createDataFrame(rows, "power double, delta double, phi double, episodes double")


def apriori_table(long: DataFrame, target: float = 0.80) -> DataFrame:
    """One target's episodes as delta by phi."""
    return long.where(F.col("power") == target).groupBy("delta").pivot("phi").agg(F.first("episodes")).orderBy("delta")


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection on its distribution function (Simpson's rule)."""

    def cdf(x: float) -> float:
        steps = 400
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        f = lambda u: c * (1 + u * u / df) ** (-(df + 1) / 2)
        h = x / steps
        return 0.5 + h / 3 * sum((1 if k in (0, steps) else 4 if k % 2 else 2) * f(k * h) for k in range(steps + 1))

    low, high = -100.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def _difficulty(rng: np.random.Generator, size: tuple, p: float, rho: float) -> np.ndarray:
    k = 1 / rho - 1
    return rng.beta(p * k, (1 - p) * k, size)


def _outliers(rng: np.random.Generator, r, size: int) -> int:
    n = int(r.n_triple)
    if n < 2:
        return 0
    q = _difficulty(rng, (size, n), r.p_mm, r.rho)
    low = rng.binomial(2 * int(r.items), np.clip(q - r.delta, 0, 1)) / (2 * int(r.items))
    contrast = low - rng.binomial(int(r.items), q) / int(r.items)
    sd = contrast.std(1, ddof=1)
    t = np.where(sd > 0, contrast.mean(1) / np.maximum(sd, 1e-12) * math.sqrt(n), 0)
    return (t < -t_quantile(0.95, n - 1)).sum()


def outlier_power(grid: DataFrame, sims: int = 3000, seed: int = SEED) -> DataFrame:
    """Power to find one clinician agreeing ``delta`` less, per (n_triple, p_mm, rho, delta, items)."""
    return _rate(grid.select("n_triple", "p_mm", "rho", "delta", "items"), sims, _outliers, "power", seed)


def _design_intervals(rng: np.random.Generator, r, n_boot: int) -> tuple[float, float]:
    """Interval of pooled agreement of one simulated design, episodes drawn again."""
    nt, nd, items = int(r.n_triple), int(r.n_double), int(r.items)
    q = _difficulty(rng, nt + nd, r.p_mm, r.rho)
    size = np.where(np.arange(nt + nd) < nt, 3 * items, items)
    agree = rng.binomial(size, q)
    pick = rng.integers(0, nt + nd, (n_boot, nt + nd))
    means = agree[pick].sum(1) / size[pick].sum(1)
    return tuple(np.percentile(means, [2.5, 97.5]))


def design(grid: DataFrame, reps: int = 400, n_boot: int = 800, seed: int = SEED) -> DataFrame:
    """Median half-width of the ceiling's interval, and how often its lower bound clears the coder, per (n_triple, n_double, p_mm, rho, items)."""
    columns = ["n_triple", "n_double", "p_mm", "rho", "items"]
    runs = grid.select(columns).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("stream", F.xxhash64(*columns, "rep")).repartition("stream")
    ddl = ", ".join(f"{c} {runs.schema[c].dataType.simpleString()}" for c in columns) + ", lo double, hi double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [_design_intervals(np.random.default_rng([seed, r.stream & (2**63 - 1)]), r, n_boot) for r in frame.itertuples()]
            yield frame[columns].assign(lo=[x[0] for x in found], hi=[x[1] for x in found])

    done = runs.mapInPandas(run, ddl)
    return done.groupBy(columns).agg(F.percentile((F.col("hi") - F.col("lo")) / 2, F.lit(0.5)).alias("halfwidth"), F.avg(F.when(F.col("lo") > P_CODER, 1.0).otherwise(0.0)).alias("above_coder"))


def bivariate_cdf(h: float, k: float, r: float) -> float:
    """P(X < h, Y < k) of standard normals with correlation r (Gauss-Legendre over the correlation)."""
    x, w = np.polynomial.legendre.leggauss(48)
    a = math.asin(max(-1.0, min(1.0, r)))
    t = a * (x + 1) / 2
    s, c = np.sin(t), np.cos(t)
    body = np.exp(-(h * h + k * k - 2 * h * k * s) / (2 * c * c))
    return _NORMAL.cdf(h) * _NORMAL.cdf(k) + a / 2 * float((w * body).sum()) / (2 * math.pi)


def tetrachoric(both: int, first: int, second: int, neither: int) -> float:
    """Latent correlation of a 2x2 table of paired successes; NaN where no correlation gives it."""
    n = both + first + second + neither
    inside = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    h, k = _NORMAL.inv_cdf(inside((both + first) / n)), _NORMAL.inv_cdf(inside((both + second) / n))
    gap = lambda r: bivariate_cdf(h, k, r) - both / n
    low, high = -0.999, 0.999
    if gap(low) > 0 or gap(high) < 0:
        return math.nan
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if gap(mid) < 0 else (low, mid)
    return (low + high) / 2


def binomial_tail(k: np.ndarray, m: np.ndarray, p: float) -> np.ndarray:
    """P(X >= k) of Binomial(m, p), by the continued fraction of the incomplete beta function (modified Lentz)."""
    k, m = np.asarray(k, float), np.asarray(m, float)
    out = np.where(k <= 0, 1.0, 0.0)
    inner = np.flatnonzero((k > 0) & (k <= m))
    if not len(inner) or not 0 < p < 1:
        return np.where((k > 0) & (k <= m) & (p >= 1), 1.0, out)
    a, b = k[inner], m[inner] - k[inner] + 1
    x = np.full(len(inner), p)
    flip = x > (a + 1) / (a + b + 2)  # the fraction converges fast on one side only
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    log = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(log(a + b) - log(a) - log(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    value = d.copy()
    for i in range(1, 20_000):
        for step in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            value *= d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    out[inner] = np.where(flip, 1 - front * value, front * value)
    return out


def exact_power(n: int, p_model: float, p_coder: float, phi: float) -> float:
    """Power at alpha 0.05 of the continuity-corrected test: a sum over the number of discordant pairs.

    Given their number, those of one kind are binomial, and the test rejects beyond
    a count on either side. Numbers further than ten deviations from the mean weigh
    less than rounding does.
    """
    critical = 3.841458820694124
    _, first, second, _ = _cells(p_model, p_coder, phi)
    q = first + second
    if q <= 0 or n < 1:
        return 0.0
    reach = 10 * math.sqrt(n * q * max(1 - q, 0.0)) + 30
    m = np.arange(max(0, math.floor(n * q - reach)), min(n, math.ceil(n * q + reach)) + 1)
    log = np.vectorize(math.lgamma, otypes=[float])
    weight = np.exp(math.lgamma(n + 1) - log(m + 1.0) - log(n - m + 1.0) + m * math.log(q) + ((n - m) * math.log1p(-q) if q < 1 else np.where(m == n, 0.0, -np.inf)))
    # the smallest count of one kind with (|2b - m| - 1)^2 > critical * m, found from above and set right by a step
    least = np.floor((m + 1 + np.sqrt(critical * m)) / 2).astype(np.int64)
    rejects = lambda b: (2 * b - m > 0) & ((np.abs(2 * b - m) - 1.0) ** 2 > critical * m)
    least = np.where(rejects(least), least, least + 1)
    p = first / q
    return float((weight * (binomial_tail(least, m, p) + binomial_tail(least, m, 1 - p))).sum())


#: differences looked at for the smallest detectable one, in hundredths
STEPS = range(2, 60)


def posthoc(counts: DataFrame) -> DataFrame:
    """Per pair of the 2x2 counts: match rates, tetrachoric correlation, achieved power and detectable differences.

    Every pair and difference is a row of its own, so that tasks share them. Where
    no correlation gives the table, 0.2 is taken; pairs without counts have none.
    """
    ddl = "pair string, n long, p_model double, p_coder double, phi double"

    def rates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = f.both_hit + f.a_only + f.b_only + f.neither
            f = f.assign(n=n, p_model=(f.both_hit + f.a_only) / n, p_coder=(f.both_hit + f.b_only) / n)
            yield f.assign(phi=[tetrachoric(*map(int, r)) for r in zip(f.both_hit, f.a_only, f.b_only, f.neither)])[["pair", "n", "p_model", "p_coder", "phi"]]

    def powers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rho = f.phi.fillna(0.2)
            other = f.p_model.where(f.step.isna(), (f.p_coder + f.step / 100).clip(upper=0.98))
            yield f.assign(power=[exact_power(int(n), a, b, r) for n, a, b, r in zip(f.n, other, f.p_coder, rho)])

    tables = counts.select("pair", "both_hit", "a_only", "b_only", "neither").where("both_hit + a_only + b_only + neither > 0").mapInPandas(rates, ddl)
    each = tables.withColumn("step", F.explode(F.array(F.lit(None).cast("int"), *map(F.lit, STEPS)))).repartition("pair", "step")
    done = each.mapInPandas(powers, ddl + ", step int, power double")
    smallest = lambda t: F.coalesce(F.min(F.when(F.col("power") >= t, F.col("step"))) / 100, F.lit(math.nan)).alias(f"mde_{round(100 * t)}")
    done = done.withColumn("phi", F.coalesce("phi", F.lit(math.nan)))  # tasks hand on NaN as null
    return done.groupBy("pair", "n", "p_model", "p_coder", "phi").agg(F.max(F.when(F.col("step").isNull(), F.col("power"))).alias("power"), *(smallest(t) for t in TARGETS))


def minimum_detectable(n: int, p_coder: float, phi: float, target: float) -> float:
    """Smallest difference, in steps of 0.01 from 0.02, with the target power. NaN if none up to 0.59."""
    return next((k / 100 for k in STEPS if exact_power(n, min(p_coder + k / 100, 0.98), p_coder, phi) >= target), math.nan)
