"""Bootstrap intervals and tests over units, one row per episode.

Every draw takes exactly as many units as there are, with replacement. Both
generators work on integers that SQL engines compute alike. 'lcg' takes the unit
of a counted index for every place of a draw. The other draws in two parts:
every unit gets a Poisson weight of a rate a little below 1, from the digest of
the unit and the draw, and the places that are then left over, one in 64 at
least, are filled by counted indices, which travel packed by blocks of units. A Poisson vector with a
given sum is multinomial, so the whole is a draw of n units; a draw whose first
part is already too large (once in thousands) is filled by indices alone. Tasks
sum weighted values per draw, so no draw and no group is gathered anywhere, and
results do not depend on partitions.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kappaforge.operators.ranked import numbered
from kappaforge.sources.scratch import kept

N_BOOT, SEED = 2000, 42
_A, _B, _C, _M = 7919, 104729, 12345, 1000003
#: places of a draw in a row
BLOCK = 8192
#: modulus and factors of the numbers that weights and indices come from
MODULUS, FACTORS = 2**31 - 1, (48271, 69621, 16807)
#: Poisson rates are multiples of 1 / RATES; the rate is below 1 by three deviations of the sum at least
RATES, MARGIN = 64, (3 * 64) ** 2
#: by rate, the numbers at which the weight goes up
POISSON = tuple(tuple(int(MODULUS * sum(math.exp(-j / RATES) * (j / RATES) ** k / math.factorial(k) for k in range(n))) for n in range(1, 11)) for j in range(RATES + 1))


def lcg_index(draw: Column, pos: Column, n: Column) -> Column:
    """The unit that a draw takes at a place; SQL engines compute it alike."""
    return F.pmod(draw * _A + pos * _B + draw * pos + F.lit(_C), F.lit(_M)) % n


def lcg_means(units: DataFrame, columns: list[str], n_boot: int, by: str = "pair", order: str = "key", least: int = 20_000) -> DataFrame:
    """(by, draw, mean of every column over the draw's units), nulls skipped, by the integer generator.

    Groups of ``least`` units count how often a draw takes a unit, in at most _M steps
    a draw; smaller ones join every place with its unit, which is less for them.
    """
    packed = numbered(units.select(by, order, *(F.col(c).cast("double").alias(c) for c in columns)), [by], [order])
    small = _lcg_by_places(packed.where(F.col("_size") < least), columns, n_boot, by)
    sums = [f"{c}_{x}" for c in columns for x in ("sum", "w")]
    large = summed(packed.where((F.col("_size") >= least) & (F.col("_n") < _M)).select(by, "_n", "_size", *columns), by, columns, n_boot, [*sums, "_w"], lambda own: _lcg_weights(own["_n"], int(own["_size"][0]), n_boot))
    large = large.groupBy(by, "draw").agg(*(F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_w")).alias(c) for c in columns))
    return small.unionByName(large)


def _lcg_weights(idx: np.ndarray, n: int, n_boot: int) -> Iterator[np.ndarray]:
    """How often each draw takes the units ``idx`` of ``n``, a row for each unit.

    A draw's numbers are a line over its places, modulo a prime. So _M places in a
    row have every number once, and what is left of n has a number if the place
    that the line gives it is there. A unit below _M has the numbers idx, idx + n
    and so on, so a draw is _M steps at most, whatever the number of units.
    """
    every = np.arange(n_boot, dtype=np.int64)
    rounds, rest = divmod(n, _M)
    # slopes that are multiples of the prime do not occur below _M - _B draws
    back = np.array([pow(int(_B + d), -1, _M) for d in every], np.int64)
    shift = (_M - (every * _A + _C) % _M) * back % _M
    for at in range(0, len(idx), 16):
        weight = np.zeros((len(idx[at : at + 16]), n_boot), np.int64)
        for number in range(0, _M, n):
            number = idx[at : at + 16, None].astype(np.int64) + number
            weight += (number < _M) * (rounds + ((number * back + shift) % _M < rest))
        yield weight


def _lcg_by_places(packed: DataFrame, columns: list[str], n_boot: int, by: str) -> DataFrame:
    """The means of ``lcg_means`` by a join of every place with its unit, for groups of few units."""
    packed = packed.withColumnRenamed("_n", "idx")
    size = packed.groupBy(by).agg(F.count("*").alias("n"))
    # blocks of places, so that no row holds a whole study, and their tasks as many as there are
    blocks = size.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK))))
    blocks = blocks.repartition(by, "draw", "block")
    first = F.col("block") * BLOCK
    places = blocks.withColumn("pos", F.explode(F.sequence(first, F.least(first + BLOCK, F.col("n")) - 1)))
    # a unit is taken by one or two places of a draw, so counting them first would only shuffle as many rows
    taken = places.select(by, "draw", lcg_index(F.col("draw").cast("long"), F.col("pos").cast("long"), F.col("n")).alias("idx"))
    # what explode makes looks small to the planner, which must not broadcast it
    return taken.join(packed.select(by, "idx", *columns).hint("shuffle_hash"), [by, "idx"]).groupBy(by, "draw").agg(*(F.avg(c).alias(c) for c in columns))


def interval(draws: DataFrame, value: str, by: tuple[str, ...] = ("pair",)) -> DataFrame:
    """2.5 and 97.5 percentiles with linear interpolation."""
    return draws.groupBy(*by).agg(F.percentile(value, F.lit(0.025)).alias("lo"), F.percentile(value, F.lit(0.975)).alias("hi"))


def rate(n: Column) -> Column:
    """The Poisson rate for ``n`` units, as a multiple of 1 / RATES."""
    return F.greatest(F.lit(0), RATES - F.ceil(F.sqrt(F.lit(float(MARGIN)) / n))).cast("int")


#: weights are looked up by so many bits of a number's share of the modulus; units and draws of a tile are what fits the cache
_BITS, _TILE = 15, (256, 250)


@functools.cache
def _by_share(rate: int) -> np.ndarray:
    """Weights of the numbers about every multiple of 2**-_BITS of MODULUS; 255 where the weight changes within half a step, or 2**-19 beyond it."""
    at = np.arange(1 << _BITS) / (1 << _BITS)
    wide = 0.5 / (1 << _BITS) + 2.0**-19
    first, last = (np.searchsorted(POISSON[rate], (at + x) * MODULUS, "right") for x in (-wide, wide))
    found = np.where(first == last, first, 255).astype(np.uint8)
    found[0] = 255  # both ends
    return found


def _polynomial(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A unit's numbers are a polynomial of the draw, modulo MODULUS: its coefficients from the fourth power down, a row for each unit."""
    m, (f0, f1, f2) = MODULUS, FACTORS
    u, v = u.astype(np.int64), v.astype(np.int64)
    a = (u * f0 + _C) % m  # x is a + f1 * draw, and y of the second degree
    square, line, rest = f1 * f1 % m, (2 * a % m * f1 + f2) % m, (a * a + v) % m
    twice = 2 * square % m
    return np.stack([np.full(len(u), square * square % m), twice * line % m, (line * line + twice * rest) % m, (2 * line % m * rest + f1) % m, (rest * rest + a) % m], 1)


def _tiles(u: np.ndarray, v: np.ndarray, rate: int, every: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Poisson weights in tiles: the first draw of a tile and its weights, a row for each unit and a column for each draw.

    All tiles of some units come before those of the next, and each takes the
    place of the one before. A product of matrices has the share of the modulus
    that each number is, and whole moduli besides. Coefficients are at most 2**30
    and powers of the draw half a modulus, so it is off by less than 2**-19; the
    few numbers for which that or the table's step matters are computed exactly.
    """
    m, steps, table = MODULUS, POISSON[rate], _by_share(rate)
    whole = 1.5 * 2.0 ** (52 - _BITS)  # added to a share, it leaves the share's first bits as the last ones
    about = lambda x: np.where(x > m // 2, x - m, x).astype(float)
    every = every.astype(np.int64) % m
    powers = [np.ones_like(every), every]
    for _ in range(3):
        powers.append(powers[-1] * every % m)
    exact = _polynomial(u, v)
    units = np.stack([*(about(exact[:, k]) for k in (1, 2, 3)), about(exact[:, 4]) / m, np.ones(len(exact))], 1)
    fourth = powers[4] * (FACTORS[1] ** 4 % m) % m  # the same for all units
    draws = np.stack([*(about(powers[k]) / m for k in (3, 2, 1)), np.ones(len(every)), about(fourth) / m])
    draws = [(k, np.ascontiguousarray(draws[:, k : k + _TILE[1]])) for k in range(0, len(every), _TILE[1])]
    places = _TILE[0] * _TILE[1]
    room = np.empty(places), np.empty(places, np.uint8), np.empty(places)
    for at in range(0, len(units), _TILE[0]):
        own, powers = units[at : at + _TILE[0]], exact[at : at + _TILE[0]].tolist()
        for first, some in draws:
            share, small, weight = (x[: len(own) * some.shape[1]].reshape(len(own), -1) for x in room)
            np.matmul(own, some, out=share)
            share += whole
            index = share.view(np.int64)
            index &= (1 << _BITS) - 1
            table.take(index, out=small, mode="clip")
            found, k = small.tobytes(), -1
            while (k := found.find(255, k + 1)) >= 0:
                unit, draw = divmod(k, some.shape[1])
                z, d = 0, int(every[first + draw])
                for power in powers[unit]:
                    z = (z * d + power) % m
                small[unit, draw] = bisect.bisect_right(steps, z)
            weight[:] = small
            yield first, weight


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 28 bits each of a unit's two numbers, from the first seven bytes of its digest."""
    both = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 7).astype(np.int64) @ (1 << np.arange(48, -1, -8))
    return both >> 28, both & ((1 << 28) - 1)


def _weights(u: np.ndarray, v: np.ndarray, rate: int, every: np.ndarray) -> Iterator[np.ndarray]:
    """The weights of ``_tiles`` with all draws of a unit in a row."""
    row = []
    for first, weight in _tiles(u, v, rate, every):
        row.append(weight.copy())
        if first + weight.shape[1] == len(every):
            yield np.concatenate(row, 1)
            row = []


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def summed(rows: DataFrame, by: str, columns: list[str], n_draws: int, names: list[str], weights: Callable[[dict], Iterator], dealt: bool = False) -> DataFrame:
    """(by, draw, ``names``): for every group of a task and draw the weighted sum and weight of each column, nulls skipped, and the whole weight.

    ``weights`` is given a group's other columns as arrays and yields weights, a
    row for each unit in order and a column for each draw, or tiles of them as
    ``_tiles`` does. Rows are dealt to tasks unless they are ``dealt`` already.
    """
    kind = rows.schema[by].dataType.simpleString()
    others = [c for c in rows.columns if c != by and c not in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            coded = batch.column(by).dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1)
            there = ~np.isnan(values)
            wide = np.ones((len(values), 2 * len(columns) + 1))
            wide[:, 0:-1:2], wide[:, 1:-1:2] = np.where(there, values, 0), there
            own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in others}
            for units in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else ():
                group, at = coded.dictionary[int(codes[units[0]])].as_py(), 0
                acc = total.setdefault(group, np.zeros((2 * len(columns) + 1, n_draws)))
                mine = np.ascontiguousarray(wide[units].T)
                for tile in weights({c: x[units] for c, x in own.items()}):
                    first, weight = tile if isinstance(tile, tuple) else (0, tile)
                    # Spark gives a worker's libraries as many threads as its task has cores
                    acc[:, first : first + weight.shape[1]] += mine[:, at : at + len(weight)] @ weight.astype(float, copy=False)
                    at += len(weight) if first + weight.shape[1] == n_draws else 0
        for group, acc in total.items():
            first = [pa.array([group] * n_draws, schema.field(0).type), pa.array(np.arange(n_draws, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*first, *(pa.array(x) for x in acc)], names=[by, "draw", *names])

    schema = to_arrow_schema(rows.select(by).schema)
    # few bytes are much work here: a number that is given is not lowered to what the bytes need
    rows = rows if dealt else rows.repartitionByRange(tasks(rows), by, *others)
    return rows.mapInArrow(run, f"`{by}` {kind}, draw int, " + ", ".join(f"`{c}` double" for c in names))


#: ranks of a block of units, and places that a task fills at once
RANKS, PLACES = 1 << 16, 1 << 20


def _packed(low: np.ndarray) -> bytes:
    """Ascending ranks within a block: their steps, the low bytes before the high ones, most of which are 0."""
    steps = np.diff(low.astype(np.uint16), prepend=np.uint16(0))
    return (steps & 255).astype(np.uint8).tobytes() + (steps >> 8).astype(np.uint8).tobytes()


def _ranks(packed: bytes) -> np.ndarray:
    half = np.frombuffer(packed, np.uint8).reshape(2, -1).astype(np.int64)
    return np.cumsum(half[0] + (half[1] << 8))


def _split(x: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of the runs of equal values."""
    edges = [0, *(np.flatnonzero(np.diff(x)) + 1), len(x)] if len(x) else []
    return list(zip(edges, edges[1:]))


def filled(left: DataFrame, by: str, seed: int) -> DataFrame:
    """(by, _block, draw, _ranks): the units that fill the ``_left`` places of each draw, by blocks of RANKS units.

    ``left`` has by, draw, n and _left. One place in 64 and more is left, 31 for
    each unit over 2,000 draws, so rows of single places would be most of the
    query's work and disk.
    """
    schema = to_arrow_schema(left.select(by).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.uint64(MODULUS)
        for batch in batches:
            for group, draw, n, begin, end in zip(*(batch.column(c).to_pylist() for c in (by, "draw", "n", "_begin", "_end"))):
                rank = np.empty(end - begin, np.uint32 if n <= 1 << 32 else np.uint64)
                for at in range(begin, end, 1 << 14):  # what fits the cache
                    place = np.arange(at, min(at + (1 << 14), end), dtype=np.uint64)
                    x = (place * np.uint64(FACTORS[0]) + np.uint64(draw * FACTORS[1] + _C + seed)) % m
                    y = (x * x + place + np.uint64(draw * FACTORS[2])) % m
                    rank[at - begin : at - begin + len(place)] = (y * y + x) % m * np.uint64(n) // m
                rank.sort()
                block = rank // RANKS
                runs = _split(block)
                columns = [[group] * len(runs), [int(block[i]) for i, _ in runs], [draw] * len(runs), [_packed(rank[i:k] % RANKS) for i, k in runs]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (schema.field(0).type, pa.int64(), pa.int32(), pa.binary()))], names=[by, "_block", "draw", "_ranks"])

    parts = left.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_left") - 1) / PLACES))))
    begin = F.col("_part") * PLACES
    # few bytes are much work here too
    parts = parts.select(by, "draw", "n", begin.alias("_begin"), F.least(begin + PLACES, F.col("_left")).alias("_end")).repartition(tasks(left), by, "draw", "_begin")
    return parts.mapInArrow(run, f"`{by}` {left.schema[by].dataType.simpleString()}, _block long, draw int, _ranks binary")


def blocks(packed: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, _block, _ranks, _values): units (by, _n, ``columns``) by blocks of RANKS units, in rows of as many as a batch has."""
    schema = to_arrow_schema(packed.select(by).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(by).dictionary_encode(null_encoding="encode")
            codes, n = coded.indices.to_numpy(zero_copy_only=False), batch.column("_n").to_numpy(zero_copy_only=False)
            order = np.lexsort((n, codes))
            codes, n = codes[order], n[order]
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])[:, order]
            runs = [(i + a, i + b) for i, k in _split(codes) for a, b in _split(n[i:k] // RANKS)]
            found = [[coded.dictionary[int(codes[i])].as_py() for i, _ in runs], [int(n[i]) // RANKS for i, _ in runs], [_packed(n[i:k] % RANKS) for i, k in runs], [values[:, i:k].tobytes() for i, k in runs]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (schema.field(0).type, pa.int64(), pa.binary(), pa.binary()))], names=[by, "_block", "_ranks", "_values"])

    rows = packed.select(by, "_n", *columns)
    return rows.mapInArrow(run, f"`{by}` {rows.schema[by].dataType.simpleString()}, _block long, _ranks binary, _values binary")


def met(found: DataFrame, units: DataFrame, by: str, columns: list[str], names: list[str]) -> DataFrame:
    """(by, draw, ``names``): sum and number of the values of each column over the places of ``filled``, some of a draw's in a row."""
    schema = to_arrow_schema(units.select(by).schema)
    k = len(columns)

    def run(key: tuple, places: pa.Table, own: pa.Table) -> pa.Table:
        wide = np.zeros((RANKS, 2 * k))
        for ranks, values in zip(own["_ranks"].to_pylist(), own["_values"].to_pylist()):
            values = np.frombuffer(values).reshape(k, -1).T
            there = ~np.isnan(values)
            at = _ranks(ranks)
            wide[at, 0::2], wide[at, 1::2] = np.where(there, values, 0), there
        sums = np.array([wide.take(_ranks(x), 0).sum(0) for x in places["_ranks"].to_pylist()]).reshape(-1, 2 * k)
        group = pa.array([key[0].as_py()] * len(places), schema.field(0).type)
        return pa.table([group, places["draw"], *(pa.array(x) for x in sums.T)], names=[by, "draw", *names])

    kind = units.schema[by].dataType.simpleString()
    return found.groupBy(by, "_block").cogroup(units.groupBy(by, "_block")).applyInArrow(run, f"`{by}` {kind}, draw int, " + ", ".join(f"`{c}` double" for c in names))


def draws(units: DataFrame, columns: list[str], n_boot: int = N_BOOT, seed: int = SEED, by: str = "pair", order: str = "key") -> DataFrame:
    """(by, draw, n, and for every column c: c_sum, c_w): sums over the n units of a draw, and how many of them have a value."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), by, order).cast("binary"))
    rows = units.select(by, order, *(F.col(c).cast("double").alias(c) for c in columns))
    packed = numbered(rows, [by], [order], n_tasks=tasks(units), keep=[by, F.unhex(F.substring(digest, 1, 14)).alias("_digest"), *columns])
    sums = [f"{c}_{x}" for c in columns for x in ("sum", "w")]
    every = np.arange(n_boot, dtype=np.uint64)
    rated = packed.select(by, "_digest", rate(F.col("_size")).alias("_rate"), *columns)
    parts = summed(rated, by, columns, n_boot, [*sums, "_w"], lambda own: _tiles(*_halves(own["_digest"]), int(own["_rate"][0]), every), dealt=True)
    size = packed.groupBy(by).agg(F.count("*").alias("n")).withColumnRenamed(by, "_by")
    first = parts.groupBy(by, "draw").agg(*(F.sum(c).alias(c) for c in [*sums, "_w"])).join(size, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    fits = F.col("_w") <= F.col("n")
    first = kept(first.withColumns({c: F.when(fits, F.col(c)).otherwise(0.0) for c in [*sums, "_w"]}))
    left = first.withColumn("_left", F.col("n") - F.col("_w").cast("long")).where("_left > 0").select(by, "draw", "n", "_left")
    second = met(filled(left, by, seed), blocks(packed, by, columns), by, columns, sums)
    second = second.groupBy(F.col(by).alias("_by"), F.col("draw").alias("_draw")).agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    both = first.join(second, F.col(by).eqNullSafe(F.col("_by")) & (F.col("draw") == F.col("_draw")), "left")
    return both.select(by, "draw", "n", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums))


def bootstrap(units: DataFrame, columns: list[str], n_boot: int = N_BOOT, seed: int = SEED, by: str = "pair", order: str = "key") -> DataFrame:
    """(by, draw, mean of every column), nulls skipped, over draws of as many units as the group has."""
    found = draws(units, columns, n_boot, seed, by, order)
    return found.select(by, "draw", *(F.try_divide(f"{c}_sum", f"{c}_w").alias(c) for c in columns))


def category_interval(units: DataFrame, n_boot: int = N_BOOT, seed: int = SEED) -> DataFrame:
    """(pair, lo, hi) of the category-average kappa."""
    draws = bootstrap(units, ["dx", "px"], n_boot, seed).withColumn("kappa", (F.col("dx") + F.col("px")) / 2)
    return interval(draws, "kappa")


def mean_intervals(units: DataFrame, columns: list[str], by: tuple[str, ...] = ("pair",), n_boot: int = N_BOOT, seed: int = SEED, order: str = "key") -> DataFrame:
    """(by, c_lo and c_hi of every column): intervals of the columns' means, nulls skipped."""
    group = F.to_json(F.struct(*by))
    draws = bootstrap(units.withColumn("_group", group), columns, n_boot, seed, "_group", order)
    ends = [F.percentile(c, F.lit(p)).alias(f"{c}_{x}") for c in columns for x, p in (("lo", 0.025), ("hi", 0.975))]
    names = units.select(*by).distinct().withColumn("_group", group)
    return names.join(draws.groupBy("_group").agg(*ends), "_group").drop("_group")


def paired_test(units: DataFrame, n_boot: int = N_BOOT, seed: int = SEED) -> DataFrame:
    """Model against coder on the same episodes: differences of match rate and kappa with intervals and the two-sided p.

    ``units`` has pair, key, m, c (matches) and dx_m, px_m, dx_c, px_c (kappas).
    p is twice the smaller tail, not capped, as it is adjusted afterwards.
    """
    d = bootstrap(units, ["m", "c", "dx_m", "px_m", "dx_c", "px_c"], n_boot, seed)
    d = d.select("pair", (F.col("m") - F.col("c")).alias("dp"), F.round(((F.col("dx_m") - F.col("dx_c")) + (F.col("px_m") - F.col("px_c"))) / 2, 9).alias("dk"))
    tail = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    q = lambda c, p, name: F.percentile(c, F.lit(p)).alias(name)
    return d.groupBy("pair").agg(
        q("dp", 0.025, "delta_p_lo"), q("dp", 0.975, "delta_p_hi"), q("dk", 0.025, "delta_kappa_lo"), q("dk", 0.975, "delta_kappa_hi"), (2 * F.least(tail(F.col("dk") <= 0), tail(F.col("dk") >= 0))).alias("delta_kappa_p")
    )


def one_sided_test(ceiling: DataFrame, others: DataFrame, n_boot: int = N_BOOT, seed: int = SEED) -> DataFrame:
    """Does the ceiling exceed each comparator? Independent draws of both; p is the share of differences at or below 0."""
    a = bootstrap(ceiling, ["dx", "px"], n_boot, seed).select("draw", ((F.col("dx") + F.col("px")) / 2).alias("top"))
    b = bootstrap(others, ["dx", "px"], n_boot, seed + 1).select("pair", "draw", ((F.col("dx") + F.col("px")) / 2).alias("own"))
    rows = b.join(a, "draw").withColumn("d", F.round(F.col("top") - F.col("own"), 9))
    return rows.groupBy("pair").agg(F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi"), F.avg(F.when(F.col("d") <= 0, 1.0).otherwise(0.0)).alias("p_one_sided"))


def _tail(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else math.erfc(math.sqrt(v / 2)))


def chi2_tail(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return F.pandas_udf(_tail, T.DoubleType())(x)
