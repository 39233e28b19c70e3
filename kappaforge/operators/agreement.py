"""Agreement between raters.

``comparisons`` brings both raters' annotations of an episode together in one
shuffle, for any number of rater pairs at once; every measure is then a column
expression over the two arrays of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kappaforge.functions.codes import at_level
from kappaforge.operators.ranked import least_from_here, numbered

CODE_TYPES = ("dx", "px", "combined")


def rater_pairs(raters: DataFrame) -> DataFrame:
    """(pair, rater_a, rater_b) of every two of ``raters`` (ord, rater; a row for each rater of a study), the earlier one first."""
    listed = raters.groupBy().agg(F.transform(F.array_sort(F.collect_set(F.struct("ord", "rater"))), lambda x: x["rater"]).alias("r"))
    first = listed.select("r", F.posexplode("r").alias("at", "rater_a"))
    both = first.select("rater_a", F.explode(F.slice("r", F.col("at") + 2, F.size("r"))).alias("rater_b"))
    return both.select(F.concat_ws(" vs ", "rater_a", "rater_b").alias("pair"), "rater_a", "rater_b")


def comparisons(annotations: DataFrame, pairs: DataFrame, level: str = "category", both: bool = True) -> DataFrame:
    """(pair, key, a, b): the annotations of each pair's raters, sorted (kind, pos, code).

    ``pairs`` (pair, rater_a, rater_b) is a table of rater pairs, of the size of
    the number of raters squared at most, and broadcast. An episode's annotations
    are gathered once, whatever the number of pairs, and go to the pairs within its
    row. With ``both`` only episodes annotated by both remain.
    """
    asked = pairs.select(F.explode(F.array("rater_a", "rater_b")).alias("rater")).distinct()
    item = F.struct("rater", "kind", "pos", at_level(F.col("code"), level).alias("code"))
    rows = annotations.where("code is not null").join(F.broadcast(asked), "rater", "left_semi").groupBy("key").agg(F.array_sort(F.collect_set(item)).alias("x"))
    rows = rows.withColumn("raters", F.transform("x", lambda x: x["rater"]))
    there = [F.array_contains("raters", F.col(r)) for r in ("rater_a", "rater_b")]
    out = rows.join(F.broadcast(pairs), there[0] & there[1] if both else there[0] | there[1])
    of = lambda r: F.transform(F.filter("x", lambda x: x["rater"] == F.col(r)), lambda x: F.struct(x["kind"].alias("kind"), x["pos"].alias("pos"), x["code"].alias("code")))
    return out.select("pair", "key", of("rater_a").alias("a"), of("rater_b").alias("b"))


def codes_of(side: Column, kind: str) -> Column:
    """Distinct codes of one kind, or of both for 'combined'."""
    rows = side if kind == "combined" else F.filter(side, lambda x: x["kind"] == kind)
    return F.array_distinct(F.transform(rows, lambda x: x["code"]))


def overlap(a: Column, b: Column, kind: str = "combined") -> tuple[Column, Column]:
    """(Jaccard, any match) of the code sets; null where one of them is empty."""
    x, y = codes_of(a, kind), codes_of(b, kind)
    there = (F.size(x) > 0) & (F.size(y) > 0)
    shared = F.size(F.array_intersect(x, y))
    return F.when(there, shared / F.size(F.array_union(x, y))), F.when(there, (shared > 0).cast("int"))


def kappa_units(compared: DataFrame, *more: Column) -> DataFrame:
    """(pair, key, dx, px): Cohen's kappa of two hit vectors per episode and kind; and ``more`` columns of ``compared``'s rows.

    A hit is an annotation with a code that the other rater has anywhere; the
    shorter vector is padded with zeros. Equal constant vectors give 1, also
    where nothing is shared; an episode without annotations of a kind, null.
    All of it is counted within an episode's row. Hits of both are where hits lie
    at the same place of both vectors.
    """
    sides = {(k, s): F.filter(s, lambda x: x["kind"] == F.lit(k)) for k in ("dx", "px") for s in ("a", "b")}  # noqa: B023
    compared = compared.select("*", *more)
    rest = compared.columns[len(compared.columns) - len(more) :]
    rows = compared.select("pair", "key", *rest, *(v.alias(f"{k}_{s}") for (k, s), v in sides.items()))
    codes = lambda c: F.transform(c, lambda x: x["code"])
    rows = rows.select("*", *(F.array_intersect(codes(f"{k}_a"), codes(f"{k}_b")).alias(f"{k}_shared") for k in ("dx", "px")))
    place = lambda c: F.array_distinct(F.transform(c, lambda x: x["pos"]))
    shared = lambda k, s: F.filter(f"{k}_{s}", lambda x: F.array_contains(f"{k}_shared", x["code"]))
    rows = rows.select("pair", "key", *rest, *(v.alias(f"{k}_{s}_{n}") for k, s in sides for n, v in (("places", place(f"{k}_{s}")), ("hits", place(shared(k, s))))))

    def kappa(kind: str) -> Column:
        places, hits = ([F.col(f"{kind}_{s}_{n}") for s in ("a", "b")] for n in ("places", "hits"))
        # a null place is the first one
        number = [F.transform(h, lambda x: F.coalesce(F.array_position(p, x), F.lit(1).cast("long"))) for h, p in zip(hits, places)]  # noqa: B023
        w, sx, sy = F.greatest(*map(F.size, places)).cast("long"), F.size(hits[0]), F.size(hits[1])
        d = sx + sy - 2 * F.size(F.array_intersect(*number))
        chance = sx * (w - sy) + (w - sx) * sy
        return F.when(w == 0, F.lit(None)).when(chance == 0, F.lit(1.0)).otherwise(1 - (w * d).cast("double") / chance)

    return rows.select("pair", "key", *(kappa(k).alias(k) for k in ("dx", "px")), *rest)


def category_average(units: DataFrame, by: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Mean of the two kinds' mean kappas, each over the episodes that have it."""
    return units.groupBy(*by).agg(F.count("*").alias("n"), ((F.avg("dx") + F.avg("px")) / 2).alias("kappa"))


def scores(na: Column, nb: Column, hit: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of ``hit`` shared codes: precision where side a has codes, recall where b has, F1 where both have."""
    p, r = F.try_divide(hit, na), F.try_divide(hit, nb)
    f1 = F.when(p.isNotNull() & r.isNotNull(), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
    return p.alias("precision"), r.alias("recall"), f1.alias("f1")


def combined_scores() -> tuple[Column, Column, Column]:
    """The scores of ``score_units`` for both kinds together, as columns of compared rows."""
    x, y = (codes_of(F.col(s), "combined") for s in ("a", "b"))
    return scores(F.size(x), F.size(y), F.size(F.array_intersect(x, y)))


def score_units(compared: DataFrame) -> DataFrame:
    """(pair, key, code_type, precision, recall, f1) per episode; an episode without codes of either side is no unit."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("code_type"), codes_of(F.col("a"), k).alias("x"), codes_of(F.col("b"), k).alias("y")) for k in CODE_TYPES))).alias("s")
    rows = compared.select("pair", "key", kinds).select("pair", "key", "s.code_type", F.size("s.x").alias("na"), F.size("s.y").alias("nb"), F.size(F.array_intersect("s.x", "s.y")).alias("hit"))
    return rows.where("na + nb > 0").select("pair", "key", "code_type", *scores(F.col("na"), F.col("nb"), F.col("hit")))


def set_scores(compared: DataFrame) -> DataFrame:
    """Macro precision, recall and F1 by pair and code type."""
    return mean_scores(score_units(compared))


def mean_scores(units: DataFrame) -> DataFrame:
    """Units of ``score_units`` averaged by pair and code type."""
    return units.groupBy("pair", "code_type").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.count("f1").alias("n"))


def contrast_units(annotations: DataFrame, raters: list[str], level: str = "category") -> DataFrame:
    """(rater, key, contrast) per target and episode of all three raters: mean Jaccard with the target less the other two's Jaccard."""
    x, y, z = raters
    of = lambda r: F.array_distinct(F.collect_list(F.when(F.col("rater") == r, at_level(F.col("code"), level))))
    triples = annotations.where("code is not null").where(F.col("rater").isin(raters)).groupBy("key").agg(*(of(r).alias(f"c{i}") for i, r in enumerate(raters)))
    triples = triples.where(" and ".join(f"size(c{i}) > 0" for i in range(3)))
    j = lambda i, k: F.size(F.array_intersect(f"c{i}", f"c{k}")) / F.size(F.array_union(f"c{i}", f"c{k}"))
    rows = triples.select("key", F.explode(F.array(*(F.struct(F.lit(r).alias("rater"), ((j(t, o1) + j(t, o2)) / 2 - j(o1, o2)).alias("contrast")) for r, t, o1, o2 in ((x, 0, 1, 2), (y, 1, 0, 2), (z, 2, 0, 1))))).alias("s"))
    return rows.select("s.rater", "key", "s.contrast")


def outlier_contrast(annotations: DataFrame, raters: list[str], level: str = "category") -> DataFrame:
    """The episodes' contrasts averaged by target."""
    return mean_contrasts(contrast_units(annotations, raters, level))


def mean_contrasts(units: DataFrame) -> DataFrame:
    """Units of ``contrast_units`` averaged by target."""
    return units.groupBy("rater").agg(F.count("*").alias("n_triples"), F.avg("contrast").alias("contrast"))


def cohen_kappa(ratings: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Cohen's kappa of two columns of classes; null for no rows, NaN where chance agreement is 1."""
    cells = ratings.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    sides = cells.select(*by, "n", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("c")), F.struct(F.lit(1).alias("side"), F.col("b").alias("c")))).alias("s"))
    margins = sides.groupBy(*by, F.col("s.c").alias("c")).agg(*(F.sum(F.when(F.col("s.side") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)))
    chance = margins.groupBy(*by).agg(F.sum(F.col("n0").cast("double") * F.col("n1")).alias("e"))
    seen = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    both = seen.join(chance, list(by)) if by else seen.crossJoin(chance)  # one row each without groups
    po, pe = F.col("same") / F.col("n"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    return both.select(*by, "n", F.when(pe == 1, F.lit(float("nan"))).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def mcnemar(rows: DataFrame, a: str, b: str, by: tuple[str, ...] = ("pair",)) -> DataFrame:
    """2x2 counts and the continuity-corrected statistic of paired successes."""
    count = lambda x, y: F.sum(F.when((F.col(a) == x) & (F.col(b) == y), 1).otherwise(0)).alias
    out = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), count(1, 1)("both_hit"), count(1, 0)("a_only"), count(0, 1)("b_only"), count(0, 0)("neither"))
    d = F.col("a_only") + F.col("b_only")
    return out.withColumn("chi2", F.when(d == 0, 0.0).otherwise(F.pow(F.abs(F.col("a_only") - F.col("b_only")) - 1, F.lit(2)) / d))


def benjamini_hochberg(tests: DataFrame, p: str = "p", family: tuple[str, ...] = (), out: str = "q") -> DataFrame:
    """Adjusted p-values per family, of any number of tests."""
    ranked = numbered(tests, list(family), [p])
    ranked = least_from_here(ranked, list(family), F.col(p) * F.col("_size") / (F.col("_n") + 1))
    return ranked.select(*tests.columns, F.least(F.lit(1.0), "_least").alias(out))
