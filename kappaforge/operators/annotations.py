"""Annotations: from wide cells to the long table, code sets and episodes.

The long table has one row per code: rater, key, kind ('dx' or 'px'), pos (the
order of annotations) and code. One annotation may hold several codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaforge.functions.codes import at_level, normalise_code, normalise_diagnosis_code, split_codes


def from_cells(table: DataFrame, dx: list[str], px: list[str], keep: list[str], order: str = "ord") -> DataFrame:
    """Long table of the codes in ``dx`` and ``px`` columns; each non-empty cell is one annotation."""
    cells = [F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("column"), F.col(f"`{c}`").cast("string").alias("cell")) for kind, cs in (("dx", dx), ("px", px)) for n, c in enumerate(cs)]
    wide = table.select(*keep, order, F.explode(F.array(*cells)).alias("c")).select(*keep, order, "c.*")
    codes = wide.select(*keep, "kind", (F.col(order) * 1000 + F.col("column")).alias("pos"), F.explode(split_codes(F.col("cell"))).alias("raw"))
    code = F.when(F.col("kind") == "dx", normalise_diagnosis_code(F.col("raw"))).otherwise(normalise_code(F.col("raw")))
    return codes.select(*keep, "kind", "pos", code.alias("code")).where("code is not null").distinct()


def code_table(annotations: DataFrame, level: str = "category", by: tuple[str, ...] = ("rater", "key")) -> DataFrame:
    """Distinct codes per ``by``, kind and level, with the kind 'combined' for both."""
    one = annotations.select(*by, F.explode(F.array(F.col("kind"), F.lit("combined"))).alias("kind"), at_level(F.col("code"), level).alias("code"))
    return one.distinct()


def episodes(annotations: DataFrame, by: tuple[str, ...] = ("rater", "key")) -> DataFrame:
    """One row per episode: codes per kind, annotations in order and, of tables with adm or nid, the first date and the first row's identifier.

    ``pos`` orders the rows of an episode; rows without a date are passed over for the date.
    """
    firsts = {c: F.min(c).alias(c) for c in ("adm", "nid") if c in annotations.columns}
    # lying by episode, rows are shuffled once for both groupings
    rows = annotations.repartition(*by).groupBy(*by, "kind", "pos").agg(F.array_sort(F.collect_set("code")).alias("codes"), *firsts.values())
    kinds = {k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "codes")))) for k in ("dx", "px")}
    first = {"adm": F.min_by("adm", F.when(F.col("adm").isNotNull(), F.col("pos"))).alias("adm"), "nid": F.min_by("nid", "pos").alias("nid")}
    out = rows.groupBy(*by).agg(*(v.alias(f"_{k}") for k, v in kinds.items()), *(first[c] for c in firsts))
    for k in kinds:
        out = out.withColumn(f"{k}_rows", F.transform(f"_{k}", lambda x: x["codes"])).withColumn(k, F.array_distinct(F.flatten(F.transform(f"_{k}", lambda x: x["codes"])))).drop(f"_{k}")
    return out


def annotated(annotations: DataFrame, by: tuple[str, ...] = ("rater", "key")) -> DataFrame:
    """Episodes with a code at all."""
    return annotations.where("code is not null").select(*by).distinct()


def ordered_codes(table: DataFrame, by: list[str], order: list[str], code: str = "code") -> DataFrame:
    """Distinct codes per group in the order of first appearance."""
    rows = F.array_sort(F.collect_list(F.struct(*order, code)))
    return table.where(F.col(code).isNotNull()).groupBy(*by).agg(F.array_distinct(F.transform(rows, lambda x: x[code])).alias("codes"))
