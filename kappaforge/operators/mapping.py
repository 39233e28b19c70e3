"""Terminology concepts to classification codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kappaforge.functions.codes import dotted, no_code

#: rules that hold for every patient, besides those that begin with OTHERWISE (fixed values)
UNCONDITIONAL = ("", "TRUE", "ALWAYS")
ADDITIONAL = "ADDITIONAL CODE MANDATORY"


def _order() -> Column:
    """Unconditional rules first, then codes that stand alone, then priority, then file order."""
    rule = F.upper(F.coalesce("map_rule", F.lit("")))
    conditional = ~(rule.isin(*UNCONDITIONAL) | rule.startswith("OTHERWISE"))
    additional = F.contains(F.upper(F.coalesce("advice", F.lit(""))), F.lit(ADDITIONAL))
    return F.struct(conditional.alias("c"), additional.alias("a"), F.col("priority"), F.col("ord"))


def targets(map_rows: DataFrame) -> DataFrame:
    """(refset, sctid, code, candidates): the primary target and all group 1 targets of every concept.

    A concept without a group 1 target has a null code and empty candidates.
    One aggregate: the fallbacks of the rule choice are sort keys.
    """
    usable = (F.col("map_group") == 1) & (F.coalesce("target", F.lit("")) != "")
    return map_rows.groupBy("refset", "sctid").agg(
        dotted(F.min_by(F.when(usable, F.col("target")), F.when(usable, _order()))).alias("code"),
        F.array_join(F.array_sort(F.collect_set(F.when(usable, dotted(F.col("target"))))), ";").alias("candidates"),
    )


def classified(labels: DataFrame, chosen: DataFrame) -> DataFrame:
    """Labels with icd10, opcs4 and classification_candidates (null unless the concept is in the map)."""
    q = F.lower(F.trim("qualifier"))
    kind = F.when(q == "diagnoses", "diagnosis").when(q == "procedures", "procedure")
    keyed = labels.withColumn("_refset", F.when(~no_code(F.col("snomed_ct")), kind)).withColumn("_sctid", F.col("snomed_ct").cast("string"))
    found = chosen.select(F.col("refset").alias("_refset"), F.col("sctid").cast("string").alias("_sctid"), "code", "candidates")
    out = keyed.join(found, ["_refset", "_sctid"], "left")
    return out.select(*labels.columns, F.when(F.col("_refset") == "diagnosis", F.col("code")).alias("icd10"), F.when(F.col("_refset") == "procedure", F.col("code")).alias("opcs4"), F.col("candidates").alias("classification_candidates"))


def concept_counts(map_rows: DataFrame) -> DataFrame:
    return map_rows.groupBy("refset").agg(F.countDistinct("sctid").alias("concepts"))
