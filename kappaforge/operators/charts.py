"""Data of the study's charts: one row per mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALPHA = 0.05


def differences(h1: DataFrame) -> DataFrame:
    """Forest rows of the difference model minus coder; filled where the adjusted p is below 0.05."""
    return h1.select(F.col("model").alias("label"), F.col("delta_kappa").alias("estimate"), F.col("delta_kappa_lo").alias("lo"), F.col("delta_kappa_hi").alias("hi"), (F.col("delta_kappa_p_fdr") < ALPHA).alias("filled"))


def against_ceiling(agreement: DataFrame, h2: DataFrame) -> DataFrame:
    """Forest rows of each comparator's agreement (label, kappa, lo, hi), filled where below the ceiling by ``h2`` (comparator, p_fdr)."""
    return agreement.join(h2, agreement["label"] == h2["comparator"]).select("label", F.col("kappa").alias("estimate"), "lo", "hi", (F.col("p_fdr") < ALPHA).alias("filled"))


def performance(evaluated: DataFrame) -> DataFrame:
    """(model, tier, metric, score) of both tiers."""
    marks = [F.struct(F.lit(t).alias("tier"), F.lit(m).alias("metric"), F.col(f"{t}_{m}").alias("score")) for t in ("validity", "alignment") for m in ("precision", "recall", "f1")]
    return evaluated.select("model", F.explode(F.array(*marks)).alias("s")).select("model", "s.*")
