"""Clinicians' verdicts: classification, metrics and discovery of the verdict column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: wordings of a miss (fixed values)
MISS = ("does not code", "relevant here", "would still be relevant", "no diagnosis", "diagnosis not", "not included", "no procedure", "procedure not")
VERDICTS = ("TP", "TN", "FP_soft", "FP_hard", "FN_miss", "FN_coding", "FN_other", "AMBIG")


def classify(label: Column) -> Column:
    """Category of a free-text verdict; null for blanks and for notes that are none."""
    t = F.lower(F.trim(label))
    has = lambda s: F.contains(t, F.lit(s))
    any_of = lambda words: F.coalesce(*[F.when(has(w), True) for w in words], F.lit(False))
    miss_or_code = F.when(has("correct") & (has("extract") | has("text")), "FN_coding").when(any_of(MISS), "FN_miss").when(has("incorrect code") | has("no code"), "FN_coding").otherwise("FN_other")
    fp = F.when(has("additional not relevant"), "FP_soft").otherwise("FP_hard")
    return (
        F.when(t.isNull() | (t == ""), None).when(t.startswith("tf"), "AMBIG").when(t.startswith("tn"), "TN").when(t.startswith("tp"), "TP")
        .when(has("fn"), miss_or_code).when(has("fp"), fp).when(~(has("tp") | has("tn")), None).otherwise(F.concat(F.lit("UNMAPPED:"), F.substring(label, 1, 40)))
    )


def counts(verdicts: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Rows per category of classified verdicts."""
    return verdicts.where("category is not null").groupBy(*by, "category").agg(F.count("*").alias("n"))


def evaluate(verdicts: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Counts and the two tiers of metrics; ratios without a denominator are null, and so is F1 where P or R is 0."""
    n = lambda *cats: F.sum(F.when(F.col("category").isin(*cats), 1).otherwise(0))
    base = verdicts.where("category is not null").groupBy(*by).agg(
        F.count("*").alias("n"), n("TP").alias("tp"), n("FP_soft").alias("fp_soft"), n("FP_hard").alias("fp_hard"), n("FN_coding").alias("fn_coding"), n("FN_miss", "FN_other").alias("fn_miss"), n("TN").alias("tn")
    )
    c = F.col
    fn, found = c("fn_coding") + c("fn_miss"), c("tp") + c("fn_coding")

    def tier(name: str, good: Column, bad: Column) -> list[Column]:
        p, r = F.try_divide(good, good + bad), F.try_divide(good, good + fn)
        return [p.alias(f"{name}_precision"), r.alias(f"{name}_recall"), F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).alias(f"{name}_f1")]

    return base.select(
        *base.columns, *tier("validity", c("tp") + c("fp_soft"), c("fp_hard")), *tier("alignment", c("tp"), c("fp_soft") + c("fp_hard")), F.try_divide(found, found + c("fn_miss")).alias("extraction_recall"),
        F.try_divide(c("tp"), found).alias("coding_accuracy"), F.try_divide(c("fp_hard"), c("tp") + c("fp_soft") + c("fp_hard")).alias("hallucination_rate"),
    )


def verdict_column(cells: DataFrame) -> DataFrame:
    """(sheet, col) with most recognisable verdicts below the header; the first sheet, then column, wins ties. Empty if there is none.

    ``cells`` has sheet, sheet_ord, row, col and value; sheets named as templates do not count.
    """
    known = cells.where((F.col("row") >= 2) & ~F.contains(F.lower("sheet"), F.lit("template"))).where(classify(F.col("value")).isin(*VERDICTS))
    hits = known.groupBy("sheet", "sheet_ord", "col").agg(F.count("*").alias("hits"))
    return hits.agg(F.min(F.struct((-F.col("hits")).alias("h"), "sheet_ord", "col", "sheet")).alias("b")).where("b is not null").select("b.sheet", "b.col")


def graded_rows(cells: DataFrame) -> DataFrame:
    """(row, category, qualifier, position) of the verdict column's sheet; a missing cell reads as "none", a missing column as ""."""
    best = F.broadcast(verdict_column(cells))  # one row
    sheet = cells.join(best.select("sheet"), "sheet")
    head = sheet.where("row = 1 and value is not null").withColumn("name", F.lower(F.trim("value")))
    place = head.agg(F.min(F.when(F.contains("name", F.lit("qualifier")), F.col("col"))).alias("q"), F.min(F.when(F.contains("name", F.lit("primary")), F.col("col"))).alias("p"))
    rows = sheet.where("row >= 2").join(F.broadcast(best.select(F.col("col").alias("v"))), F.lit(True)).join(F.broadcast(place), F.lit(True))
    at = lambda c: F.max(F.when(F.col("col") == F.col(c), F.col("value")))
    text = lambda c: F.when(F.col(c + "_col").isNull(), "").otherwise(F.lower(F.trim(F.coalesce(c, F.lit("None")))))
    wide = rows.groupBy("row").agg(at("v").alias("verdict"), at("q").alias("q"), at("p").alias("p"), F.max("q").alias("q_col"), F.max("p").alias("p_col"))
    return wide.select("row", classify(F.col("verdict")).alias("category"), text("q").alias("qualifier"), text("p").alias("position")).where("category is not null")
