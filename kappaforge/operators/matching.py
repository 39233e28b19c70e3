"""Matching of episodes to coder admissions, model selections and other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kappaforge.functions.dates import candidates


def match_coder(episodes: DataFrame, coder: DataFrame) -> DataFrame:
    """(ep_key, seq, how): the coder episode of each clinical episode.

    ``episodes`` has ep_key, nid and adm; ``coder`` has nid, seq (file order) and
    adm. The first in file order with the admission date or its day/month swap
    wins; without one, a patient's only coder episode does. Others drop out.
    Dates are exploded, so the match is an equi-join and no OR.
    """
    dates = episodes.select("ep_key", "nid", F.explode(candidates(F.col("adm"))).alias("adm"))
    exact = dates.join(coder, ["nid", "adm"]).groupBy("ep_key").agg(F.min("seq").alias("seq"))
    only = coder.groupBy("nid").agg(F.count("*").alias("n"), F.min("seq").alias("only_seq")).where("n = 1").drop("n")
    out = episodes.select("ep_key", "nid").join(exact, "ep_key", "left").join(only, "nid", "left")
    how = F.when(F.col("seq").isNotNull(), "date").when(F.col("only_seq").isNotNull(), "single")
    return out.select("ep_key", F.coalesce("seq", "only_seq").alias("seq"), how.alias("how")).where("seq is not null")


def shared(left: DataFrame, right: DataFrame, on: str = "key") -> DataFrame:
    """Keys of both tables (of annotated episodes), each once."""
    return left.select(on).distinct().join(right.select(on), on, "left_semi")


def in_all(annotated: DataFrame, raters: list[str], key: str = "key") -> DataFrame:
    """Keys that every rater has annotated."""
    return annotated.where(F.col("rater").isin(raters)).groupBy(key).agg(F.countDistinct("rater").alias("n")).where(F.col("n") == len(raters)).select(key)


def last_per_key(table: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key, as where a later file overwrites an earlier one."""
    rest = [c for c in table.columns if c != key]
    return table.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def resolve_selection(stage1: DataFrame, picks: DataFrame) -> DataFrame:
    """The stage 1 row of every pick, with its new primary_secondary.

    ``stage1`` has episode_id, idx, qualifier, text, icd10, opcs4 and more;
    ``picks`` has episode_id, category ('diagnoses' or 'procedures'), rank (0
    for the principal, then the secondaries) and ref. A ref is an id of the
    category, else a code, else part of a text; the first row wins. Only the
    first two secondaries count, before they are resolved; a row is taken once.
    Null refs and null categories pick nothing.
    """
    picks = picks.where("rank <= 2 and ref is not null").select("episode_id", "category", "rank", F.trim("ref").alias("ref"))
    rows = stage1.withColumn("category", F.lower(F.trim("qualifier"))).withColumn("code", F.when(F.col("category") == "diagnoses", F.col("icd10")).otherwise(F.col("opcs4")))
    plain = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    number = F.col("ref").try_cast("double")
    whole = F.when(~F.isnan(number) & (F.abs(number) < 1e9), number.cast("int"))  # towards zero, as 2.7 means row 2
    by = (
        F.when(F.col("idx") == whole, 1)
        .when((plain(F.col("ref")) != "") & (plain(F.coalesce("code", F.lit("None"))) == plain(F.col("ref"))), 2)
        .when((F.col("ref") != "") & F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower("ref")), 3)
    )
    joined = picks.join(rows, ["episode_id", "category"]).withColumn("by", by).where("by is not null")
    best = joined.withColumn("n", F.row_number().over(W.partitionBy("episode_id", "category", "rank").orderBy("by", "idx"))).where("n = 1")
    once = best.withColumn("n", F.row_number().over(W.partitionBy("episode_id", "category", "idx").orderBy("rank"))).where("n = 1")
    return once.withColumn("primary_secondary", F.when(F.col("rank") == 0, "primary").otherwise("secondary")).drop("n", "by", "code", "ref")


def linked(rows: DataFrame, links: DataFrame, on: str = "nid") -> DataFrame:
    """``rows`` with the columns of their link; rows without one stay, with nulls."""
    return rows.join(links, on, "left")


def without(rows: DataFrame, excluded: DataFrame, on: str) -> DataFrame:
    """``rows`` whose key is not among the excluded ones; rows without a key stay."""
    return rows.join(excluded.select(on), on, "left_anti")


def merged_labels(labels: DataFrame, by: list[str], text: str = "text", order: str = "ord") -> DataFrame:
    """One row for each text of a group, as merging parts does: the last row's values, at the place of the first."""
    rest = [c for c in labels.columns if c not in (*by, text, order)]
    one = labels.groupBy(*by, text).agg(F.max_by(F.struct(*rest), order).alias("last"), F.min(order).alias(order))
    return one.select(*by, text, order, "last.*")
