"""Row numbers and running minima of groups of any size.

A window over a whole group puts it into one task. Here rows are dealt by ranges
of group and order, so a large group spans many tasks; what a task must know of
the others is one row for each group and task, and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kappaforge.sources.scratch import kept


def numbered(rows: DataFrame, by: list[str], order: list[str], n_tasks: int | None = None, keep: list[str | Column] | None = None) -> DataFrame:
    """``rows`` with _task, _n (number in the group, from 0, in this order) and _size of the group.

    Equal rows are numbered in any order. Nulls come first. ``n_tasks`` is how many
    tasks rows are dealt to, however few they are, and ``keep`` the columns
    wanted of rows with numbers, ``by`` among them; both are for few groups.
    """
    to = [n_tasks] if n_tasks else []
    dealt = rows.repartitionByRange(*to, *by, *order, F.xxhash64(*rows.columns)).sortWithinPartitions(*by, *order).select(*(keep or rows.columns))
    # where a task begins depends on a sample, so the numbers are written down once
    dealt = kept(dealt.withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    tasks = dealt.groupBy(*by, "_task").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    group = W.partitionBy(*by)
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tasks = tasks.withColumns({"_before": before, "_size": F.sum("_rows").over(group)}).drop("_rows")
    # not left to the planner where groups are few: it would shuffle the rows first
    return with_tasks(dealt, tasks, by, bool(n_tasks)).withColumn("_n", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_first", "_before")


def with_tasks(rows: DataFrame, tasks: DataFrame, by: list[str], few: bool = False) -> DataFrame:
    """``rows`` joined with a row for each group and task; null groups are groups too."""
    keys = [*by, "_task"]
    own = tasks.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), *(c for c in tasks.columns if c not in keys))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return rows.join(F.broadcast(own) if few else own, same).drop(*(f"_k{i}" for i in range(len(keys))))


def least_from_here(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """``rows``, numbered, with _least: the smallest ``value`` of the group's rows from this one on."""
    rows = rows.withColumn("_value", value)
    tasks = rows.groupBy(*by, "_task").agg(F.min("_value").alias("_own"))
    later = F.min("_own").over(W.partitionBy(*by).orderBy(F.col("_task").desc()).rowsBetween(W.unboundedPreceding, -1))
    rows = with_tasks(rows, tasks.withColumn("_later", later).drop("_own"), by)
    here = F.min("_value").over(W.partitionBy("_task", *by).orderBy(F.col("_n").desc()).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("_least", F.least(here, "_later")).drop("_value", "_later")
