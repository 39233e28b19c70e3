"""As-of joins of groups of any size: the last value at or before, and the next at or after, each row's own.

Both sides are sorted together into ranges of group and value. A task knows the
values of its range; of other ranges it needs the largest before and the
smallest behind, one row a group and task. No group is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kappaforge.operators.ranked import with_tasks
from kappaforge.sources.scratch import kept


def around(rows: DataFrame, values: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Distinct (by, at) of ``rows`` with before and after: the nearest ``value`` of the group on either side, an equal one on both.

    A null ``at`` has neither; null values count for nothing; null groups are groups.
    """
    asked = rows.select(*by, F.col(at).alias("_t")).where("_t is not null").distinct().withColumn("_known", F.lit(False))
    known = values.select(*by, F.col(value).alias("_t")).where("_t is not null").distinct().withColumn("_known", F.lit(True))
    dealt = asked.unionByName(known).repartitionByRange(*by, "_t")
    # where a task's range begins depends on a sample, so it is written down once
    dealt = kept(dealt.select(*by, "_t", F.when(F.col("_known"), F.col("_t")).alias("_value"), F.spark_partition_id().alias("_task")))
    tasks = dealt.groupBy(*by, "_task").agg(F.min("_value").alias("_least"), F.max("_value").alias("_most"))
    order = W.partitionBy(*by).orderBy("_task")
    earlier = F.max("_most").over(order.rowsBetween(W.unboundedPreceding, -1))
    later = F.min("_least").over(order.rowsBetween(1, W.unboundedFollowing))
    tasks = tasks.select(*by, "_task", earlier.alias("_earlier"), later.alias("_later"))
    here = W.partitionBy("_task", *by).orderBy("_t")
    near = dealt.withColumns({"_last": F.max("_value").over(here.rangeBetween(W.unboundedPreceding, 0)), "_next": F.min("_value").over(here.rangeBetween(0, W.unboundedFollowing))})
    near = with_tasks(near.where("_value is null"), tasks, by)
    return near.select(*by, F.col("_t").alias(at), F.coalesce("_last", "_earlier").alias("before"), F.coalesce("_next", "_later").alias("after"))
