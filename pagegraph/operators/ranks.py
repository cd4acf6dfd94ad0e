"""Ranks within groups, of which one may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.storage import written


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds the place (from 1) of each row in its group, in an order.

    Rows are dealt by ranges of group and order, so a large group is spread over tasks; a task numbers its own and starts where
    the tasks before it end, which a count for each task and group tells. Ties are numbered in any order.
    """
    dealt = written(rows.repartitionByRange(*keys, *order).withColumn("_task", F.spark_partition_id()), "ranks")
    counts = dealt.groupBy(*keys, "_task").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_task").alias("_at"), before.alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_task", *keys).orderBy(*order)))
    same = [own[k].eqNullSafe(starts[f"_{k}"]) for k in keys]
    out = own.join(starts, [own["_task"] == starts["_at"], *same])
    return out.select(*rows.columns, (F.col("_before") + F.col("_own")).alias(name))
