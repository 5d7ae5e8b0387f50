"""Ranks over a whole table or over large groups without one big task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discourse_spark.session import materialize


def with_running_total(df: DataFrame, order: list[str], group: str | None = None,
                       weight: Column | None = None) -> DataFrame:
    """Add ``_running``: the sum of ``weight`` (1 by default) up to and with the row, in its group.

    Rows are dealt out by ranges of group and order, so no task holds more than a range.
    Only the sums of the ranges, a row for each range and group in it, meet in one window.
    """
    weight = F.lit(1) if weight is None else weight
    groups = [] if group is None else [group]
    ranged = materialize(
        df.repartitionByRange(*groups, *order).withColumn("_range", F.spark_partition_id()), "ranged"
    )
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*groups, "_range").agg(F.sum(weight).alias("_sum"))
    before = sums.select(
        *[F.col(g).alias("_of") for g in groups], F.col("_range").alias("_at"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
    )
    same = F.col("_range") == F.col("_at")
    if groups:
        same = same & F.col(group).eqNullSafe(F.col("_of"))
    within = Window.partitionBy(*groups, "_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        ranged.withColumn("_running", F.sum(weight).over(within)).join(before, same)
        .withColumn("_running", F.col("_running") + F.col("_before"))
        .drop("_range", "_at", "_of", "_before")
    )
