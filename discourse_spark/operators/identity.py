"""Ids for rows that come without one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from discourse_spark.session import materialize


def with_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add ``name``: the MD5 of the row's content and the number of equal rows before it.

    Ids are unique and depend on the content alone: reading again, another partitioning and
    further rows leave them as they are. Columns count by name, not by order; a null is as no
    column, and times are spelled in the session's zone. An earlier ``name`` is replaced.
    Equal rows are numbered per partition they were read in, and partitions among
    themselves by their counts, so copies of one row, however many, need no large task.
    """
    columns = sorted(c for c in df.columns if c != name)
    content = F.to_json(F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]))
    keyed = materialize(
        df.select(*[F.col(f"`{c}`") for c in df.columns if c != name]).withColumns(
            {"_key": F.md5(content), "_part": F.spark_partition_id()}
        ),
        "keyed",
    )
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(earlier)).where(
        F.col("_before").isNotNull()
    ).drop("_n")
    within = Window.partitionBy("_key", "_part").orderBy("_key")
    nth = F.col("_nth") - 1 + F.coalesce("_before", F.lit(0))
    return (
        keyed.withColumn("_nth", F.row_number().over(within)).join(before, ["_key", "_part"], "left")
        .withColumn(name, F.concat_ws("-", "_key", nth.cast("string")))
        .drop("_key", "_part", "_nth", "_before")
    )
