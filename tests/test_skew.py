"""The salted join keeps exactly the rows of a plain join."""

import pytest
from pyspark.sql import functions as F

from discourse_spark.operators.skew import salted_join


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_share", [0.001, 0.2, 2.0])
def test_same_rows_as_a_plain_join(spark, how, hot_share):
    i = F.col("post_id")
    key = F.when(i % 3 == 0, "hot").when(i % 50 == 1, None).otherwise((i % 40).cast("string"))
    left = spark.range(2000).withColumnRenamed("id", "post_id").withColumn("k", key)
    right = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("5", 3), ("7", 4), ("absent", 5), (None, 6)], "k string, v int"
    )
    plain = left.join(right, "k", how).select("post_id", "k", "v")
    salted = salted_join(left, right, "k", how, hot_share=hot_share).select("post_id", "k", "v")
    assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()


def test_null_keys_are_spread(spark):
    left = spark.range(5000).select(F.col("id").alias("post_id"), F.lit(None).cast("string").alias("k"))
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(left, right, "k", "left").withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 5000 and len(sizes) > 4 and max(sizes) < 2500


def test_hot_key_is_spread(spark):
    left = spark.range(5000).withColumnRenamed("id", "post_id").withColumn("k", F.lit("hot"))
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(left, right, "k").withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in joined.groupBy("part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 5000 and len(sizes) > 4 and max(sizes) < 2500
