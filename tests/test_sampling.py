"""Samples and splits against brute force, with a hot stratum."""

import pytest
from pyspark.sql import functions as F

from discourse_spark.operators import sampling as P


@pytest.fixture(scope="module")
def skewed(spark):
    """9000 rows: two thirds in one stratum, the rest in a few small ones, some null."""
    i = F.col("post_id")
    stratum = F.when(i % 3 > 0, "hot").when(i % 30 == 0, "rare").when(i % 900 == 3, "tiny")
    return spark.range(9000).withColumnRenamed("id", "post_id").select(
        "post_id", F.when(i % 7 != 0, stratum).alias("subreddit"), F.lit("other").alias("source")
    )


def keyed(df, seed=42):
    rows = df.withColumn("k", P.hash_key(seed, "post_id")).collect()
    return sorted(rows, key=lambda r: (r.k, r.post_id))


def test_random_sample_is_the_smallest_keys(spark, skewed):
    want = {r.post_id for r in keyed(skewed)[:777]}
    for parts, border_rows in ((1, 100000), (7, 0), (3, 1)):
        got = P.random_sample(skewed.repartition(parts), 777, border_rows=border_rows).collect()
        assert {r.post_id for r in got} == want and len(got) == 777
    assert P.random_sample(skewed, 10**6).count() == 9000
    assert P.random_sample(skewed, 0).count() == 0


def test_coarse_keys_break_ties_by_id(spark, skewed):
    got = P.random_sample(skewed, 100, key=F.col("post_id") % 3, key_space=3).collect()
    assert sorted(r.post_id for r in got) == list(range(0, 300, 3))


@pytest.mark.parametrize("n", [3, 100, 1000, 8999])
def test_stratified_sample_equals_brute_force(spark, skewed, n):
    rows = keyed(skewed)
    strata = {}
    for r in rows:
        strata.setdefault(r.subreddit or r.source, []).append(r.post_id)
    chosen, room = [], n
    for name in sorted(strata):
        ids = strata[name]
        quota = min(len(ids), max(1, n * len(ids) // len(rows)), room)
        chosen += ids[:quota]
        room -= quota
    rest = [r.post_id for r in rows if r.post_id not in set(chosen)]
    want = set(chosen + rest[:n - len(chosen)])
    for border_rows in (100000, 0):
        sample = P.stratified_sample(skewed, n, border_rows=border_rows)
        got = [r.post_id for r in sample.collect()]
        assert len(got) == n and set(got) == want


def test_split_is_exact_and_complete(spark, skewed):
    flagged = skewed.withColumn("label", (F.col("post_id") % 10 == 0).cast("int"))
    split = P.train_test_split(flagged, "label")
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts == {(0, "train"): 6480, (0, "test"): 1620, (1, "train"): 720, (1, "test"): 180}
    assert split.select("post_id").distinct().count() == 9000
    again = P.train_test_split(flagged.repartition(5), "label")
    assert split.exceptAll(again).isEmpty()


def test_take_first(spark, skewed):
    want = list(range(5000))
    assert sorted(r.post_id for r in P.take_first(skewed, 5000).collect()) == want
    assert P.take_first(skewed.where("post_id < 0"), 5000).isEmpty()
    assert sorted(r.post_id for r in P.take_first(skewed, 3).collect()) == [0, 1, 2]
    assert P.take_first(skewed, 1_000_000).count() == skewed.count()


@pytest.mark.parametrize("n", [5, 700])
def test_take_first_of_text_ids(spark, n):
    texts = spark.range(1000).select(F.concat(F.lit("id"), "id").alias("post_id"))
    got = sorted(r.post_id for r in P.take_first(texts, n).collect())
    assert got == sorted(f"id{i}" for i in range(1000))[:n]


def test_take_first_with_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(i,) for i in (None, 1, 2, 2, 2, 3)], "post_id long")
    got = [r.post_id for r in P.take_first(rows, 4).collect()]
    assert sorted(got, key=lambda x: x or 0) == [None, 1, 2, 2]


def test_many_rows_with_one_key_are_ranked_by_id(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("post_id"), F.when(F.col("id") % 10 > 0, "big").alias("stratum")
    )
    got = P.QuotaSplit(
        rows, F.col("stratum"), lambda sizes: sizes.withColumn("quota", F.lit(1500).cast("long")),
        key=F.lit(0), key_space=1,
    ).marked().where("selected")
    ids = sorted(r.post_id for r in got.where("stratum = 'big'").collect())
    assert ids == [i for i in range(20_000) if i % 10][:1500]
