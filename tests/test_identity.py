"""Ids of rows without one: unique, and the same however the rows are read."""

from collections import Counter

from pyspark.sql import functions as F

from discourse_spark.operators.identity import with_row_ids
from discourse_spark.operators.sampling import random_sample, train_test_split
from discourse_spark.sources import posts as IO

ROWS = [(1, "a", 0.5), (1, "a", 0.5), (None, "a", 0.5), (2, None, None), (None, None, None)] * 3
SCHEMA = "post_id long, text string, score double"


def ids_of(df):
    return sorted((str(tuple(r)[:-1]), r["row_id"]) for r in with_row_ids(df).collect())


def test_ids_are_unique_and_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    once = ids_of(df.coalesce(1))
    assert once == ids_of(df.repartition(7)) == ids_of(df.orderBy(F.desc("text")))
    assert len({i for _, i in once}) == len(ROWS)
    per_row = Counter(row for row, _ in once)
    for row, i in once:
        assert 0 <= int(i.rsplit("-", 1)[1]) < per_row[row]


def test_more_rows_and_another_order_of_columns_leave_ids_alone(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    more = df.unionByName(spark.createDataFrame([(9, "new", 1.0)], SCHEMA))
    assert set(ids_of(df)) < set(ids_of(more))
    turned = with_row_ids(df.select("text", "score", "post_id"))
    assert {r["row_id"] for r in turned.collect()} == {i for _, i in ids_of(df)}


def test_a_null_and_an_empty_text_differ(spark):
    rows = with_row_ids(spark.createDataFrame([(None,), ("",)], "text string")).collect()
    assert len({r["row_id"].split("-")[0] for r in rows}) == 2


def test_empty_table_and_an_earlier_id(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert with_row_ids(df.limit(0)).columns == ["post_id", "text", "score", "row_id"]
    assert with_row_ids(df.limit(0)).count() == 0
    named = df.withColumn("row_id", F.monotonically_increasing_id())
    assert {r["row_id"] for r in with_row_ids(named).collect()} == {i for _, i in ids_of(df)}


def test_a_hot_row_is_numbered_per_partition(spark):
    hot = spark.range(0, 9000, numPartitions=9).select(F.lit("same").alias("text"))
    df = with_row_ids(hot.unionByName(spark.range(3000).select(F.col("id").cast("string").alias("text"))))
    assert df.select("row_id").distinct().count() == 12000
    numbers = df.where(F.col("text") == "same").select(
        F.split("row_id", "-")[1].cast("int").alias("n")).agg(F.min("n"), F.max("n")).first()
    assert tuple(numbers) == (0, 8999)


def test_loaded_rows_can_be_sampled_and_split(spark, tmp_path):
    folder = tmp_path / "twitter"
    folder.mkdir()
    (folder / "a.csv").write_text("tweet\n" + "again\n" * 6 + "once\n")
    (folder / "b.csv").write_text("tweet\n" + "again\n" * 3)
    loaded, errors = IO.load_labelled(spark, str(tmp_path))
    assert not errors and loaded.select("row_id").distinct().count() == 10
    again, _ = IO.load_labelled(spark, str(tmp_path))
    assert {r.row_id for r in again.collect()} == {r.row_id for r in loaded.collect()}
    assert random_sample(loaded, 4, "row_id").count() == 4
    split = train_test_split(loaded, "dataset", id_col="row_id")
    sizes = {(r["dataset"][-5], r["split"]): r["count"] for r in split.groupBy("dataset", "split").count().collect()}
    assert sizes == {("a", "train"): 6, ("a", "test"): 1, ("b", "train"): 2, ("b", "test"): 1}
    plain, _ = IO.load_labelled(spark, str(tmp_path), row_ids=False)
    assert "row_id" not in plain.columns
