"""Rows, ids and columns that must come through unchanged."""

import datetime as dt

import pytest
from discourse_spark.operators import analytics as A
from discourse_spark.operators import normalize as N
from discourse_spark.operators import scoring as S
from discourse_spark.operators import temporal as E
from discourse_spark.operators import topics as B
from discourse_spark.schema import conform
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", ["text", "Text", "TEXT", "comment", "Body"])
def test_any_spelling_of_the_text_column(spark, name):
    df = N.rename_text(spark.createDataFrame([("a", 1)], f"`{name}` string, n int"), name)
    assert df.columns == ["text", "n"] and df.first().text == "a"


def test_other_text_columns_give_way(spark):
    df = N.rename_text(spark.createDataFrame([("a", "b")], "Text string, comment string"), "comment")
    assert df.columns == ["text"] and df.first().text == "b"


def test_large_ids_stay_exact(spark):
    ids = ["1234567890123456789", "1234567890123456788", "12.0", "x"]
    df = conform(spark.createDataFrame([(i,) for i in ids], "post_id string"))
    assert [r.post_id for r in df.collect()] == [1234567890123456789, 1234567890123456788, 12, None]


def test_rows_without_a_dataset_stay(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "post_id long, dataset string")
    assert {r.post_id for r in N.remove_dataset(df, "a").collect()} == {2, 3}
    new = spark.createDataFrame([(9,)], "post_id long")
    assert {r.post_id for r in N.replace_dataset(df, new, "a").collect()} == {2, 3, 9}


def test_rows_without_a_topic_stay(spark):
    df = spark.createDataFrame(
        [(1, "cats purr", 0), (2, "dogs bark", 1), (3, "cats purr", -1), (4, "what", None)],
        "post_id long, clean_text string, topic int",
    )
    got = {r.post_id: r.topic for r in B.reduce_outliers(df).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: None}


def test_topics_beyond_k_are_an_error(spark):
    scores = spark.createDataFrame([("a", 0, 1.0), ("a", 3, 1.0)], "term string, topic int, score double")
    with pytest.raises(ValueError):
        B.topic_similarity(scores, k=2)


def test_every_dataset_is_in_the_heat_map(spark):
    names = ["P  ·  one.csv", "P  ·  two.csv", "P  ·  three.csv"]
    posts = spark.createDataFrame([(n, "joy") for n in names], "dataset string, emotion string")
    assert A.emotion_heatmap(posts).columns == ["emotion", "one", "three", "two"]


def test_posts_that_start_alike_are_different(spark):
    start = "the same long beginning of two posts that then go on in different ways, "
    when = int(dt.datetime(2024, 1, 2, tzinfo=dt.UTC).timestamp())
    posts = spark.createDataFrame(
        [(1, start + "a", "politics", when), (2, start + "b", "politics", when), (3, start + "b", "politics", when)],
        "post_id long, text string, subreddit string, created_utc long",
    )
    events = spark.createDataFrame([(dt.date(2024, 1, 1), "e", "c", "x")], "date date, title string, category string, country string")
    got = E.event_window_sample(posts, events, years=(2024, 2024), subreddits=["politics"])
    assert sorted(r.post_id for r in got.collect()) == [1, 2]


def test_an_empty_result_is_not_a_failure(spark):
    def load():
        return lambda texts: [{} for _ in texts]

    df = spark.createDataFrame([("a",), (None,)], "t string")
    got = df.select(S.scores_of(F.col("t"), load, {"toxic": "toxicity"}).alias("s")).collect()
    assert got[0].s.toxicity == 0.0 and got[1].s.toxicity is None
