"""Invariants of the corpus queries, and brute force on small tables."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from discourse_spark.operators import analytics as A


def total(df, column):
    return df.agg(F.sum(column)).first()[0]


def test_shares_add_up(facts):
    assert total(A.dataset_counts(facts), "pct") == pytest.approx(100)
    assert total(A.emotion_distribution(facts), "pct") == pytest.approx(100)
    assert total(A.pronoun_vs_othering(facts), "pct_posts") == pytest.approx(100)
    delta = A.emotion_delta(facts)
    assert total(delta, "othering") == pytest.approx(100)
    assert total(delta, "delta") == pytest.approx(0, abs=1e-9)


def test_counts_of_texts_do_not_depend_on_columns(spark):
    from discourse_spark.operators import temporal

    posts = spark.sql("""SELECT * FROM VALUES ('us', 1, 'a', 'd', DATE'2024-01-01', 0.5), ('us', 0, NULL, 'd', DATE'2024-01-02', 0.1)
        AS t(pronoun_type, othering_predicted, text, dataset, post_date, toxicity)""")
    narrow = posts.withColumn("has_text", F.col("text").isNotNull()).drop("text")
    assert [A.pronoun_vs_othering(p).first().n for p in (posts, narrow, narrow.drop("has_text"))] == [1, 1, 2]
    assert [temporal.timeline(p).first().posts for p in (posts, narrow, narrow.drop("has_text"))] == [1, 1, 2]


def test_cooccurrence_is_symmetric(facts):
    pairs = {(r.a, r.b): r.n for r in A.pattern_cooccurrence(facts).collect()}
    assert pairs and all(pairs[(b, a)] == n and a != b for (a, b), n in pairs.items())


@pytest.mark.parametrize("n", [0, 1, 2, 5, 400, 401])
@pytest.mark.parametrize("kind", ["spread", "one_value", "near_zero"])
def test_median_is_exact(spark, n, kind):
    rng = random.Random(n)
    draw = {
        "spread": rng.random,
        "one_value": lambda: 0.25 if rng.random() < 0.7 else rng.random(),
        "near_zero": lambda: rng.random() * 1e-6,
    }[kind]
    values = [draw() for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "toxicity double")
    got = A.exact_median(df, "toxicity").first()[0]
    assert got == (pytest.approx(statistics.median(values), abs=1e-15) if values else None)


def test_mode_ties_go_to_the_smallest_value(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("h", None)], "g string, v string")
    assert df.limit(1).select(A.most_frequent(df, "v")).first()[0] == "a"
    assert A.top_value_per_group(df, "g", "v", "top").collect() == [("g", "a")]


def test_delta_with_a_missing_side(spark):
    df = spark.createDataFrame([("joy", 1), ("joy", 1)], "emotion string, othering_predicted int")
    row = A.emotion_delta(df).first()
    assert (row.othering, row.non_othering, row.delta) == (100.0, 0.0, 100.0)


def test_platform_comparison_without_labels(spark):
    df = spark.createDataFrame(
        [("reddit", "x", None, False, None, [])],
        "source string, subreddit string, toxicity double, has_othering boolean, "
        "emotion string, matched_patterns array<string>",
    )
    row = A.platform_comparison(df).first()
    assert (row.top_emotion, row.top_pattern, row.avg_toxicity) == ("N/A", "N/A", None)


def test_family_share_counts_posts_once(spark):
    df = spark.createDataFrame(
        [("D  ·  a.csv", 1, ["destroying_our", "our_culture"]), ("D  ·  a.csv", 1, ["flood"]),
         ("D  ·  a.csv", 0, ["flood"])],
        "dataset string, othering_predicted int, matched_patterns array<string>",
    )
    rows = {r.family: r.pct for r in A.family_share_by_dataset(df).collect()}
    assert rows == {"threat_framing": 50.0, "dehumanizing": 50.0}
