"""Pluggable scorers: loading, batches, failures, backfill, propagation."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from discourse_spark.operators import scoring as M

# workers cannot import test modules
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = {"toxic": ["bad", "worse"], "insult": ["bad"]}


class Counting:
    """Returns the batch size it was called with."""

    def __call__(self, texts):
        return [{"toxic": len(texts) / 100, "joy": 0.2, "anger": 0.2} for _ in texts]


class Picky:
    def __call__(self, texts):
        if "boom" in texts:
            raise ValueError("no")
        return [{"toxic": 0.123456, "joy": 0.9} for _ in texts]


def load_words():
    return M.KeywordScorer(WORDS)


@pytest.fixture
def posts(spark):
    rows = [(1, "bad day", None, None), (2, None, None, None), (3, "worse", 0.5, "fear"), (4, "boom", None, None)]
    schema = "post_id long, clean_text string, toxicity double, emotion string"
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_missing_labels_are_zero(posts):
    rows = M.score_batches(posts, load_words).orderBy("post_id").collect()
    assert [(r.toxicity, r.insult, r.threat) for r in rows] == [
        (0.5, 0.5, 0.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_batches_have_the_asked_size(spark):
    df = spark.range(10).select(F.lit("x").alias("clean_text")).coalesce(1)
    rows = M.score_batches(df, Counting, {"toxic": "toxicity"}, batch_size=4).collect()
    assert sorted(r.toxicity for r in rows) == [0.02] * 2 + [0.04] * 8


def test_top_label_breaks_ties_by_name(posts):
    assert {r.emotion for r in M.top1_label(posts, Counting).collect()} == {"anger"}


def test_input_limit_is_optional(spark):
    df = spark.createDataFrame([("good good bad",)], "clean_text string")
    load = lambda: M.KeywordScorer({"x": ["bad"]}, rest="neutral")
    assert M.top1_label(df, load).first().emotion_score == 0.6667
    assert M.top1_label(df, load, max_chars=9).first().emotion_score == 1.0


def test_failures_stop_the_job_or_fall_back(posts):
    with pytest.raises(Exception, match="no"):
        M.score_batches(posts, Picky, {"toxic": "toxicity"}).collect()
    rows = M.score_batches(posts, Picky, {"toxic": "toxicity"}, batch_size=1, keep_going=True)
    assert [r.toxicity for r in rows.orderBy("post_id").collect()] == [0.123456] * 3 + [None]


def test_backfill_touches_only_missing_rows(posts):
    rows = M.fill_missing_toxicity(posts, Picky, batch_size=1).orderBy("post_id").collect()
    assert [r.toxicity for r in rows] == [0.1235, 0.1235, 0.5, None]
    assert rows[2].insult is None and rows[0].insult == 0.0
    rows = M.fill_missing_emotion(posts, Picky, batch_size=1).orderBy("post_id").collect()
    assert [(r.emotion, r.emotion_score) for r in rows] == [
        ("joy", 0.9), ("joy", 0.9), ("fear", None), ("neutral", 0.0)]


def test_coverage(posts):
    rows = {r.column: r for r in M.coverage(posts, ["toxicity", "emotion"]).collect()}
    assert (rows["toxicity"].n_missing, rows["toxicity"].coverage_pct) == (3, 25.0)


def test_propagation_needs_equal_sizes(posts):
    target = posts.select("post_id", F.lit(9.0).alias("toxicity"))
    updated, done = M.propagate_scores(posts, target, ["toxicity"])
    assert done and updated.where("post_id = 3").first().toxicity == 0.5
    same, done = M.propagate_scores(posts, target.limit(2), ["toxicity"])
    assert not done and {r.toxicity for r in same.collect()} == {9.0}
