"""Plans: what must hold at any scale, read from the physical plans."""

import contextlib
import io
import re

import pytest

from discourse_spark.plans import all_queries, all_sql, corpus
from discourse_spark.functions import text as X
from discourse_spark.functions.rules import apply_othering
from discourse_spark.operators import analytics as A
from discourse_spark.operators import temporal as E

LAZY = [
    "overview_kpis", "dataset_counts", "rate_by_group", "platform_comparison", "event_study",
    "emotion_heatmap", "family_share_by_dataset", "pattern_cooccurrence", "nearest_event",
    "timeline_week", "suggest_events", "patch_dates", "event_window_sample", "stratified_sample",
    "reduce_outliers", "topic_similarity", "toxicity_kpis", "random_sample", "toxicity_by_score", "events_in_range", "train_test_split",
]


def plan_of(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_or_nested_loop_joins(spark, sf_dir, name):
    plan = plan_of(all_queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_texts_are_cleaned_once(spark, sf_dir):
    cleaned = corpus.posts(spark, sf_dir).withColumn("clean_text", X.clean_text("text"))
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = plan_of(apply_othering(cleaned), "extended")
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("lower(") == 1 and len(re.findall(r"RLIKE|rlike", physical)) == 32


def test_facts_queries_read_only_their_columns(facts, calendar):
    plan = plan_of(A.dataset_counts(facts))
    assert "ReadSchema: struct<dataset:string,othering_predicted:int>" in plan
    plan = plan_of(E.event_study(facts, calendar, metrics=["toxicity"]))
    assert "ReadSchema: struct<post_date:timestamp,toxicity:double>" in plan
    assert "PushedFilters: [IsNotNull(post_date)]" in plan


def test_filters_reach_the_scan(facts):
    plan = plan_of(A.pattern_cooccurrence(facts))
    assert "EqualTo(othering_predicted,1)" in plan
    plan = plan_of(A.platform_comparison(facts))
    assert "EqualTo(source,reddit)" in plan


def test_window_limits_trim_before_the_shuffle(spark, sf_dir):
    plan = plan_of(all_queries()["event_window_sample"](spark, sf_dir))
    assert "WindowGroupLimit" in plan


def test_corpus_queries_use_no_python(spark, sf_dir):
    for name in LAZY:
        if name != "topic_similarity":
            plan = plan_of(all_queries()[name](spark, sf_dir))
            assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, name


def test_texts_are_not_shuffled_to_meet_a_calendar(spark, sf_dir, calendar, tmp_path):
    """Literal calendars, and those read from files, are known to be small when planning."""
    from discourse_spark.sources import posts as IO

    posts = corpus.posts(spark, sf_dir)
    IO.write_table(calendar.selectExpr("*", "'' AS region", "'' AS source"), f"{tmp_path}/c.csv")
    for events in (calendar, IO.read_calendar_events(spark, f"{tmp_path}/c.csv")):
        plan = plan_of(E.event_window_sample(posts, events, years=(2024, 2024)), "simple")
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_registry_is_complete():
    assert set(all_sql()) <= set(all_queries())
    assert not [n for n in all_queries() if "pipeline" in n or re.match(r"op\d", n)]
