"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Every query runs over whole
tables into a sink that discards rows, so nothing but Spark's work is timed. The
three tables that several queries read are timed on their own (``write_...``).
"""

from __future__ import annotations

import json
import os
import sys
import time

from discourse_spark.plans import all_queries
from discourse_spark.plans.corpus import facts
from discourse_spark.plans.model_queries import cleaned, topic_scores
from discourse_spark.session import local_session

HEADLINE = [
    "clean_text", "tag_pronouns_regex", "tag_pronouns_lexicon", "match_patterns", "enrich_base",
    "ingest", "overview_kpis", "dataset_counts", "rate_by_group", "platform_comparison",
    "family_share_by_dataset", "pattern_cooccurrence", "pattern_counts", "emotion_heatmap",
    "emotion_delta", "toxicity_kpis", "most_toxic", "timeline_week", "nearest_event",
    "emotion_timeline", "event_study", "suggest_events", "event_window_sample", "patch_dates",
    "random_sample", "stratified_sample", "train_test_split", "score_batches", "top1_label",
    "fill_missing_scores", "tfidf_vocabulary", "tfidf_features", "c_tf_idf", "topic_name",
    "reduce_outliers", "topic_crosstab", "topic_similarity",
]


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    runs = all_queries()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds = {
        "write_facts": timed(lambda: facts(spark, sf_dir)),
        "write_cleaned": timed(lambda: cleaned(spark, sf_dir)),
        "write_topic_scores": timed(lambda: topic_scores(spark, sf_dir)),
    }
    for name in names:
        def run(name: str = name) -> None:
            runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

        seconds[name] = timed(run)
    print(json.dumps({
        "metric": "total seconds over headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
