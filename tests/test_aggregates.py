"""Kept sums after replacing and removing datasets, against recomputation."""

import re

import pytest
from pyspark.sql import functions as F

from discourse_spark.operators import aggregates as G
from discourse_spark.operators import analytics as A
from discourse_spark.operators import temporal as E
from discourse_spark.operators.normalize import remove_dataset, replace_dataset
from test_plans import plan_of

TWITTER, TIKTOK = "Twitter  ·  tw_a.csv", "Tiktok  ·  tk_b.csv"


def same(got, want):
    def rounded(df):
        return sorted(
            str({k: round(v, 9) if isinstance(v, float) else v for k, v in sorted(r.asDict().items())})
            for r in df.collect()
        )

    assert rounded(got) == rounded(want)


def all_equal(sums, posts):
    same(G.overview_kpis(sums), A.overview_kpis(posts))
    same(G.dataset_counts(sums), A.dataset_counts(posts))
    same(G.pronoun_vs_othering(sums), A.pronoun_vs_othering(posts))
    same(G.othering_rate_by_dataset(sums), A.othering_rate_by_dataset(posts))
    for unit in ("Day", "Week", "Month"):
        same(G.timeline(sums, unit), E.timeline(posts, unit))


@pytest.fixture
def messy(facts):
    """Some rows without dataset, date, emotion, prediction or text; a dataset named like a number."""
    i = F.col("post_id")
    return facts.withColumns({
        "dataset": F.when(i % 17 == 0, None).when(i % 19 == 0, "2024").otherwise(F.col("dataset")),
        "post_date": F.when(i % 10 == 3, None).otherwise(F.col("post_date")),
        "othering_predicted": F.when(i % 23 != 1, F.col("othering_predicted")),
        "has_text": i % 29 != 2,
    })


def test_sums_after_replace_and_remove_equal_recomputation(spark, messy, tmp_path):
    path = f"{tmp_path}/sums"
    G.keep_sums(messy, path)
    all_equal(G.read_sums(spark, path), messy)
    fewer = messy.where((F.col("dataset") == TIKTOK) & (F.col("post_id") % 3 == 0))
    posts = replace_dataset(messy, fewer, TIKTOK)
    G.keep_sums(fewer, path)
    all_equal(G.read_sums(spark, path), posts)
    for gone in (TWITTER, "2024", None):
        posts = remove_dataset(posts, gone)
        G.drop_sums(spark, path, gone)
        all_equal(G.read_sums(spark, path), posts)
    G.drop_sums(spark, path, TWITTER)
    G.keep_sums(messy.where(F.col("dataset") == TWITTER), path)
    again = posts.unionByName(messy.where(F.col("dataset") == TWITTER))
    all_equal(G.read_sums(spark, path), again)


def test_a_change_touches_its_folder_alone(spark, messy, tmp_path):
    G.keep_sums(messy, f"{tmp_path}/sums")
    before = {str(p) for p in tmp_path.glob("sums/dataset=*/*.parquet")}
    G.drop_sums(spark, f"{tmp_path}/sums", "2024")
    changed = {str(p) for p in tmp_path.glob("sums/dataset=*/*.parquet")} ^ before
    assert changed and all("dataset=2024" in p for p in changed)
    plan = plan_of(G.timeline(G.read_sums(spark, f"{tmp_path}/sums").where(F.col("dataset") == TIKTOK)))
    assert re.search(r"PartitionFilters: \[.*dataset.* = Tiktok", plan)


def test_no_rows_left(spark, messy, tmp_path):
    path = f"{tmp_path}/sums"
    G.keep_sums(messy.where(F.col("dataset") == TIKTOK), path)
    G.drop_sums(spark, path, TIKTOK)
    all_equal(G.read_sums(spark, path), messy.limit(0))
