"""Schema normalisation: columns, types, dates, unions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from discourse_spark.operators import enrich, normalize as N


def test_detect_text_column(spark):
    def found(rows, schema):
        return N.detect_text_column(spark.createDataFrame(rows, schema))

    long, longer = "x" * 40, "y" * 50
    assert found([("a", "b")], "tweet string, body string") == ("tweet", "exact")
    assert found([("a",)], "CAPTION string") == ("CAPTION", "case-insensitive")
    assert found([(1, long, "s")], "a int, b string, c string") == ("b", "inferred")
    assert found([(long, longer)], "a string, b string") == ("b", "ambiguous")
    assert found([("s", 1)], "a string, b int") == (None, "not_found")
    assert found([(None, 1)], "a string, b int") == (None, "not_found")
    assert found([(1,)], "a int") == (None, "not_found")


def test_rename_text(spark):
    df = spark.createDataFrame([("old", "new")], "text string, body string")
    assert N.rename_text(df, "body").collect()[0].asDict() == {"text": "new"}
    assert N.rename_text(df, "text").columns == ["text", "body"]
    assert N.rename_text(df.drop("text"), None).collect()[0]["text"] == ""


def test_coerce_and_fill(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("nan",)], "a string")
    assert [r.a for r in N.coerce_numeric(df, ["a", "absent"]).collect()] == [1.5, None, None, None]
    assert [r.a for r in N.coerce_numeric(df, ["a"], 0).collect()] == [1.5, 0.0, 0.0, 0.0]
    filled = N.ensure_columns(df, {"a": ("string", "?"), "b": ("int", 3), "c": ("double", None)})
    assert [tuple(r) for r in filled.collect()][2] == ("?", 3, None)


def test_duplicate_columns_keep_the_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a", "b", "a")
    assert N.drop_duplicate_columns(df).collect()[0].asDict() == {"a": 1, "b": 2}


def test_post_date_needs_half_of_the_values(spark):
    rows = [("never", "2024-01-02T03:04:05.678Z"), ("2024-01-01", "Tue Jan 02 03:04:05 +0000 2024"),
            ("no", "2024-01-02 03:04:05"), ("no", "2024-01-02"), (None, "junk"), ("no", None)]
    df = spark.createDataFrame(rows, "createdAt string, created_at string")
    dates = [r.post_date for r in N.parse_post_date(df).collect()]
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert dates == [at.replace(microsecond=678000), at, at, dt.datetime(2024, 1, 2), None, None]
    assert N.parse_post_date(df.drop("created_at")).columns == ["createdAt"]
    empty = spark.createDataFrame([(None,)], "date string")
    assert N.parse_post_date(empty).columns == ["date"]


def test_epoch_to_date_drops_zero_and_junk(spark):
    df = spark.createDataFrame([("86400",), ("0",), ("x",), (None,)], "created_utc string")
    rows = N.epoch_to_date(df).collect()
    assert [(r.date, r.year_month) for r in rows] == [(dt.datetime(1970, 1, 2), "1970-01")]


def test_strip_and_merge(spark):
    df = spark.createDataFrame(
        [("　 t ", None), (None, "b \x1c"), (None, None), ("a", "b")], "t string, b string"
    )
    merged = [r[0] for r in df.select(N.merge_title_body(F.col("t"), F.col("b"))).collect()]
    assert merged == ["t", "b", "", "a b"]
    for t, b in [("　 t ", ""), ("", "b \x1c")]:
        assert (t + " " + b).strip() in merged


def test_pattern_lists_are_read_without_evaluation(spark):
    df = spark.createDataFrame(
        [("['a', 'b']",), ("[]",), ("__import__('os')",), (None,), ("x",)], "p string"
    )
    assert [r[0] for r in df.select(N.parse_pattern_list(F.col("p"))).collect()] == [
        ["a", "b"], [], [], [], []
    ]


def test_union_and_upsert(spark):
    a = spark.createDataFrame([("A", "1", 2)], "dataset string, othering_predicted string, x int")
    b = spark.createDataFrame([("B", "zz")], "dataset string, extra string")
    rows = N.union_posts([a, b]).orderBy("dataset").collect()
    assert [(r.dataset, r.othering_predicted, r.othering_score) for r in rows] == [
        ("A", 1, 0.0), ("B", 0, 0.0)
    ]
    both = N.union_posts([a, b])
    new = spark.createDataFrame([(9,), (10,)], "x int")
    replaced = N.replace_dataset(both, new, "A")
    assert sorted(r.dataset for r in replaced.collect()) == ["A", "A", "B"]
    assert sorted(r.x for r in replaced.where("dataset = 'A'").collect()) == [9, 10]


def test_enrich_base_fills_and_skips(spark):
    df = spark.createDataFrame(
        [("They never learn @me", None), (None, "reddit")], "text string, source string"
    )
    first, second = enrich.enrich_base(df).orderBy(F.col("text").isNull()).collect()
    assert (first.clean_text, first.source, first.subreddit) == (
        "they never learn", "external", "unknown")
    assert (first.othering_predicted, first.othering_proba) == (1, 0.25)
    assert (second.clean_text, second.pronoun_type, second.othering_predicted) == ("", "none", 0)
    done = df.withColumns({"clean_text": F.lit("kept"), "pronoun_type": F.lit("x"),
                           "has_othering": F.lit(True), "othering_score": F.lit(2)})
    row = enrich.enrich_base(done).first()
    assert (row.clean_text, row.pronoun_type, row.othering_predicted, row.othering_proba) == (
        "kept", "x", 1, 0.5)
    bare = enrich.enrich_base(df, run_othering=False).first()
    assert (bare.othering_predicted, bare.othering_proba) == (0, 0.0)


def test_enrich_full_keeps_existing_scores(spark):
    from discourse_spark.plans.sampling_queries import load_emotion, load_toxicity

    df = spark.createDataFrame([("rats here", None), ("hello", 0.9)], "text string, toxicity double")
    rows = enrich.enrich_full(df, True, load_toxicity, load_emotion).orderBy("text").collect()
    assert [r.toxicity for r in rows] == [0.9, None]
    assert [r.emotion for r in rows] == ["neutral", "neutral"]
    fresh = enrich.enrich_full(df.drop("toxicity"), True, load_toxicity).orderBy("text").collect()
    assert [(r.toxicity, r.severe_toxicity) for r in fresh] == [(0.0, 0.0), (0.5, 0.0)]


@pytest.mark.parametrize("value,want", [
    ("1/5/2024", "2024-01-05 00:00:00"), ("13/01/2024", "2024-01-13 00:00:00"),
    ("2024/01/05", "2024-01-05 00:00:00"), ("2024/1/5 7:08", "2024-01-05 07:08:00"),
    ("Jan 5, 2024", "2024-01-05 00:00:00"), ("Sept. 5 2024", "2024-09-05 00:00:00"),
    ("January 5, 2024 3:04pm", "2024-01-05 15:04:00"), ("05-Jan-2024", "2024-01-05 00:00:00"),
    ("Fri, 05 Jan 2024 10:00:00 GMT", "2024-01-05 10:00:00"),
    ("Friday, 5 January 2024 10:00 +0200", "2024-01-05 08:00:00"),
    ("Fri Jan 05 10:00:00 +0000 2024", "2024-01-05 10:00:00"),
    ("12/31/2024 12:00 AM", "2024-12-31 00:00:00"), ("2024-01-05 03:04 PM", "2024-01-05 15:04:00"),
    ("32/13/2024", None), ("may be", None), ("", None), (None, None),
])
def test_date_spellings(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string").select(N.parse_timestamp(F.col("v")).alias("t"))
    found = df.first().t
    assert (None if found is None else str(found)) == want
