"""Event windows, spikes and date patches against brute force."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from discourse_spark.operators import temporal as E

DAY = dt.timedelta(days=1)
START = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def daily_posts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        day = START + rng.randrange(60) * DAY
        toxicity = None if rng.random() < 0.3 else rng.random()
        rows.append((i, dt.datetime.combine(day, dt.time(rng.randrange(24))), i % 3 % 2, toxicity))
    rows.append((600, None, 1, 0.5))
    schema = "post_id long, post_date timestamp, othering_predicted int, toxicity double"
    return rows, spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def events(spark):
    rows = [(START, "first"), (START + 30 * DAY, "middle"), (START + 74 * DAY, "edge"),
            (START + 400 * DAY, "far"), (None, "undated")]
    df = spark.createDataFrame([(*r, "c", "x") for r in rows],
                               "date date, title string, category string, country string")
    return rows, df


def mean(values):
    values = [v for v in values if v is not None]
    return sum(values) / len(values) if values else None


def daily(rows):
    days = {}
    for _, stamp, flag, toxicity in rows:
        if stamp is not None:
            days.setdefault(stamp.date(), []).append((flag, toxicity))
    return {d: (len(v), mean([x[0] for x in v]), mean([x[1] for x in v])) for d, v in days.items()}


def test_event_study_equals_brute_force(daily_posts, events):
    days = daily(daily_posts[0])
    want = {}
    for date, title in events[0]:
        if date is None:
            continue
        window = {(d - date).days: v for d, v in days.items() if abs((d - date).days) <= 14}
        if sum(v[0] for v in window.values()) < 5:
            continue
        before = mean([v[2] for o, v in window.items() if o < 0])
        baseline = before if before is not None else mean([v[2] for v in window.values()])
        for offset, v in window.items():
            want[(title, offset)] = (v[0], v[2], None if v[2] is None else v[2] - baseline)
    study = E.event_study(daily_posts[1], events[1]).collect()
    got = {(r.event_title, r.day_offset): (r.n_posts, r.toxicity, r.toxicity_deviation) for r in study}
    assert got.keys() == want.keys() and {"first", "middle"} <= {t for t, _ in got}
    assert not {"far", "undated"} & {t for t, _ in got}
    for key in want:
        assert got[key] == pytest.approx(want[key], nan_ok=True), key


def test_mean_pre_event_deviation_is_zero(daily_posts, events):
    study = E.event_study(daily_posts[1], events[1]).where("day_offset < 0")
    rows = study.groupBy("event_title").agg(F.avg("toxicity_deviation").alias("m")).collect()
    assert rows and all(r.m == pytest.approx(0, abs=1e-12) for r in rows)


def test_event_lift_equals_brute_force(daily_posts, events):
    days = daily(daily_posts[0])
    got = {r.title: r.lift for r in E.event_lift(daily_posts[1], events[1]).collect()}
    for date, title in events[0]:
        if date is None:
            continue
        pre = [v for d, v in days.items() if -14 <= (d - date).days <= -1]
        post = [v for d, v in days.items() if 0 <= (d - date).days <= 7]
        want = 0.0
        if len(pre) >= 2 and post:
            for c in (1, 2):
                a, b = [v[c] for v in pre if v[c] is not None], mean([v[c] for v in post])
                if len(a) > 1 and b is not None:
                    want += max(0.0, (b - mean(a)) / (statistics.stdev(a) + 1e-6))
        assert got[title] == pytest.approx(want), title


def test_suggestions_fall_back_to_the_first_by_date(spark):
    schema = "title string, event_date date, lift double"
    flat = [(f"e{i}", START + i * DAY, 0.0) for i in range(5)]
    df = spark.createDataFrame(flat, schema)
    assert [r.title for r in E.suggest_events(df).collect()] == ["e0", "e1", "e2"]
    one = spark.createDataFrame(flat[:4] + [("late", START + 9 * DAY, 2.0)], schema)
    assert [r.title for r in E.suggest_events(one).collect()] == ["late"]


def test_nearest_event_both_sides_and_ties(spark):
    events = spark.createDataFrame(
        [(START, "a"), (START + 10 * DAY, "b"), (START + 100 * DAY, "c")], "date date, title string"
    )
    periods = spark.createDataFrame(
        [(START + 4 * DAY,), (START + 5 * DAY,), (START + 6 * DAY,), (START + 54 * DAY,),
         (START + 145 * DAY,), (START + 146 * DAY,)], "period date"
    )
    rows = E.nearest_event(periods, events).orderBy("period").collect()
    assert [r.nearest_event for r in rows] == ["a", "a", "b", "b", "c", ""]


def test_spikes_need_spread_and_points(spark):
    rows = [("x", 1.0)] * 9 + [("x", 10.0)] + [("flat", 5.0)] * 4 + [("two", 1.0), ("two", 9.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = E.detect_spikes(df, "v", by="g", min_points=3).collect()
    assert [(r.g, r.v) for r in found] == [("x", 10.0)]
    assert E.detect_spikes(df.where("g = 'flat'"), "v").isEmpty()
    assert E.detect_spikes(df.limit(1), "v").isEmpty()


def test_weeks_start_on_monday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 23),), (dt.datetime(2024, 3, 11),)], "d timestamp")
    rows = [r[0] for r in df.select(E.period_of(F.col("d"), "Week")).collect()]
    assert rows == [dt.date(2024, 3, 4), dt.date(2024, 3, 11)]


def test_peak_prefers_the_earliest_of_equals(spark):
    df = spark.createDataFrame(
        [("e", START, -1, 0.5, 2), ("e", START, 2, -0.5, 3), ("e", START, 3, None, 1),
         ("n", START, 0, None, 7)],
        "event_title string, event_date date, day_offset int, m_deviation double, n_posts int",
    )
    rows = E.peak_deviation(df, "m", scale=100).collect()
    assert [(r.event_title, r.peak_day_offset, r.peak_deviation, r.posts_in_window) for r in rows] == [
        ("e", -1, 50.0, 6)]


def test_event_window_sample_caps_and_dedups(spark):
    def stamp(day, second=0):
        return int(dt.datetime.combine(START + day * DAY, dt.time(), dt.timezone.utc).timestamp()) + second

    rows = [(i, f"post {i}", "europe", "reddit", stamp(1, i)) for i in range(1, 8)]
    rows += [(20, "post 3", "europe", "reddit", stamp(1, 3)), (21, "  ", "europe", "reddit", stamp(1)),
             (22, "zero", "europe", "reddit", 0), (23, "other board", "x", "reddit", stamp(1)),
             (24, "too late", "europe", "reddit", stamp(31, 1)), (25, "last moment", "europe", "reddit", stamp(30))]
    posts = spark.createDataFrame(rows, "post_id long, text string, subreddit string, source string, created_utc long")
    events = spark.createDataFrame(
        [(START, "now", "c", "x"), (START + 2 * DAY, "soon", "c", "x"), (dt.date(2019, 1, 1), "old", "c", "x")],
        "date date, title string, category string, country string",
    )
    got = E.event_window_sample(posts, events, per_window=4, years=(2024, 2024)).collect()
    assert sorted((r.post_id, r.title) for r in got) == [(1, "now"), (2, "now"), (3, "now")]
    wide = E.event_window_sample(posts, events, per_window=50, years=(2024, 2024)).collect()
    assert sorted(r.post_id for r in wide) == [1, 2, 3, 4, 5, 6, 7, 24, 25]


def test_patch_dates_with_a_hot_key(spark):
    """Two thirds of the posts start alike; each still gets exactly one date."""
    rows = [(i, "Same Start" if i % 3 else f"text {i}", "reddit" if i % 5 else "other") for i in range(3000)]
    posts = spark.createDataFrame(rows, "post_id long, text string, source string")
    dump = spark.createDataFrame(
        [("same", "start", "politics", "86400", 1), ("same", "start", "politics", "172800", 2),
         ("text 3", None, "politics", "bad", 3), ("text 6", None, "politics", "86400", 4),
         ("text 9", None, "cats", "86400", 5)],
        "title string, selftext string, subreddit string, created_utc string, ord int",
    )
    lookup = E.date_lookup(dump, ["politics"])
    patched = E.patch_dates(posts, lookup)
    report = E.date_match_report(patched.withColumn("dataset", F.lit("d"))).first()
    dated = sum(s == "reddit" and t in ("Same Start", "text 6") for _, t, s in rows)
    assert (report.n_matched, report.n_posts) == (dated, sum(s == "reddit" for *_, s in rows))
    got = {r.post_id: r.post_date for r in patched.collect()}
    assert len(got) == 3000
    for i, text, source in rows:
        want = None
        if source == "reddit":
            want = {"Same Start": dt.datetime(1970, 1, 3), "text 6": dt.datetime(1970, 1, 2)}.get(text)
        assert got[i] == want, (i, text, source)
