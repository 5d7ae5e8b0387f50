"""Time questions: timelines, spikes, nearest events, event studies.

Posts are first reduced to one row per period or day. Event windows become rows
(one per event and day), so every range join is an equi-join on the day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discourse_spark.fixed_values import (
    EVENT_MIN_POSTS,
    EVENT_SUBREDDITS,
    EVENT_WINDOW_DAYS,
    NEAREST_EVENT_DAYS,
    SPIKE_SIGMAS,
)
from discourse_spark.functions.text import dataset_short_name
from discourse_spark.operators.analytics import all_groups, percent, rows, texts
from discourse_spark.operators.normalize import merge_title_body
from discourse_spark.operators.skew import salted_join

EVENT = ["title", "event_date"]


def period_of(date: Column, granularity: str) -> Column:
    """First day of the Day, Week (from Monday) or Month."""
    return F.date_trunc(granularity.lower(), date).cast("date")


def timeline(posts: DataFrame, granularity: str = "Month", date_col: str = "post_date") -> DataFrame:
    dated = posts.where(F.col(date_col).isNotNull())
    return dated.groupBy(period_of(F.col(date_col), granularity).alias("period"), "dataset").agg(
        texts(posts).alias("posts"),
        F.avg("othering_predicted").alias("othering_rate"),
        F.avg("toxicity").alias("toxicity_mean"),
    )


def monthly_metric(dated: DataFrame, flag: str = "has_othering") -> DataFrame:
    """Per ``year_month``: mean toxicity and divisive share in percent."""
    return dated.groupBy("year_month").agg(
        F.avg("toxicity").alias("toxicity"), percent(F.col(flag)).alias("othering_rate")
    )


def detect_spikes(series: DataFrame, metric: str, by: str | None = None,
                  sigmas: float = SPIKE_SIGMAS, min_points: int = 1) -> DataFrame:
    """Periods strictly above mean + ``sigmas`` sample deviations of their series.

    ``series`` has one row per period (and ``by`` group). A constant series, or
    one of a single point, has no spikes.
    """
    window = Window.partitionBy(by) if by else all_groups()
    value = F.col(metric)
    return (
        series.withColumns(
            {
                "series_mean": F.avg(value).over(window),
                "series_std": F.stddev_samp(value).over(window),
                "series_points": F.count(value).over(window),
            }
        )
        .where(F.col("series_points") >= min_points)
        .where(F.col("series_std") != 0)
        .where(value > F.col("series_mean") + sigmas * F.col("series_std"))
        .drop("series_std", "series_points")
    )


def dataset_spikes(posts: DataFrame, granularity: str = "Month") -> DataFrame:
    """Spikes of the divisive share per dataset, with the excess over its mean."""
    series = timeline(posts, granularity).withColumns(
        {
            "short": dataset_short_name(F.col("dataset")),
            "othering_pct": F.col("othering_rate") * 100,
        }
    )
    spikes = detect_spikes(series, "othering_pct", by="short", min_points=3)
    return spikes.select(
        "period", F.col("short").alias("dataset"), "posts", "othering_pct",
        (F.col("othering_pct") - F.col("series_mean")).alias("excess_pp"),
    )


def event_days(events: DataFrame, before: int, after: int) -> DataFrame:
    """One row per event and day of its window: ``day`` and ``day_offset``."""
    dated = events.withColumnRenamed("date", "event_date").where(F.col("event_date").isNotNull())
    offsets = F.explode(F.sequence(F.lit(-before), F.lit(after)))
    return dated.withColumn("day_offset", offsets).withColumn(
        "day", F.date_add("event_date", F.col("day_offset"))
    )


def nearest_event(periods: DataFrame, events: DataFrame, date_col: str = "period",
                  days: int = NEAREST_EVENT_DAYS) -> DataFrame:
    """Add the title of the closest event within ``days``; empty when there is none.

    The candidates are reduced to one title per day before the join, so the
    result keeps exactly the rows of ``periods``.
    """
    closest = event_days(events, days, days).groupBy("day").agg(
        F.min_by("title", F.struct(F.abs("day_offset"), "event_date", "title")).alias(
            "nearest_event"
        )
    )
    return periods.join(closest, F.col(date_col) == F.col("day"), "left").drop("day").fillna(
        "", ["nearest_event"]
    )


def emotion_timeline(posts: DataFrame, granularity: str = "Month", top: int = 8) -> DataFrame:
    """Share of the top emotions among all labelled posts of the period."""
    counts = (
        posts.where(F.col("post_date").isNotNull() & F.col("emotion").isNotNull())
        .groupBy(period_of(F.col("post_date"), granularity).alias("period"), "emotion")
        .agg(rows().alias("n"))
    )
    shares = counts.withColumn("total", F.sum("n").over(Window.partitionBy("period")))
    leading = (
        counts.groupBy("emotion").agg(F.sum("n").alias("overall"))
        .orderBy(F.desc("overall"), "emotion").limit(top)
    )
    return shares.join(leading, "emotion", "left_semi").withColumn(
        "pct", F.col("n") * 100.0 / F.col("total")
    )


def daily_metrics(posts: DataFrame, metrics: Sequence[str], date_col: str = "post_date") -> DataFrame:
    day = F.to_date(date_col).alias("day")
    return posts.where(F.col(date_col).isNotNull()).groupBy(day).agg(
        rows().alias("n_posts"), *[F.avg(m).alias(m) for m in metrics]
    )


def event_study(posts: DataFrame, events: DataFrame, window_days: int = EVENT_WINDOW_DAYS,
                metrics: Sequence[str] = ("othering_predicted", "toxicity"),
                date_col: str = "post_date") -> DataFrame:
    """Daily metrics around each event and their deviation from the pre-event days.

    The baseline is the mean over the days before the event, each day weighing
    one; without a value there, the mean over the window. Events with fewer than
    five posts in the window are left out.
    """
    joined = daily_metrics(posts, metrics, date_col).join(
        event_days(events, window_days, window_days), "day"
    )
    window = Window.partitionBy(*EVENT)
    enough = joined.withColumn("_posts", F.sum("n_posts").over(window)).where(
        F.col("_posts") >= EVENT_MIN_POSTS
    )
    deviations = {}
    for metric in metrics:
        before = F.avg(F.when(F.col("day_offset") < 0, F.col(metric))).over(window)
        baseline = F.coalesce(before, F.avg(metric).over(window))
        deviations[f"{metric}_deviation"] = F.col(metric) - baseline
    return enough.withColumns(deviations).select(
        "day", "n_posts", *metrics, "day_offset", F.col("title").alias("event_title"),
        "event_date", F.col("category").alias("event_category"),
        F.col("country").alias("event_country"), *deviations,
    )


def event_lift(posts: DataFrame, events: DataFrame, window_days: int = EVENT_WINDOW_DAYS,
               metrics: Sequence[str] = ("othering_predicted", "toxicity")) -> DataFrame:
    """Score of each event: how far the week after it rises above the days before."""
    pre = F.col("day_offset") < 0
    post = F.col("day_offset") >= 0
    found = F.col("n_posts").isNotNull()
    aggregates = [F.count_if(pre & found).alias("pre_days"), F.count_if(post & found).alias("post_days")]
    lift = F.lit(0.0)
    for m in metrics:
        aggregates += [
            F.avg(F.when(pre, F.col(m))).alias(f"{m}_pre"),
            F.avg(F.when(post, F.col(m))).alias(f"{m}_post"),
            F.stddev_samp(F.when(pre, F.col(m))).alias(f"{m}_std"),
        ]
        rise = (F.col(f"{m}_post") - F.col(f"{m}_pre")) / (F.col(f"{m}_std") + 1e-6)
        lift = lift + F.greatest(F.lit(0.0), rise)
    days = event_days(events, window_days, 7).join(daily_metrics(posts, metrics), "day", "left")
    usable = (F.col("pre_days") >= 2) & (F.col("post_days") >= 1)
    return (
        days.groupBy(*EVENT).agg(*aggregates)
        .select(*EVENT, F.when(usable, lift).otherwise(F.lit(0.0)).alias("lift"))
    )


def suggest_events(lifts: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` events with the highest positive lift; without any, the first by date."""
    best = F.max("lift").over(all_groups())
    ranked = lifts.withColumn("_best", best).orderBy(
        F.when(F.col("_best") > 0, -F.col("lift")).otherwise(F.lit(0.0)), "event_date", "title"
    )
    return ranked.limit(n).where((F.col("lift") > 0) | (F.col("_best") <= 0)).drop("_best")


def emotion_indicator(name: str) -> Column:
    """1.0 / 0.0, null for unlabelled posts."""
    return F.when(F.col("emotion").isNotNull(), (F.col("emotion") == name).cast("double"))


def peak_deviation(study: DataFrame, metric: str, scale: float = 1.0) -> DataFrame:
    """Per event: the day with the largest absolute deviation, earliest on ties."""
    deviation = F.col(f"{metric}_deviation") * scale
    size = F.when(deviation.isNotNull(), F.struct(F.abs(deviation), -F.col("day_offset")))
    return (
        study.groupBy("event_title", "event_date")
        .agg(
            F.max_by("day_offset", size).alias("peak_day_offset"),
            F.max_by(deviation, size).alias("peak_deviation"),
            F.sum("n_posts").alias("posts_in_window"),
        )
        .where(F.col("peak_deviation").isNotNull())
    )


def date_coverage(posts: DataFrame, date_col: str = "post_date") -> DataFrame:
    return posts.where(F.col(date_col).isNotNull()).agg(
        rows().alias("n_dated"),
        F.to_date(F.min(date_col)).alias("first_date"),
        F.to_date(F.max(date_col)).alias("last_date"),
        F.countDistinct("dataset").alias("n_datasets"),
    )


def events_in_range(events: DataFrame, posts: DataFrame, date_col: str = "post_date") -> DataFrame:
    """Events inside the data's date range, whose ends are two scalar subqueries."""
    first = posts.agg(F.to_date(F.min(date_col))).scalar()
    last = posts.agg(F.to_date(F.max(date_col))).scalar()
    return events.where(F.col("date").between(first, last))


def event_window_sample(posts: DataFrame, events: DataFrame, days: int = 30, per_window: int = 50,
                        subreddits: Sequence[str] = EVENT_SUBREDDITS, years=(2020, 2023),
                        id_col: str = "post_id", prefix: int | None = None) -> DataFrame:
    """The earliest posts of each board in each event's window, without repeats.

    The rank limit is a literal, so Spark trims every group before the shuffle.
    Posts repeat when text and time agree, with ``prefix`` the start of the text; the
    copy of the earliest event stays.
    """
    kept = posts.where(
        F.col("subreddit").isin(list(subreddits))
        & (F.length(F.trim("text")) > 0)
        & F.col("created_utc").isNotNull() & (F.col("created_utc") != 0)
    ).withColumn("day", F.to_date(F.timestamp_seconds("created_utc")))
    chosen = events.where(F.year("date").between(*years))
    in_window = kept.join(event_days(chosen, days, days), "day").where(
        F.timestamp_seconds("created_utc") <= F.date_add("event_date", days).cast("timestamp")
    )
    per_board = Window.partitionBy(*EVENT, "subreddit").orderBy("created_utc", id_col)
    capped = in_window.withColumn("_rank", F.row_number().over(per_board)).where(
        F.col("_rank") <= per_window
    )
    same = F.col("text") if prefix is None else F.substring("text", 1, prefix)
    copies = Window.partitionBy(same, "created_utc").orderBy(
        "event_date", "title", id_col
    )
    return (
        capped.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") == 1)
        .withColumn("post_date", F.timestamp_seconds("created_utc"))
        .drop("_rank", "_copy", "day", "day_offset", "created_utc")
    )


def _date_key(text: Column, prefix: int | None) -> Column:
    """The text in lower case, with ``prefix`` only its start."""
    text = F.lower(F.trim(text))
    return text if prefix is None else F.substring(text, 1, prefix)


def date_lookup(forum: DataFrame, subreddits: Sequence[str], prefix: int | None = None) -> DataFrame:
    """``key -> post_date`` from a raw forum dump; the latest row of a key wins."""
    text = merge_title_body(F.col("title"), F.col("selftext"))
    epoch = F.col("created_utc").try_cast("double")
    return (
        forum.where(F.col("subreddit").isin(list(subreddits)) & epoch.isNotNull())
        .groupBy(_date_key(text, prefix).alias("date_key"))
        .agg(F.max_by(F.timestamp_seconds(epoch), "ord").alias("found_date"))
    )


def patch_dates(posts: DataFrame, lookup: DataFrame, source: str = "reddit", prefix: int | None = None,
                id_col: str = "post_id") -> DataFrame:
    """Set post_date of one source's posts from ``lookup`` by their text, or its start.

    Only that source is joined. Short or empty texts share keys, so the join
    splits frequent ones.
    """
    if "post_date" not in posts.columns:
        posts = posts.withColumn("post_date", F.lit(None).cast("timestamp"))
    of_source = F.coalesce(F.col("source") == source, F.lit(False))
    keyed = posts.where(of_source).withColumn("date_key", _date_key(F.col("text"), prefix))
    patched = salted_join(keyed, lookup, "date_key", "left", spread_by=id_col).withColumn(
        "post_date", F.col("found_date")
    )
    return posts.where(~of_source).unionByName(patched.select(*posts.columns))


def date_match_report(patched: DataFrame, source: str = "reddit") -> DataFrame:
    """Per dataset: how many of the source's posts ``patch_dates`` gave a date, of how many."""
    matched, total = F.count("post_date"), F.count(F.lit(1))
    return patched.where(F.col("source") == source).groupBy("dataset").agg(
        matched.alias("n_matched"), total.alias("n_posts"), (100.0 * matched / total).alias("matched_pct")
    )
