"""Queries over time: timelines, spikes, nearest events, event studies."""

from pyspark.sql import functions as F

from discourse_spark.operators import temporal as E
from discourse_spark.operators.normalize import epoch_to_date
from discourse_spark.plans import sql as S
from discourse_spark.plans.corpus import calendar, facts, posts, table
from discourse_spark.plans.registry import query


def _timeline_sql(unit):
    return S.with_facts(f"""SELECT strftime(date_trunc('{unit}', post_date), '%Y-%m-%d') AS period,
  dataset, count(*) AS posts, round(avg(othering_predicted), 6) AS othering_rate,
  round(avg(toxicity), 6) AS toxicity_mean FROM facts GROUP BY ALL""")


@query(_timeline_sql("month"))
def timeline_month(spark, sf_dir):
    return E.timeline(facts(spark, sf_dir), "Month")


@query(_timeline_sql("week"))
def timeline_week(spark, sf_dir):
    return E.timeline(facts(spark, sf_dir), "Week")


@query(_timeline_sql("day"))
def timeline_day(spark, sf_dir):
    return E.timeline(facts(spark, sf_dir), "Day")


_MONTHLY = """monthly AS (SELECT strftime(make_timestamp(created_utc * 1000000), '%Y-%m') AS year_month,
  avg(toxicity) AS toxicity, avg(has_othering::INT) * 100 AS othering_rate FROM facts
  WHERE created_utc <> 0 GROUP BY 1)"""


@query(S.with_facts(f"""{_MONTHLY} SELECT year_month, round(toxicity, 6) AS toxicity,
  round(othering_rate, 6) AS othering_rate FROM monthly"""))
def monthly_metric(spark, sf_dir):
    return E.monthly_metric(epoch_to_date(facts(spark, sf_dir)))


@query("""WITH monthly AS (SELECT strftime(o_orderdate, '%Y-%m') AS year_month,
  avg(o_totalprice) AS toxicity FROM orders GROUP BY 1),
stats AS (SELECT *, avg(toxicity) OVER () AS m, stddev_samp(toxicity) OVER () AS s FROM monthly)
SELECT year_month, round(toxicity, 6) AS toxicity, round(m, 6) AS series_mean FROM stats
WHERE toxicity > m + 1.5 * s""")
def detect_spikes(spark, sf_dir):
    """A long monthly series: order values stand in for scores."""
    monthly = table(spark, sf_dir, "orders").groupBy(
        F.date_format("o_orderdate", "yyyy-MM").alias("year_month")
    ).agg(F.avg("o_totalprice").alias("toxicity"))
    return E.detect_spikes(monthly, "toxicity")


_SPIKES = f"""series AS (SELECT date_trunc('week', post_date)::DATE AS period,
  {S.short('dataset')} AS dataset, count(*) AS posts, avg(othering_predicted) * 100 AS v
  FROM facts GROUP BY ALL),
stats AS (SELECT *, avg(v) OVER w AS m, stddev_samp(v) OVER w AS s, count(v) OVER w AS k FROM series
  WINDOW w AS (PARTITION BY dataset)),
spikes AS (SELECT * FROM stats WHERE k >= 3 AND s <> 0 AND v > m + 1.5 * s)"""


@query(S.with_facts(f"""{_SPIKES} SELECT strftime(period, '%Y-%m-%d') AS period, dataset, posts,
  round(v, 6) AS othering_pct, round(v - m, 6) AS excess_pp FROM spikes"""))
def dataset_spikes(spark, sf_dir):
    return E.dataset_spikes(facts(spark, sf_dir), "Week")


@query(S.with_facts(f"""{_SPIKES}, near AS (SELECT s.*, c.title, row_number() OVER (
    PARTITION BY period, dataset ORDER BY abs(date_diff('day', period, c.date)), c.date, c.title) AS r
  FROM spikes s LEFT JOIN calendar c ON abs(date_diff('day', period, c.date)) <= 45)
SELECT strftime(period, '%Y-%m-%d') AS period, dataset, posts, round(v, 6) AS othering_pct,
  round(v - m, 6) AS excess_pp, coalesce(title, '') AS nearest_event FROM near WHERE r = 1"""))
def nearest_event(spark, sf_dir):
    return E.nearest_event(E.dataset_spikes(facts(spark, sf_dir), "Week"), calendar(spark))


@query(S.with_facts("""days_ AS (SELECT DISTINCT post_date AS day FROM facts),
near AS (SELECT day, title, row_number() OVER (PARTITION BY day
    ORDER BY abs(date_diff('day', day, c.date)), c.date, title) AS r
  FROM days_ LEFT JOIN calendar c ON abs(date_diff('day', day, c.date)) <= 9)
SELECT strftime(day, '%Y-%m-%d') AS post_day, coalesce(title, '') AS nearest_event FROM near WHERE r = 1"""))
def nearest_event_daily(spark, sf_dir):
    days = facts(spark, sf_dir).select(F.to_date("post_date").alias("post_day")).distinct()
    return E.nearest_event(days, calendar(spark), date_col="post_day", days=9)


@query(S.with_facts("""labelled AS (SELECT date_trunc('month', post_date)::DATE AS period, emotion
  FROM facts WHERE emotion IS NOT NULL),
leading_ AS (SELECT emotion FROM labelled GROUP BY 1 ORDER BY count(*) DESC, emotion LIMIT 4),
totals AS (SELECT period, count(*) AS total FROM labelled GROUP BY 1)
SELECT strftime(period, '%Y-%m-%d') AS period, emotion, count(*) AS n, any_value(total) AS total,
  round(count(*) * 100.0 / any_value(total), 6) AS pct FROM labelled JOIN totals USING (period)
WHERE emotion IN (SELECT emotion FROM leading_) GROUP BY period, emotion"""))
def emotion_timeline(spark, sf_dir):
    return E.emotion_timeline(facts(spark, sf_dir), "Month", top=4)


def _study(metrics: dict[str, str]) -> str:
    daily = ", ".join(f"avg({source}) AS {name}" for name, source in metrics.items())
    deviations = ", ".join(
        f"{m} - coalesce(avg({m}) FILTER (WHERE off < 0) OVER w, avg({m}) OVER w) AS {m}_deviation"
        for m in metrics
    )
    return f"""daily AS (SELECT post_date AS day, count(*) AS n_posts, {daily} FROM facts GROUP BY 1),
joined AS (SELECT d.*, date_diff('day', c.date, d.day) AS off, c.* FROM daily d JOIN calendar c
  ON d.day BETWEEN c.date - 14 AND c.date + 14),
study AS (SELECT *, sum(n_posts) OVER w AS window_posts, {deviations} FROM joined
  WINDOW w AS (PARTITION BY title, date)),
kept AS (SELECT * FROM study WHERE window_posts >= 5)"""


_METRICS = {"othering_predicted": "othering_predicted", "toxicity": "toxicity"}


@query(S.with_facts(f"""{_study(_METRICS)} SELECT strftime(day, '%Y-%m-%d') AS day, n_posts,
  round(othering_predicted, 6) AS othering_predicted, round(toxicity, 6) AS toxicity,
  CAST(off AS BIGINT) AS day_offset, title AS event_title, strftime(date, '%Y-%m-%d') AS event_date,
  category AS event_category, country AS event_country,
  round(othering_predicted_deviation, 6) AS othering_predicted_deviation,
  round(toxicity_deviation, 6) AS toxicity_deviation FROM kept"""))
def event_study(spark, sf_dir):
    return E.event_study(facts(spark, sf_dir), calendar(spark))


_ANGER = {"emo_anger": "CASE WHEN emotion IS NOT NULL THEN (emotion = 'anger')::INT END"}


@query(S.with_facts(f"""{_study(_ANGER)} SELECT title AS event_title,
  strftime(date, '%Y-%m-%d') AS event_date, CAST(off AS BIGINT) AS day_offset,
  round(emo_anger, 6) AS emo_anger, round(emo_anger_deviation, 6) AS emo_anger_deviation FROM kept"""))
def emotion_indicator(spark, sf_dir):
    """Event study of one emotion's share."""
    flagged = facts(spark, sf_dir).withColumn("emo_anger", E.emotion_indicator("anger"))
    study = E.event_study(flagged, calendar(spark), metrics=["emo_anger"])
    return study.select(
        "event_title", "event_date", "day_offset", "emo_anger", "emo_anger_deviation"
    )


@query(S.with_facts(f"""{_study(_METRICS)}, peaks AS (SELECT *, row_number() OVER (
    PARTITION BY title, date ORDER BY abs(toxicity_deviation) DESC, off) AS r FROM kept
  WHERE toxicity_deviation IS NOT NULL)
SELECT title AS event_title, strftime(date, '%Y-%m-%d') AS event_date,
  CAST(off AS BIGINT) AS peak_day_offset, round(toxicity_deviation, 6) AS peak_deviation,
  CAST(window_posts AS BIGINT) AS posts_in_window FROM peaks WHERE r = 1"""))
def peak_deviation(spark, sf_dir):
    return E.peak_deviation(E.event_study(facts(spark, sf_dir), calendar(spark)), "toxicity")


def _rise(metric):
    return f"""greatest(0, coalesce((avg({metric}) FILTER (WHERE off >= 0)
      - avg({metric}) FILTER (WHERE off < 0))
      / (stddev_samp({metric}) FILTER (WHERE off < 0) + 1e-6), 0))"""


_LIFT = f"""daily AS (SELECT post_date AS day, avg(othering_predicted) AS o, avg(toxicity) AS t
  FROM facts GROUP BY 1),
near AS (SELECT c.title, c.date, d.*, date_diff('day', c.date, d.day) AS off FROM calendar c
  LEFT JOIN daily d ON d.day BETWEEN c.date - 14 AND c.date + 7),
lifts AS (SELECT title, date, CASE WHEN count(*) FILTER (WHERE off < 0) >= 2
    AND count(*) FILTER (WHERE off >= 0) >= 1 THEN {_rise('o')} + {_rise('t')} ELSE 0 END AS lift
  FROM near GROUP BY ALL)"""


@query(S.with_facts(f"""{_LIFT} SELECT title, strftime(date, '%Y-%m-%d') AS event_date,
  round(lift::DOUBLE, 6) AS lift FROM lifts"""))
def event_lift_score(spark, sf_dir):
    return E.event_lift(facts(spark, sf_dir), calendar(spark))


@query(S.with_facts(f"""{_LIFT} SELECT title, strftime(date, '%Y-%m-%d') AS event_date,
  round(lift::DOUBLE, 6) AS lift FROM lifts WHERE lift > 0 ORDER BY lift DESC, date, title LIMIT 3"""))
def suggest_events(spark, sf_dir):
    return E.suggest_events(E.event_lift(facts(spark, sf_dir), calendar(spark)))


@query(S.with_facts("""SELECT count(*) AS n_dated, strftime(min(post_date), '%Y-%m-%d') AS first_date,
  strftime(max(post_date), '%Y-%m-%d') AS last_date, count(DISTINCT dataset) AS n_datasets FROM facts"""))
def date_coverage(spark, sf_dir):
    return E.date_coverage(facts(spark, sf_dir))


@query(S.with_facts("""SELECT strftime(date, '%Y-%m-%d') AS date, title, category, country FROM calendar
WHERE date BETWEEN (SELECT min(post_date) FROM facts) AND (SELECT max(post_date) FROM facts)"""))
def events_in_range(spark, sf_dir):
    return E.events_in_range(calendar(spark), facts(spark, sf_dir))


@query(S.with_facts("""stamped AS (SELECT post_id, text, subreddit, source, created_utc,
    make_timestamp(created_utc * 1000000) AS stamp FROM posts
  WHERE subreddit IN ('politics', 'europe', 'worldnews') AND created_utc <> 0 AND trim(text) <> ''),
ranked AS (SELECT s.*, c.title, c.date, row_number() OVER (PARTITION BY c.title, c.date, subreddit
    ORDER BY created_utc, post_id) AS r
  FROM stamped s JOIN calendar c ON stamp >= c.date - 30 AND stamp <= c.date + 30
  WHERE year(c.date) = 2024),
copies AS (SELECT *, row_number() OVER (PARTITION BY text, created_utc
    ORDER BY date, title, post_id) AS k FROM ranked WHERE r <= 20)
SELECT post_id, subreddit, source, title, strftime(date, '%Y-%m-%d') AS event_date,
  strftime(stamp, '%Y-%m-%d %H:%M:%S') AS post_date, CAST(length(text) AS BIGINT) AS n FROM copies WHERE k = 1"""))
def event_window_sample(spark, sf_dir):
    sample = E.event_window_sample(
        posts(spark, sf_dir), calendar(spark), per_window=20, years=(2024, 2024),
        subreddits=["politics", "europe", "worldnews"],
    )
    return sample.select(
        "post_id", "subreddit", "source", "title", "event_date", "post_date",
        F.length("text").alias("n"),
    )


_LOOKUP = """lookup AS (SELECT lower(trim(text)) AS k,
    arg_max(TIMESTAMP '2023-01-01' + to_days(CAST(post_id % 300 AS INT)), post_id) AS found
  FROM posts WHERE post_id % 2 = 0 GROUP BY 1)"""


def _patched(spark, sf_dir):
    """Half of the posts, as a raw forum dump, give dates to all with the same text."""
    target = posts(spark, sf_dir)
    dump = target.where(F.col("post_id") % 2 == 0).select(
        F.col("text").alias("title"), F.lit(None).cast("string").alias("selftext"),
        F.lit("politics").alias("subreddit"), F.col("post_id").alias("ord"),
        (F.unix_timestamp(F.lit("2023-01-01").cast("timestamp")) + F.col("post_id") % 300 * 86400)
        .cast("string").alias("created_utc"),
    )
    lookup = E.date_lookup(dump, ["politics"])
    return E.patch_dates(target, lookup)


@query(S.with_posts(f"""{_LOOKUP}
SELECT post_id, strftime(CASE WHEN source = 'reddit' THEN found ELSE post_date END,
  '%Y-%m-%d %H:%M:%S') AS post_date
FROM posts LEFT JOIN lookup ON k = lower(trim(text))"""))
def patch_dates(spark, sf_dir):
    return _patched(spark, sf_dir).select("post_id", "post_date")


@query(S.with_posts(f"""{_LOOKUP}
SELECT dataset, count(found) AS n_matched, count(*) AS n_posts,
  round(100.0 * count(found) / count(*), 6) AS matched_pct
FROM posts LEFT JOIN lookup ON k = lower(trim(text)) WHERE source = 'reddit' GROUP BY dataset"""))
def date_match_report(spark, sf_dir):
    return E.date_match_report(_patched(spark, sf_dir))
