"""Queries over corpus rates, shares, pivots and rankings."""

from pyspark.sql import functions as F

from discourse_spark.functions import text as X
from discourse_spark.operators import analytics as A
from discourse_spark.operators.enrich import enrich_base
from discourse_spark.plans import sql as S
from discourse_spark.plans.corpus import facts, posts
from discourse_spark.plans.registry import query

OTHERING_PCT = "round(avg(othering_predicted) * 100, 6) AS othering_pct"
MODE = """(SELECT emotion FROM facts WHERE emotion IS NOT NULL GROUP BY emotion
  ORDER BY count(*) DESC, emotion LIMIT 1)"""


@query(S.with_facts(f"""SELECT count(*) AS total, {OTHERING_PCT},
  round(avg((toxicity > 0.5)::DOUBLE) * 100, 6) AS high_toxicity_pct,
  count(DISTINCT dataset) AS n_datasets, {MODE} AS top_emotion FROM facts"""))
def overview_kpis(spark, sf_dir):
    return A.overview_kpis(facts(spark, sf_dir))


@query(S.with_facts(f"""SELECT dataset, {S.short('dataset')} AS short, count(*) AS n, {OTHERING_PCT},
  round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM facts GROUP BY dataset"""))
def dataset_counts(spark, sf_dir):
    return A.dataset_counts(facts(spark, sf_dir))


@query(S.with_facts(f"""SELECT pronoun_type, count(*) AS n,
  CAST(sum(othering_predicted) AS BIGINT) AS n_othering, {OTHERING_PCT},
  round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct_posts
FROM facts WHERE pronoun_type NOT IN ('unknown', 'none', '') GROUP BY pronoun_type"""))
def pronoun_vs_othering(spark, sf_dir):
    return A.pronoun_vs_othering(facts(spark, sf_dir))


@query(S.with_facts(f"""SELECT dataset, {S.short('dataset')} AS short,
  CAST(sum(othering_predicted) AS BIGINT) AS othering, count(*) AS total,
  round(sum(othering_predicted) * 100.0 / count(*), 6) AS pct,
  round((SELECT sum(othering_predicted) * 100.0 / count(*) FROM facts), 6) AS global_pct
FROM facts GROUP BY dataset"""))
def othering_rate_by_dataset(spark, sf_dir):
    return A.othering_rate_by_dataset(facts(spark, sf_dir))


@query(S.with_posts("""SELECT count(*) AS n_scored, round(avg(toxicity), 6) AS mean,
  round(avg((toxicity > 0.5)::DOUBLE) * 100, 6) AS high_pct, max(toxicity) AS max,
  round(median(toxicity), 6) AS median FROM posts WHERE toxicity IS NOT NULL"""))
def toxicity_kpis(spark, sf_dir):
    return A.toxicity_kpis(facts(spark, sf_dir))


@query("SELECT round(median(o_totalprice), 6) AS median FROM orders")
def exact_median(spark, sf_dir):
    """The median operator on a column with many distinct values."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return A.exact_median(orders, "o_totalprice", 0.0, 1000000.0)


@query(S.with_facts("""SELECT post_id, toxicity, othering_score, othering_predicted FROM facts
WHERE toxicity IS NOT NULL ORDER BY (post_id * 7919 + 13) % 10007, post_id LIMIT 400"""))
def toxicity_by_score(spark, sf_dir):
    key = (F.col("post_id") * 7919 + 13) % 10007
    return A.toxicity_by_score(facts(spark, sf_dir), 400, key=key, key_space=10007)


@query(S.with_facts(f"""SELECT post_id, toxicity, othering_predicted, {S.short('dataset')} AS short,
  CASE WHEN toxicity > 0.7 THEN 'high' WHEN toxicity > 0.4 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN length(text) > 280 THEN substr(text, 1, 280) || '...' ELSE text END AS preview
FROM facts WHERE toxicity IS NOT NULL ORDER BY toxicity DESC, post_id LIMIT 10"""))
def most_toxic(spark, sf_dir):
    """Rank first, then analyse only the posts that are shown."""
    top = enrich_base(A.most_toxic(posts(spark, sf_dir), 10))
    return top.select(
        "post_id", "toxicity", "othering_predicted",
        X.dataset_short_name(F.col("dataset")).alias("short"),
        X.toxicity_band(F.col("toxicity")).alias("band"),
        X.truncate_text(F.col("text"), 280, ellipsis=True).alias("preview"),
    )


@query(S.with_posts(f"""SELECT emotion, count(*) AS n, {S.valence_of('emotion')} AS valence,
  round(count(*) * 100.0 / (SELECT count(emotion) FROM posts), 6) AS pct,
  round((SELECT count(emotion) * 100.0 / count(*) FROM posts), 6) AS coverage_pct
FROM posts WHERE emotion IS NOT NULL GROUP BY emotion"""))
def emotion_distribution(spark, sf_dir):
    return A.emotion_distribution(facts(spark, sf_dir))


@query(S.with_facts("""sides AS (SELECT emotion, count(*) FILTER (WHERE othering_predicted = 1) AS a,
  count(*) FILTER (WHERE othering_predicted = 0) AS b FROM facts WHERE emotion IS NOT NULL GROUP BY 1),
shares AS (SELECT emotion, a * 100.0 / sum(a) OVER () AS x, b * 100.0 / sum(b) OVER () AS y FROM sides)
SELECT emotion, round(x, 6) AS othering, round(y, 6) AS non_othering, round(x - y, 6) AS delta
FROM shares"""))
def emotion_delta(spark, sf_dir):
    return A.emotion_delta(facts(spark, sf_dir))


_EMOTION_SHARES = f"""counts AS (SELECT dataset, emotion, count(*) AS n FROM facts
  WHERE emotion IS NOT NULL GROUP BY ALL),
shares AS (SELECT *, n * 100.0 / sum(n) OVER (PARTITION BY dataset) AS pct FROM counts),
leading_ AS (SELECT emotion FROM counts GROUP BY 1 ORDER BY sum(n) DESC, emotion LIMIT 4),
cells AS (SELECT emotion, {S.short('dataset')} AS short, avg(pct) AS pct FROM shares
  WHERE emotion IN (SELECT emotion FROM leading_) GROUP BY ALL)"""


@query(S.with_facts(f"{_EMOTION_SHARES} SELECT emotion, short, round(pct, 6) AS pct FROM cells"))
def emotion_by_dataset(spark, sf_dir):
    return A.emotion_by_dataset(facts(spark, sf_dir), top=4)


@query(S.with_facts(f"""{_EMOTION_SHARES} SELECT emotion,
  round(coalesce(max(pct) FILTER (WHERE short = 'tw_a'), 0), 6) AS tw_a,
  round(coalesce(max(pct) FILTER (WHERE short = 'tk_b'), 0), 6) AS tk_b,
  round(coalesce(max(pct) FILTER (WHERE short = 'ig_c'), 0), 6) AS ig_c,
  round(coalesce(max(pct) FILTER (WHERE short = 'dataset_final'), 0), 6) AS dataset_final FROM cells GROUP BY emotion"""))
def emotion_heatmap(spark, sf_dir):
    return A.emotion_heatmap(facts(spark, sf_dir), top=4)


@query(S.with_facts(f"""SELECT CAST(sum(othering_predicted) AS BIGINT) AS n_othering, {OTHERING_PCT},
  round(avg(othering_score), 6) AS mean_score,
  round(avg((pronoun_type = 'both')::DOUBLE) * 100, 6) AS both_pct FROM facts"""))
def othering_kpis(spark, sf_dir):
    return A.othering_kpis(facts(spark, sf_dir))


@query(S.with_facts(f"""SELECT {S.short('dataset')} AS short,
  round(coalesce(avg(othering_predicted) FILTER (WHERE pronoun_type = 'we_only') * 100, 0), 6) AS we_only,
  round(coalesce(avg(othering_predicted) FILTER (WHERE pronoun_type = 'them_only') * 100, 0), 6) AS them_only,
  round(coalesce(avg(othering_predicted) FILTER (WHERE pronoun_type = 'both') * 100, 0), 6) AS both
FROM facts WHERE pronoun_type IN ('we_only', 'them_only', 'both') GROUP BY 1"""))
def pronoun_dataset_pivot(spark, sf_dir):
    return A.pronoun_dataset_pivot(facts(spark, sf_dir))


@query(S.with_facts(f"""divisive AS (SELECT post_id, {S.short('dataset')} AS dataset, matched FROM facts
  WHERE othering_predicted = 1),
totals AS (SELECT dataset, count(*) AS n FROM divisive GROUP BY 1),
pairs AS (SELECT post_id, dataset, unnest(matched) AS pattern FROM divisive),
families AS (SELECT DISTINCT post_id, dataset, {S.family_of('pattern')} AS family FROM pairs)
SELECT dataset, family, round(count(*) * 100.0 / any_value(n), 6) AS pct
FROM families JOIN totals USING (dataset) GROUP BY dataset, family"""))
def family_share_by_dataset(spark, sf_dir):
    return A.family_share_by_dataset(facts(spark, sf_dir))


@query(S.with_facts("""pairs AS (SELECT post_id, unnest(matched) AS p FROM facts
  WHERE othering_predicted = 1)
SELECT x.p AS a, y.p AS b, count(*) AS n FROM pairs x JOIN pairs y USING (post_id)
WHERE x.p <> y.p GROUP BY ALL"""))
def pattern_cooccurrence(spark, sf_dir):
    return A.pattern_cooccurrence(facts(spark, sf_dir))


@query(S.with_facts("""labels_ AS (SELECT unnest(matched) AS pattern FROM facts)
SELECT pattern, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM facts), 6) AS pct_posts
FROM labels_ GROUP BY pattern ORDER BY n DESC, pattern LIMIT 15"""))
def pattern_counts(spark, sf_dir):
    return A.pattern_counts(facts(spark, sf_dir), 15)


@query(S.with_facts("SELECT othering_score, count(*) AS n FROM facts GROUP BY 1"))
def score_distribution(spark, sf_dir):
    return A.score_distribution(facts(spark, sf_dir))


@query(S.with_facts("""SELECT 'source' AS level, source AS value, count(*) AS n,
  round(avg(has_othering::INT) * 100, 6) AS othering_pct FROM facts GROUP BY source
UNION ALL SELECT 'subreddit', subreddit, count(*), round(avg(has_othering::INT) * 100, 6)
FROM facts WHERE source = 'reddit' GROUP BY subreddit"""))
def rate_by_group(spark, sf_dir):
    return A.rate_by_group(facts(spark, sf_dir))


@query(S.with_facts("""counts AS (SELECT has_othering, emotion, count(*) AS n FROM facts
  WHERE emotion IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY has_othering ORDER BY n DESC, emotion) AS rank
  FROM counts) SELECT * FROM ranked WHERE rank <= 5"""))
def top_emotions_by_class(spark, sf_dir):
    return A.top_emotions_by_class(facts(spark, sf_dir))


@query(S.with_facts("""SELECT has_othering, round(avg(toxicity), 6) AS mean_toxicity FROM facts
GROUP BY 1"""))
def toxicity_by_class(spark, sf_dir):
    return A.toxicity_by_class(facts(spark, sf_dir))


@query(S.with_facts("""forum AS (SELECT * FROM facts WHERE source = 'reddit'),
e AS (SELECT subreddit, emotion, row_number() OVER (PARTITION BY subreddit
    ORDER BY count(*) DESC, emotion) AS k FROM forum WHERE emotion IS NOT NULL GROUP BY subreddit, emotion),
labels_ AS (SELECT subreddit, unnest(matched) AS pattern FROM forum),
p AS (SELECT subreddit, pattern, row_number() OVER (PARTITION BY subreddit
    ORDER BY count(*) DESC, pattern) AS k FROM labels_ GROUP BY subreddit, pattern)
SELECT f.subreddit, count(*) AS n_posts, round(avg(toxicity), 6) AS avg_toxicity,
  round(avg(has_othering::INT) * 100, 6) AS othering_rate_pct,
  coalesce(any_value(e.emotion), 'N/A') AS top_emotion,
  coalesce(any_value(p.pattern), 'N/A') AS top_pattern
FROM forum f LEFT JOIN e ON e.subreddit = f.subreddit AND e.k = 1
LEFT JOIN p ON p.subreddit = f.subreddit AND p.k = 1 GROUP BY f.subreddit"""))
def platform_comparison(spark, sf_dir):
    return A.platform_comparison(facts(spark, sf_dir))


@query(S.with_facts("""SELECT count(*) AS n_posts, round(avg(has_we::INT) * 100, 6) AS we_pct,
  round(avg(has_them::INT) * 100, 6) AS them_pct,
  round(avg((pronoun_type = 'both')::INT) * 100, 6) AS both_pct,
  round(avg(toxicity), 6) AS mean_toxicity, count(toxicity) AS n_scored FROM facts"""))
def enrichment_summary(spark, sf_dir):
    return A.enrichment_summary(facts(spark, sf_dir))


@query(S.with_posts("""SELECT emotion, count(*) AS n FROM posts WHERE emotion IS NOT NULL
GROUP BY 1 ORDER BY n DESC, emotion LIMIT 5"""))
def top_emotions(spark, sf_dir):
    return A.top_emotions(facts(spark, sf_dir))


@query(S.with_facts("""SELECT post_id, othering_score, toxicity, array_to_string(matched, ',') AS
  matched_patterns, (SELECT count(*) FROM facts WHERE othering_score BETWEEN 2 AND 4
  AND othering_predicted = 1) AS n_match
FROM facts WHERE othering_score BETWEEN 2 AND 4 AND othering_predicted = 1
ORDER BY post_id LIMIT 10"""))
def filter_examples(spark, sf_dir):
    return A.filter_examples(facts(spark, sf_dir), 2, 4).select(
        "post_id", "othering_score", "toxicity", "matched_patterns", "n_match"
    )


@query(S.with_facts(f"""SELECT count(*) AS n_rows, {OTHERING_PCT},
  round(avg(toxicity), 6) AS mean_toxicity,
  round(avg((pronoun_type IN ('them_only', 'both'))::INT) * 100, 6) AS them_pct FROM facts"""))
def upload_summary(spark, sf_dir):
    return A.upload_summary(facts(spark, sf_dir))
