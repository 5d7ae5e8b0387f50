"""Queries over cleaning, tagging, rule matching and schema normalisation."""

from pyspark.sql import functions as F

from discourse_spark.functions.rules import apply_othering as add_othering
from discourse_spark.functions.rules import match_patterns as matched_labels
from discourse_spark.functions.rules import pattern_family as family_of_label
from discourse_spark.functions import text as X
from discourse_spark.operators import enrich, normalize as N
from discourse_spark.plans import sql as S
from discourse_spark.plans.corpus import analysed, facts, posts, table
from discourse_spark.plans.registry import query


def cleaned(spark, sf_dir):
    return posts(spark, sf_dir).select("post_id", X.clean_text("text").alias("clean_text"))


@query(S.with_clean("SELECT post_id, clean_text FROM clean"))
def clean_text(spark, sf_dir):
    return cleaned(spark, sf_dir)


@query(f"SELECT page_id, {S.clean('html')} AS clean_html, {S.clean('url')} AS clean_url FROM pages")
def clean_text_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", X.clean_text("html").alias("clean_html"), X.clean_text("url").alias("clean_url")
    )


def _pronoun_sql(them):
    return S.with_clean(f"""counted AS (SELECT post_id, {S.we('clean_text')} AS we_count,
      {them('clean_text')} AS them_count FROM clean)
    SELECT *, we_count > 0 AS has_we, them_count > 0 AS has_them, {S.PRONOUN_TYPE} AS pronoun_type
    FROM counted""")


@query(_pronoun_sql(S.regex_them))
def tag_pronouns_regex(spark, sf_dir):
    return X.tag_pronouns(cleaned(spark, sf_dir), mode="regex").drop("clean_text")


@query(_pronoun_sql(S.lexicon_them))
def tag_pronouns_lexicon(spark, sf_dir):
    return X.tag_pronouns(cleaned(spark, sf_dir), mode="lexicon").drop("clean_text")


@query(S.with_facts("""SELECT post_id, unnest(matched) AS pattern,
  CAST(generate_subscripts(matched, 1) - 1 AS BIGINT) AS position FROM facts"""))
def match_patterns(spark, sf_dir):
    return cleaned(spark, sf_dir).select(
        "post_id", F.posexplode(matched_labels(F.col("clean_text"))).alias("position", "pattern")
    )


@query(S.with_facts("SELECT post_id, othering_score, has_othering FROM facts"))
def othering_score(spark, sf_dir):
    return add_othering(cleaned(spark, sf_dir)).select("post_id", "othering_score", "has_othering")


@query(S.with_facts("""SELECT post_id, array_to_string(matched, ',') AS matched_patterns,
  othering_score, has_othering FROM facts"""))
def apply_othering(spark, sf_dir):
    return add_othering(cleaned(spark, sf_dir)).drop("clean_text")


@query(S.with_facts(f"""labels_ AS (SELECT unnest(matched) AS pattern FROM facts)
SELECT pattern, {S.family_of('pattern')} AS family, count(*) AS n FROM labels_ GROUP BY pattern"""))
def pattern_family(spark, sf_dir):
    counts = facts(spark, sf_dir).select(F.explode("matched_patterns").alias("pattern")).groupBy(
        "pattern"
    ).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("family", family_of_label(F.col("pattern")))


@query(S.with_posts(f"""SELECT coalesce(emotion, 'unlabelled') AS emotion,
  {S.valence_of('emotion')} AS valence, count(*) AS n FROM posts GROUP BY ALL"""))
def emotion_valence(spark, sf_dir):
    counts = facts(spark, sf_dir).groupBy("emotion").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        F.coalesce("emotion", F.lit("unlabelled")).alias("emotion"),
        X.emotion_valence(F.col("emotion")).alias("valence"), "n",
    )


@query(S.with_posts("""SELECT CASE WHEN toxicity > 0.7 THEN 'high' WHEN toxicity > 0.4 THEN 'medium'
  ELSE 'low' END AS band, count(*) AS n FROM posts WHERE toxicity IS NOT NULL GROUP BY 1"""))
def toxicity_band(spark, sf_dir):
    scored = facts(spark, sf_dir).where("toxicity IS NOT NULL")
    band = X.toxicity_band(F.col("toxicity")).alias("band")
    return scored.groupBy(band).agg(F.count(F.lit(1)).alias("n"))


@query(S.with_posts("""SELECT CASE WHEN dataset LIKE 'Twitter%' THEN 'twitter'
  WHEN dataset LIKE 'Tiktok%' THEN 'tiktok' WHEN dataset LIKE 'Instagram%' THEN 'instagram'
  ELSE '' END AS platform, count(*) AS n FROM posts GROUP BY 1"""))
def platform_of(spark, sf_dir):
    platform = X.platform_of(F.col("dataset")).alias("platform")
    return facts(spark, sf_dir).groupBy(platform).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S.POSTS} SELECT dataset, {S.short('dataset')} AS short, count(*) AS n
FROM posts GROUP BY ALL""")
def dataset_short_name(spark, sf_dir):
    name = X.dataset_short_name(F.col("dataset")).alias("short")
    return facts(spark, sf_dir).groupBy("dataset", name).agg(F.count(F.lit(1)).alias("n"))


@query(S.with_posts("""SELECT post_id, substr(text, 1, 80) AS head,
  CASE WHEN length(text) > 280 THEN substr(text, 1, 280) || '...' ELSE text END AS preview
FROM posts"""))
def truncate_text(spark, sf_dir):
    text = F.col("text")
    return posts(spark, sf_dir).select(
        "post_id", X.truncate_text(text, 80).alias("head"),
        X.truncate_text(text, 280, ellipsis=True).alias("preview"),
    )


@query("""SELECT doc_id, quality::BIGINT AS quality, coalesce(toxic, 0)::BIGINT AS toxic, 'unknown' AS subreddit,
  CAST(NULL AS DOUBLE) AS toxicity FROM labels""")
def ensure_columns(spark, sf_dir):
    return N.ensure_columns(
        table(spark, sf_dir, "labels"),
        {"toxic": ("long", 0), "subreddit": ("string", "unknown"), "toxicity": ("double", None)},
    )


@query("""SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 4 = 0 THEN 'n/a'
  ELSE CAST(event_id AS VARCHAR) END AS DOUBLE), 0) AS score,
  try_cast(CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS rank
FROM events""")
def coerce_numeric(spark, sf_dir):
    i = F.col("event_id")
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(i % 4 == 0, "n/a").otherwise(i.cast("string")).alias("score"),
        F.when(i % 5 == 0, "").otherwise(F.col("user_id").cast("string")).alias("rank"),
    )
    return N.coerce_numeric(N.coerce_numeric(raw, ["score"], default=0), ["rank"])


@query("""SELECT event_id, CASE WHEN event_id % 10 = 9 THEN NULL
  WHEN event_id % 3 = 2 THEN strftime(ts, '%Y-%m-%d') || ' 00:00:00'
  ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS post_date FROM events""")
def parse_post_date(spark, sf_dir):
    """Three spellings and some junk; an earlier candidate column never parses."""
    ts, i = F.col("ts"), F.col("event_id")
    spelled = (
        F.when(i % 10 == 9, "soon")
        .when(i % 3 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(i % 3 == 1, F.date_format(ts, "EEE MMM dd HH:mm:ss Z yyyy"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.lit("unknown").alias("createdAt"), spelled.alias("created_at")
    )
    return N.parse_post_date(raw).select("event_id", "post_date")


DATE_SPELLINGS = [
    "M/d/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MMM d, yyyy HH:mm:ss", "MMMM d, yyyy h:mm:ss a",
    "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "MM/dd/yyyy h:mm:ss a", "d MMM yyyy HH:mm:ss Z",
    "yyyy-MM-dd hh:mm:ss a", "EEEE, d MMMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'",
]


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS post_date FROM events")
def parse_mixed_dates(spark, sf_dir):
    """Ten spellings mixed in one column."""
    ts, spelled = F.col("ts"), F.lit(None).cast("string")
    for k, spelling in enumerate(DATE_SPELLINGS):
        mine = F.col("event_id") % len(DATE_SPELLINGS) == k
        spelled = F.when(mine, F.date_format(ts, spelling)).otherwise(spelled)
    raw = table(spark, sf_dir, "events").select("event_id", spelled.alias("created_at"))
    return N.parse_post_date(raw).select("event_id", "post_date")


@query(S.with_posts("""SELECT post_id, strftime(make_timestamp(created_utc * 1000000),
  '%Y-%m-%d %H:%M:%S') AS date, strftime(make_timestamp(created_utc * 1000000), '%Y-%m') AS year_month
FROM posts WHERE created_utc <> 0"""))
def epoch_to_date(spark, sf_dir):
    dated = N.epoch_to_date(facts(spark, sf_dir))
    return dated.select("post_id", "date", "year_month")


@query("""SELECT page_id, trim(coalesce(url, '') || ' ' || CASE WHEN page_id % 3 = 0 THEN ''
  ELSE 'page' END) AS text FROM pages""")
def merge_title_body(spark, sf_dir):
    body = F.when(F.col("page_id") % 3 != 0, "page")
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", N.merge_title_body(F.col("url"), body).alias("text"))


@query("""SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(text) >= 20
  AND length(regexp_replace(text, '^[\\s\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x1c-\\x1f\\x85\\p{Z}]+$', '', 'g')) >= 20""")
def min_length_filter(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    kept = N.min_length_filter(N.min_length_filter(documents), stripped=True)
    return kept.select("doc_id", F.length("text").cast("long").alias("n"))


@query(S.with_posts("""SELECT post_id, subreddit FROM posts
WHERE subreddit IN ('politics', 'europe') AND year(post_date) BETWEEN 2024 AND 2024"""))
def keep_values(spark, sf_dir):
    kept = N.keep_values(facts(spark, sf_dir), "subreddit", ["politics", "europe"])
    return N.keep_years(kept, "post_date", 2024, 2024).select("post_id", "subreddit")


@query(S.with_facts("""SELECT post_id, array_to_string(matched, ',') AS patterns,
  CAST(len(matched) AS BIGINT) AS n FROM facts"""))
def parse_pattern_list(spark, sf_dir):
    """Labels written the way a Python list prints, and read back without evaluating."""
    joined = F.array_join("matched_patterns", "', '")
    printed = F.when(F.size("matched_patterns") == 0, "[]").otherwise(
        F.concat(F.lit("['"), joined, F.lit("']"))
    )
    parsed = facts(spark, sf_dir).select("post_id", N.parse_pattern_list(printed).alias("patterns"))
    return parsed.withColumn("n", F.size("patterns"))


@query("""SELECT count(*) AS n_rows, 5::BIGINT AS n_columns, round(avg(length(text)), 6) AS mean_length,
  count(*) FILTER (WHERE length(text) < 20) AS n_short FROM documents""")
def profile(spark, sf_dir):
    return N.profile(table(spark, sf_dir, "documents"))


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1")
def value_counts(spark, sf_dir):
    return N.value_counts(table(spark, sf_dir, "documents"), "source")


@query("""SELECT CASE WHEN avg(length(html)) > avg(length(url)) THEN 'html' ELSE 'url' END AS name,
  CASE WHEN avg(length(html)) > 30 AND avg(length(url)) > 30 THEN 'ambiguous'
  ELSE 'inferred' END AS confidence FROM pages""")
def detect_text_column(spark, sf_dir):
    name, confidence = N.detect_text_column(table(spark, sf_dir, "pages"))
    return spark.range(1).select(F.lit(name).alias("name"), F.lit(confidence).alias("confidence"))


@query("SELECT page_id, html AS text FROM pages")
def rename_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumnRenamed("url", "text")
    return N.rename_text(pages, "html").select("page_id", "text")


@query("SELECT doc_id, source, n_chars FROM documents")
def drop_duplicate_columns(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    doubled = documents.select("doc_id", "source", "n_chars", F.lit("x").alias("source"))
    return N.drop_duplicate_columns(doubled)


@query("""WITH merged AS (
SELECT text, 'hate_speech' AS source, CAST(NULL AS VARCHAR) AS subreddit FROM conversations
WHERE length(text) >= 20 UNION ALL
SELECT trim(source || ' ' || text), 'reddit', lang FROM documents
WHERE lang IN ('en', 'de') AND length(trim(source || ' ' || text)) >= 20)
SELECT source, coalesce(subreddit, '-') AS subreddit, count(*) AS n,
  CAST(sum(length(text)) AS BIGINT) AS chars FROM merged
WHERE length(trim(text)) >= 20 GROUP BY ALL""")
def ingest(spark, sf_dir):
    """Two unlike corpora as one table of posts, summarised."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("source").alias("title"), F.col("text").alias("selftext"),
        F.col("lang").alias("subreddit"),
    )
    merged = N.ingest(table(spark, sf_dir, "conversations"), documents, "text", ["en", "de"])
    return merged.groupBy("source", F.coalesce("subreddit", F.lit("-")).alias("subreddit")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
    )


@query(S.with_facts("""SELECT post_id, source, subreddit, dataset, clean_text, has_we, has_them,
  CAST(we_count AS BIGINT) AS we_count, CAST(them_count AS BIGINT) AS them_count, pronoun_type,
  has_othering, othering_score, array_to_string(matched, ',') AS matched_patterns,
  othering_predicted, othering_score / 4.0 AS othering_proba FROM facts"""))
def enrich_base(spark, sf_dir):
    return analysed(spark, sf_dir).select(
        "post_id", "source", "subreddit", "dataset", "clean_text", "has_we", "has_them",
        "we_count", "them_count", "pronoun_type", "has_othering", "othering_score",
        "matched_patterns", "othering_predicted", "othering_proba",
    )


@query(S.with_facts("""SELECT post_id,
  CASE post_id % 3 WHEN 0 THEN 1 WHEN 1 THEN othering_predicted ELSE 0 END AS othering_predicted,
  CASE post_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN othering_score / 4.0 ELSE 0.0 END AS othering_proba
FROM facts"""))
def predicted_fallback(spark, sf_dir):
    """A third of the posts has a model score, a third only rules, a third nothing."""
    k = F.col("post_id") % 3
    partial = facts(spark, sf_dir).select(
        "post_id",
        F.when(k == 0, F.lit(1)).alias("othering_predicted"),
        F.when(k == 0, F.lit(0.9)).alias("othering_proba"),
        F.when(k < 2, F.col("has_othering")).alias("has_othering"),
        F.when(k < 2, F.col("othering_score")).alias("othering_score"),
    )
    return enrich.predicted_fallback(partial).select(
        "post_id", "othering_predicted", "othering_proba"
    )


@query(S.with_posts("""both_ AS (SELECT post_id AS id, source, dataset, text, toxicity FROM posts
UNION ALL SELECT conv_id, role, 'conversations', text, NULL FROM conversations)
SELECT dataset, source, count(*) AS n, count(toxicity) AS n_scored,
  CAST(sum(length(text)) AS BIGINT) AS chars FROM both_ GROUP BY ALL"""))
def union_posts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("post_id"), F.col("role").alias("source"),
        F.lit("conversations").alias("dataset"), "text",
    )
    merged = N.union_posts([posts(spark, sf_dir), turns])
    return merged.groupBy("dataset", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count("toxicity").alias("n_scored"),
        F.sum(F.length("text")).alias("chars"),
    )


@query(S.with_posts("""SELECT 'Twitter  ·  tw_a.csv' AS dataset, count(*) AS n FROM conversations
UNION ALL SELECT dataset, count(*) FROM posts WHERE dataset <> 'Twitter  ·  tw_a.csv'
GROUP BY dataset"""))
def replace_dataset(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("post_id"))
    merged = N.replace_dataset(facts(spark, sf_dir), turns, "Twitter  ·  tw_a.csv")
    return merged.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query(S.with_posts("""SELECT dataset, count(*) AS n FROM posts
WHERE dataset <> 'Tiktok  ·  tk_b.csv' GROUP BY dataset"""))
def remove_dataset(spark, sf_dir):
    kept = N.remove_dataset(facts(spark, sf_dir), "Tiktok  ·  tk_b.csv")
    return kept.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
