"""Queries over samples, splits and pluggable scorers."""

import uuid

from pyspark.sql import functions as F

from discourse_spark.operators import sampling as P
from discourse_spark.operators import scoring as M
from discourse_spark.fixed_values import TOXICITY_COLUMNS
from discourse_spark.functions.text import clean_text
from discourse_spark.plans import sql as S
from discourse_spark.plans.corpus import facts, posts
from discourse_spark.plans.registry import query
from discourse_spark.session import shared_folder

HASH = "(post_id * 7919 + 13) % 10007"


def _key():
    return {"key": F.expr(HASH), "key_space": 10007}


@query(S.with_posts("SELECT post_id, dataset FROM posts ORDER BY post_id LIMIT 100"))
def take_rows(spark, sf_dir):
    return P.take_first(facts(spark, sf_dir).select("post_id", "dataset"), 100)


@query(S.with_posts(f"SELECT post_id, dataset FROM posts ORDER BY {HASH}, post_id LIMIT 100"))
def random_sample(spark, sf_dir):
    return P.random_sample(facts(spark, sf_dir).select("post_id", "dataset"), 100, **_key())


@query(S.with_posts(f"""strata AS (SELECT *, coalesce(subreddit, source) AS stratum,
    {HASH} AS h FROM posts),
sizes AS (SELECT stratum, count(*) AS size,
    least(count(*), greatest(1, (100 * count(*)) // sum(count(*)) OVER ())) AS quota
  FROM strata GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, post_id) AS r
  FROM strata JOIN sizes USING (stratum))
SELECT post_id, stratum FROM (SELECT * FROM ranked
  ORDER BY CASE WHEN r <= quota THEN 0 ELSE 1 END, h, post_id LIMIT 100)"""))
def stratified_sample(spark, sf_dir):
    stratum = F.coalesce("subreddit", "source")
    narrow = posts(spark, sf_dir).select("post_id", stratum.alias("stratum"))
    return P.stratified_sample(narrow, 100, F.col("stratum"), **_key())


@query(S.with_facts(f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY has_othering
    ORDER BY {HASH}, post_id) AS r, count(*) OVER (PARTITION BY has_othering) AS size FROM facts)
SELECT post_id, has_othering, CASE WHEN r <= round(size * 0.8) THEN 'train' ELSE 'test' END AS split
FROM ranked"""))
def train_test_split(spark, sf_dir):
    narrow = facts(spark, sf_dir).select("post_id", "has_othering")
    return P.train_test_split(narrow, "has_othering", **_key())


TOXIC_WORDS = {
    "toxic": ["rats", "parasites", "animals", "plague", "invasion", "swarm"],
    "insult": ["rats", "beastly"],
    "threat": ["attack", "destroying", "genocide", "replacing"],
}
EMOTION_WORDS = {
    "anger": ["attack", "invasion", "destroying", "leave"],
    "fear": ["genocide", "plague", "replacement", "flood"],
    "joy": ["welcome", "home", "met"],
}


def load_toxicity():
    return M.KeywordScorer(TOXIC_WORDS)


def load_emotion():
    return M.KeywordScorer(EMOTION_WORDS, rest="neutral")


def _share(words):
    return f"len([w FOR w IN words IF w IN {S.in_list(words)}]) / greatest(len(words), 1)::DOUBLE"


_WORDS = """words_ AS (SELECT *, [w FOR w IN string_split(clean_text, ' ') IF w <> ''] AS words FROM clean)"""
_TOXIC = {label: _share(words) for label, words in TOXIC_WORDS.items()}
_EMOTIONS = {label: _share(words) for label, words in EMOTION_WORDS.items()}


def _clean_posts(spark, sf_dir):
    return posts(spark, sf_dir).withColumn("clean_text", clean_text("text"))


_SCORES = S.with_clean(f"""{_WORDS} SELECT post_id, round({_TOXIC['toxic']}, 6) AS toxicity,
  0.0::DOUBLE AS severe_toxicity, 0.0::DOUBLE AS identity_attack,
  round({_TOXIC['insult']}, 6) AS insult, round({_TOXIC['threat']}, 6) AS threat FROM words_""")


@query(_SCORES)
def score_batches(spark, sf_dir):
    scored = M.score_batches(_clean_posts(spark, sf_dir).drop("toxicity"), load_toxicity)
    return scored.select("post_id", *TOXICITY_COLUMNS)


@query(_SCORES)
def score_resumable(spark, sf_dir):
    """A third of the posts is scored in a first run; the second goes on with what is open."""
    source, path = _clean_posts(spark, sf_dir).drop("toxicity"), f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    M.score_resumable(source.where(F.col("post_id") % 3 == 0), path, load_toxicity, ranges=2)
    scored = M.score_resumable(source, path, load_toxicity, ranges=2)
    return scored.select("post_id", *TOXICITY_COLUMNS)


_BEST = f"""{_WORDS}, shares AS (SELECT post_id, emotion AS old, {_EMOTIONS['anger']} AS anger,
  {_EMOTIONS['fear']} AS fear, {_EMOTIONS['joy']} AS joy FROM words_),
rest_ AS (SELECT *, greatest(0, 1 - (anger + fear + joy)) AS neutral FROM shares),
best AS (SELECT post_id, old, greatest(anger, fear, joy, neutral) AS top,
  CASE greatest(anger, fear, joy, neutral) WHEN anger THEN 'anger' WHEN fear THEN 'fear'
    WHEN joy THEN 'joy' ELSE 'neutral' END AS label FROM rest_)"""


@query(S.with_clean(f"""{_BEST} SELECT post_id, label AS emotion, round(top, 4) AS emotion_score
FROM best"""))
def top1_label(spark, sf_dir):
    labelled = M.top1_label(_clean_posts(spark, sf_dir), load_emotion)
    return labelled.select("post_id", "emotion", "emotion_score")


@query(S.with_clean(f"""{_WORDS} SELECT post_id,
  coalesce(toxicity, round({_TOXIC['toxic']}, 4)) AS toxicity,
  CASE WHEN toxicity IS NULL THEN round({_TOXIC['threat']}, 4) END AS threat FROM words_"""))
def fill_missing_scores(spark, sf_dir):
    filled = M.fill_missing_toxicity(_clean_posts(spark, sf_dir), load_toxicity)
    return filled.select("post_id", "toxicity", "threat")


@query(S.with_clean(f"""{_BEST} SELECT post_id, coalesce(old, label) AS emotion,
  CASE WHEN old IS NULL THEN round(top, 4) END AS emotion_score FROM best"""))
def fill_missing_emotions(spark, sf_dir):
    filled = M.fill_missing_emotion(_clean_posts(spark, sf_dir), load_emotion)
    return filled.select("post_id", "emotion", "emotion_score")


@query(S.with_posts("""SELECT 'toxicity' AS "column", count(*) AS n_rows,
  count(*) - count(toxicity) AS n_missing, round(count(toxicity) * 100.0 / count(*), 6) AS coverage_pct
FROM posts UNION ALL SELECT 'emotion', count(*), count(*) - count(emotion),
  round(count(emotion) * 100.0 / count(*), 6) FROM posts"""))
def score_coverage(spark, sf_dir):
    return M.coverage(facts(spark, sf_dir), ["toxicity", "emotion"])


class BrokenScorer:
    """Fails on any batch that holds the word "plague"."""

    def __call__(self, texts):
        if any("plague" in text for text in texts):
            raise RuntimeError("scorer failed")
        return [{"toxic": 0.5, "joy": 0.7, "fear": 0.7} for _ in texts]


@query(S.with_clean("""SELECT post_id, contains(clean_text, 'plague') AS failed,
  CASE WHEN contains(clean_text, 'plague') THEN NULL ELSE 0.5 END::DOUBLE AS toxicity,
  CASE WHEN contains(clean_text, 'plague') THEN 'neutral' ELSE 'fear' END AS emotion,
  CASE WHEN contains(clean_text, 'plague') THEN 0.0 ELSE 0.7 END::DOUBLE AS emotion_score FROM clean"""))
def scorer_error_policy(spark, sf_dir):
    """Batches of one, so that each failing text shows its own fallback."""
    source = _clean_posts(spark, sf_dir).drop("toxicity", "emotion")
    scored = M.score_batches(source, BrokenScorer, {"toxic": "toxicity"}, batch_size=1, keep_going=True)
    labelled = M.top1_label(scored, BrokenScorer, batch_size=1, keep_going=True)
    return labelled.select(
        "post_id", F.col("clean_text").contains("plague").alias("failed"),
        "toxicity", "emotion", "emotion_score",
    )


@query(S.with_posts("SELECT post_id, dataset, toxicity FROM posts"))
def propagate_scores(spark, sf_dir):
    source = facts(spark, sf_dir)
    target = source.select("post_id", "dataset")
    updated, _ = M.propagate_scores(source, target, ["toxicity"])
    return updated.select("post_id", "dataset", "toxicity")
