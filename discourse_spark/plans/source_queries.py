"""Queries that read and write tables: the given tables are first laid out as files."""

import uuid

from pyspark.sql import functions as F

from discourse_spark.operators import aggregates as G
from discourse_spark.operators import classifier as C
from discourse_spark.operators import enrich
from discourse_spark.operators import sampling as P
from discourse_spark.operators import topics as B
from discourse_spark.plans import sql as S
from discourse_spark.plans.corpus import CALENDAR, calendar, facts, posts, table
from discourse_spark.plans.registry import query
from discourse_spark.plans.sampling_queries import _BEST, _TOXIC, load_emotion, load_toxicity
from discourse_spark.session import materialize, shared_folder
from discourse_spark.sources import posts as IO


def _folder(spark):
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("""SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n FROM documents
WHERE text IS NOT NULL AND text <> ''""")
def read_posts(spark, sf_dir):
    """Whole texts, line breaks and quotes included, through CSV and back."""
    path = f"{_folder(spark)}/documents.csv"
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    IO.write_table(documents.where("text <> ''"), path)
    return IO.read_posts(spark, path, documents.schema).withColumn("n", F.length("text"))


def few_files(df):
    """One file of four input splits: larger than what one task reads later, however large the table."""
    return df.coalesce(-(-df.rdd.getNumPartitions() // 4))


@query("""SELECT doc_id, text, lang, CAST(length(text) AS BIGINT) AS n FROM
  (SELECT doc_id, replace(text, '. ', '.' || chr(10) || '"') AS text, lang FROM documents)
WHERE text IS NOT NULL AND text <> ''""")
def read_posts_split(spark, sf_dir):
    """Texts with a quoted break and quote after each sentence, in few CSV files, each read by many tasks."""
    path = f"{_folder(spark)}/documents.csv"
    broken = F.replace("text", F.lit(". "), F.lit('.\n"')).alias("text")
    documents = table(spark, sf_dir, "documents").select("doc_id", broken, "lang")
    IO.write_table(few_files(documents.where("text <> ''")), path)
    return IO.read_posts(spark, path, documents.schema, split_files=True).withColumn("n", F.length("text"))


_LAID_OUT = """laid_out AS (SELECT 'Chats  ·  turns.csv' AS dataset, text FROM conversations
UNION ALL SELECT 'Docs  ·  texts.parquet', text FROM posts
UNION ALL SELECT 'Imported  ·  pages.csv', html FROM pages)"""


def _lay_out(spark, sf_dir):
    """Three groups: a CSV, a Parquet table, and an import whose text column must be found."""
    root = _folder(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("text").alias("Caption"))
    IO.write_table(turns, f"{root}/chats/turns.csv")
    IO.write_table(posts(spark, sf_dir).select("post_id", "text"), f"{root}/docs/texts.parquet")
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    IO.write_table(pages, f"{root}/imported/pages.csv")
    return root


@query(S.with_posts(f"""{_LAID_OUT} SELECT dataset, count(*) AS n,
  CAST(sum(length(text)) AS BIGINT) AS chars FROM laid_out GROUP BY dataset"""))
def load_labelled(spark, sf_dir):
    loaded, errors = IO.load_labelled(spark, _lay_out(spark, sf_dir))
    assert not errors, errors
    return loaded.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
    )


@query(S.with_posts("""loaded AS (SELECT 'Feeds  ·  one.parquet' AS dataset, post_id, post_date
  FROM posts UNION ALL SELECT 'Feeds  ·  two.csv', post_id, post_date FROM posts, range(2))
SELECT dataset, strftime(post_date, '%Y-%m-%d') || ' 00:00:00' AS post_date, count(*) AS n,
  count(*) AS n_ids FROM loaded GROUP BY ALL
UNION ALL SELECT 'sample', NULL, least(100, count(*)), least(100, count(*)) FROM loaded
UNION ALL SELECT 'train', NULL, CAST(sum(t) AS BIGINT), CAST(sum(t) AS BIGINT)
  FROM (SELECT round(0.8 * count(*)) AS t FROM loaded GROUP BY dataset)"""))
def labelled_row_ids(spark, sf_dir):
    """Loaded rows, every one twice in a file, get ids of their own; they are sampled and split by them."""
    root = _folder(spark)
    spelled = F.when(F.col("post_id") % 2 == 0, F.date_format("post_date", "MMM d, yyyy")).otherwise(
        F.date_format("post_date", "M/d/yyyy"))
    raw = posts(spark, sf_dir).select(F.col("text").alias("Caption"), spelled.alias("created_at"))
    IO.write_table(raw, f"{root}/feeds/one.parquet")
    IO.write_table(raw.unionByName(raw), f"{root}/feeds/two.csv")
    loaded, errors = IO.load_labelled(spark, root)
    assert not errors, errors
    narrow = materialize(loaded.select("row_id", "dataset", "post_date"), "labelled")
    n, n_ids = F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("n_ids")
    split = P.train_test_split(narrow, "dataset", id_col="row_id").where(F.col("split") == "train")
    whole = [
        df.agg(n, n_ids).select(F.lit(name).alias("dataset"), F.lit(None).cast("timestamp").alias("post_date"), "n", "n_ids")
        for name, df in (("sample", P.random_sample(narrow, 100, "row_id")), ("train", split))
    ]
    return narrow.groupBy("dataset", "post_date").agg(n, n_ids).unionByName(whole[0]).unionByName(whole[1])


@query(S.with_posts(f"""{_LAID_OUT} SELECT DISTINCT split_part(dataset, '  ·  ', 1) AS "group",
  split_part(dataset, '  ·  ', 2) AS name FROM laid_out"""))
def discover_datasets(spark, sf_dir):
    groups = IO.discover_datasets(spark, _lay_out(spark, sf_dir))
    rows = [(group, name) for group, files in groups.items() for name, _ in files]
    return spark.createDataFrame(rows, "group string, name string")


@query(S.with_posts("""SELECT 'Full  ·  posts.parquet' AS dataset, FALSE AS othering, TRUE AS toxicity,
  TRUE AS emotions, TRUE AS topics FROM posts HAVING count(*) > 0
UNION ALL SELECT 'Raw  ·  docs.parquet', FALSE, FALSE, FALSE, FALSE FROM documents HAVING count(*) > 0"""))
def completeness(spark, sf_dir):
    root = _folder(spark)
    IO.write_table(posts(spark, sf_dir), f"{root}/full/posts.parquet")
    IO.write_table(table(spark, sf_dir, "documents"), f"{root}/raw/docs.parquet")
    return IO.dataset_completeness(spark, root)


@query(S.with_facts("""SELECT strftime(c.date, '%Y-%m-%d') AS date, title, category, count(f.post_id) AS n
FROM calendar c LEFT JOIN facts f ON f.post_date = c.date GROUP BY c.date, title, category"""))
def read_calendar_events(spark, sf_dir):
    """The calendar through a CSV file, with the number of posts on each event's day."""
    path = f"{_folder(spark)}/calendar.csv"
    fields = calendar(spark).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "title", "category", "country",
        F.lit("").alias("region"), F.lit("invented").alias("source"),
    )
    IO.write_table(fields, path)
    events = IO.read_calendar_events(spark, path)
    days = posts(spark, sf_dir).groupBy(F.to_date("post_date").alias("date")).agg(
        F.count(F.lit(1)).alias("k")
    )
    assert events.count() == len(CALENDAR)
    return events.join(days, "date", "left").select(
        "date", "title", "category", F.coalesce("k", F.lit(0)).cast("long").alias("n")
    )


@query(S.with_posts("""SELECT dataset, count(*) * CASE WHEN dataset LIKE 'Tiktok%' THEN 2 ELSE 1 END AS n
FROM posts GROUP BY dataset"""))
def write_datasets(spark, sf_dir):
    """One dataset is replaced on disk by twice its rows; the others stay as they are."""
    path = _folder(spark)
    narrow = posts(spark, sf_dir).select("post_id", "dataset")
    IO.write_datasets(narrow, path)
    one = narrow.where(F.col("dataset").startswith("Tiktok"))
    IO.write_datasets(one.unionByName(one), path)
    return spark.read.parquet(path).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


_CHANGED = """changed AS (SELECT * FROM facts WHERE dataset NOT LIKE 'Instagram%'
  AND (dataset NOT LIKE 'Tiktok%' OR post_id % 3 = 0))"""


def _changed_sums(spark, sf_dir):
    """Kept sums after one dataset is replaced by a third of its rows and one is removed."""
    path, all_posts = _folder(spark), facts(spark, sf_dir)
    G.keep_sums(all_posts, path)
    G.keep_sums(all_posts.where(F.col("dataset").startswith("Tiktok") & (F.col("post_id") % 3 == 0)), path)
    G.drop_sums(spark, path, "Instagram  ·  ig_c.csv")
    return G.read_sums(spark, path)


@query(S.with_facts(f"""{_CHANGED} SELECT count(*) AS total,
  round(avg(othering_predicted) * 100, 6) AS othering_pct,
  round(avg((toxicity > 0.5)::DOUBLE) * 100, 6) AS high_toxicity_pct,
  count(DISTINCT dataset) AS n_datasets, (SELECT emotion FROM changed WHERE emotion IS NOT NULL
    GROUP BY emotion ORDER BY count(*) DESC, emotion LIMIT 1) AS top_emotion FROM changed"""))
def kept_kpis(spark, sf_dir):
    return G.overview_kpis(_changed_sums(spark, sf_dir))


@query(S.with_facts(f"""{_CHANGED} SELECT strftime(date_trunc('week', post_date), '%Y-%m-%d') AS period,
  dataset, count(*) AS posts, round(avg(othering_predicted), 6) AS othering_rate,
  round(avg(toxicity), 6) AS toxicity_mean FROM changed GROUP BY ALL"""))
def kept_timeline(spark, sf_dir):
    return G.timeline(_changed_sums(spark, sf_dir), "Week")


@query(S.with_facts("""SELECT dataset, count(*) AS n, CAST(sum(othering_score) AS BIGINT) AS score,
  count(*) FILTER (WHERE toxicity IS NULL) AS unscored FROM facts GROUP BY dataset"""))
def enrich_full(spark, sf_dir):
    """Every stage switched on; toxicity is present and must stay, emotions too."""
    full = enrich.enrich_full(posts(spark, sf_dir), True, load_toxicity, load_emotion)
    return full.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.sum("othering_score").alias("score"),
        F.count_if(F.col("toxicity").isNull()).alias("unscored"),
    )


_LETTERS = S.with_clean("SELECT post_id, " + ", ".join(
    f"round(CAST(CAST((length(clean_text) - length(replace(clean_text, '{c}', ''))) "
    f"/ greatest(length(clean_text), 1) AS FLOAT) AS DOUBLE), 6) AS {c}" for c in "aeiou") + " FROM clean")


class LetterEncoder:
    """Shares of five letters: a stand-in for a sentence encoder."""

    def __call__(self, texts):
        return [[t.count(c) / max(len(t), 1) for c in "aeiou"] for t in texts]


@query(_LETTERS)
def embed_texts(spark, sf_dir):
    """Embeddings are cached by id: the second pass only encodes the other half."""
    from discourse_spark.functions.text import clean_text

    source = posts(spark, sf_dir).select("post_id", clean_text("text").alias("clean_text"))
    path = _folder(spark)

    def encode(df):
        return C.embed_texts(df, LetterEncoder)

    C.embedding_cache(source.where(F.col("post_id") % 2 == 0), path, encode)
    cached = C.embedding_cache(source, path, encode)
    return cached.select(
        "post_id",
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("aeiou")],
    )


@query(_LETTERS)
def embed_once(spark, sf_dir):
    """Embeddings are kept by content: the second pass encodes the texts that the first had not."""
    from discourse_spark.functions.text import clean_text

    source = posts(spark, sf_dir).select("post_id", clean_text("text").alias("clean_text"))
    path = _folder(spark)
    C.embed_once(source.where(F.col("post_id") % 2 == 0), path, LetterEncoder, ranges=2)
    embedded = C.embed_once(source, path, LetterEncoder, ranges=2)
    return embedded.select(
        "post_id",
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("aeiou")],
    )


@query()
def model_topics(spark, sf_dir):
    """Topics of whole texts from scratch, named by their own words."""
    from discourse_spark.functions.text import clean_text

    source = posts(spark, sf_dir).select("post_id", clean_text("text").alias("clean_text"))
    topics = B.model_topics(source, k=8, min_size=5)
    return topics.groupBy("topic", "topic_name").agg(F.count(F.lit(1)).alias("n"))


@query()
def metrics_document(spark, sf_dir):
    """The chosen model's metrics, written and read as JSON."""
    from discourse_spark.plans.model_queries import _models, _split

    fitted, comparison = _models(spark, sf_dir)
    best = C.select_best(fitted, comparison)
    path = f"{_folder(spark)}/metrics.json"
    IO.write_metrics_json(C.metrics_document(best, _split(spark, sf_dir), comparison), path)
    return spark.read.json(path).select(
        "model_name", "n_train", "n_test", "n_pos_train", "n_pos_test", "precision", "recall",
        "f1", F.size("all_models").alias("n_models"),
    )


_encoded = {}


def _encoded_models(spark, sf_dir):
    """Both models on embeddings, trained once per application."""
    from discourse_spark.plans.model_queries import _split

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _encoded:
        _encoded[key] = C.train_models(_split(spark, sf_dir), features=("Embeddings",), encoder=LetterEncoder)
    return _encoded[key]


@query(S.with_posts("""SELECT name AS model, count(*) AS n, count(*) AS n_same FROM posts,
  (VALUES ('LogisticRegression_Embeddings'), ('LinearSVC_Embeddings')) AS m(name) GROUP BY name"""))
def stored_models(spark, sf_dir):
    """Models on embeddings predict the same for every post after they are saved and loaded."""
    from discourse_spark.plans.model_queries import cleaned

    source, path, compared = cleaned(spark, sf_dir).select("post_id", "clean_text"), _folder(spark), []
    for model in _encoded_models(spark, sf_dir)[0]:
        model.save(path)
        again = C.OtheringClassifier.load(path, model.name).classify(source)
        first = model.classify(source).drop("clean_text").toDF("post_id", "predicted", "proba")
        same = (F.col("predicted") == F.col("othering_predicted")) & (F.col("proba") == F.col("othering_proba"))
        compared.append(again.join(first, "post_id").agg(
            F.lit(model.name).alias("model"), F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_same")))
    return compared[0].unionByName(compared[1])


_FULL_COUNTS = """count(*) AS n, round(sum(toxicity), 4) AS toxicity, round(sum(threat), 4) AS threat,
  round(sum(emotion_score), 3) AS emotion_score,"""


@query(S.with_facts(f"""{_BEST},
scored AS (SELECT f.dataset, f.othering_score AS score, {_TOXIC['toxic']} AS toxicity, {_TOXIC['threat']} AS threat,
    b.label AS emotion, round(b.top, 4) AS emotion_score
  FROM words_ w JOIN best b USING (post_id) JOIN facts f USING (post_id))
SELECT dataset, emotion, {_FULL_COUNTS} CAST(sum(score) AS BIGINT) AS score, CAST(0 AS BIGINT) AS n_unnamed,
  CAST(0 AS BIGINT) AS n_unclassified FROM scored GROUP BY ALL"""))
def enrich_full_scored(spark, sf_dir):
    """Posts without any score through both scorers, topics and a fitted model. Topics and
    predictions have no SQL: every post must have a named topic and a label that fits its probability."""
    raw = posts(spark, sf_dir).drop("toxicity", "emotion", "topic", "topic_name")
    fitted, comparison = _encoded_models(spark, sf_dir)

    def topics(df):
        return B.model_topics(df, k=8, min_size=5)

    full = enrich.enrich_full(
        raw, True, load_toxicity, load_emotion, topics, C.select_best(fitted, comparison)
    )
    named = F.col("topic").isNotNull() & F.col("topic_name").isNotNull()
    fits = F.when(F.col("othering_proba") > 0.5, 1).when(F.col("othering_proba") < 0.5, 0).otherwise(
        F.col("othering_predicted"))
    return full.groupBy("dataset", "emotion").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("toxicity"), 4).alias("toxicity"),
        F.round(F.sum("threat"), 4).alias("threat"), F.round(F.sum("emotion_score"), 3).alias("emotion_score"),
        F.sum("othering_score").alias("score"), F.count_if(~named).alias("n_unnamed"),
        F.count_if(~F.equal_null("othering_predicted", fits)).alias("n_unclassified"),
    )
