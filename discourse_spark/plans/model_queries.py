"""Queries over TF-IDF, classifiers, their metrics, and topics."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from discourse_spark.operators import classifier as C
from discourse_spark.operators import density as D
from discourse_spark.operators import newton as N
from discourse_spark.operators import projection as R
from discourse_spark.operators import sampling as P
from discourse_spark.operators import topics as B
from discourse_spark.plans import sql as S
from discourse_spark.plans.corpus import analysed, facts, table
from discourse_spark.plans.registry import query
from discourse_spark.session import materialize, shared_folder

_cleaned = {}


def cleaned(spark, sf_dir):
    """Cleaned texts with the columns models need, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _cleaned:
        _cleaned[key] = materialize(
            analysed(spark, sf_dir).select(
                "post_id", "clean_text", "has_othering", "has_them", "toxicity", "topic",
                "topic_name", "emotion", "othering_score", "othering_predicted",
            ),
            "cleaned",
        )
    return _cleaned[key]


_scored = {}


def topic_scores(spark, sf_dir):
    """c-TF-IDF of the corpus, written once for naming, outliers and similarity."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _scored:
        _scored[key] = materialize(B.c_tf_idf(cleaned(spark, sf_dir)), "scores")
    return _scored[key]


_TERMS = """words_ AS (SELECT post_id, regexp_extract_all(clean_text, '[a-z0-9_]{2,}') AS w FROM clean),
grams AS (SELECT post_id, unnest(w) AS term FROM words_ UNION ALL
  SELECT post_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM words_),
in_post AS (SELECT post_id, term, count(*) AS n FROM grams GROUP BY ALL),
vocabulary AS MATERIALIZED (SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df,
    ln(((SELECT count(*) FROM clean) + 1) / (count(*) + 1)) + 1 AS idf FROM in_post
  GROUP BY term HAVING count(*) >= 2 ORDER BY tf DESC, term LIMIT 50000)"""


@query(S.with_clean(f"{_TERMS} SELECT term, tf, df, round(idf, 6) AS idf FROM vocabulary"))
def tfidf_vocabulary(spark, sf_dir):
    return C.tfidf_vocabulary(cleaned(spark, sf_dir))


@query(S.with_clean(f"""{_TERMS}, weights AS (SELECT post_id, (1 + ln(n)) * idf AS x
  FROM in_post JOIN vocabulary USING (term))
SELECT post_id, count(x) AS n_terms, round(coalesce(sum(x) / sqrt(sum(x * x)), 0), 6) AS total,
  round(max(x) / sqrt(sum(x * x)), 6) AS largest FROM clean LEFT JOIN weights USING (post_id)
GROUP BY post_id"""))
def tfidf_features(spark, sf_dir):
    """Unit-length TF-IDF vectors, summarised per post."""
    texts = cleaned(spark, sf_dir).select("post_id", "clean_text")
    features = C.fit_tfidf(texts).transform(texts)
    plain = features.select("post_id", C.vector_fields(F.col("features")).alias("v"))
    total = F.aggregate("v.values", F.lit(0.0), lambda a, x: a + x)
    return plain.select(
        "post_id", F.size("v.values").alias("n_terms"), total.alias("total"),
        F.array_max("v.values").alias("largest"),
    )


@query(S.with_facts("""SELECT post_id, has_othering,
  round(count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY has_othering)), 6) AS weight FROM facts"""))
def balanced_weights(spark, sf_dir):
    narrow = facts(spark, sf_dir).select("post_id", "has_othering")
    return C.balanced_weights(narrow, "has_othering")


_GUESS = """guesses AS (SELECT post_id, clean_text, has_othering::INT AS label,
  CASE WHEN post_id % 10 = 0 THEN 1 - has_othering::INT ELSE has_othering::INT END AS predicted FROM facts)"""


def _guesses(spark, sf_dir):
    """Rule labels, with every tenth one flipped as the prediction."""
    label = F.col("has_othering").cast("int")
    return cleaned(spark, sf_dir).select(
        "post_id", "clean_text", label.alias("label"),
        F.when(F.col("post_id") % 10 == 0, 1 - label).otherwise(label).alias("predicted"),
    )


_COUNTS = """counts AS (SELECT count(*) FILTER (WHERE {t} AND {p}) AS tp,
  count(*) FILTER (WHERE NOT {t} AND {p}) AS fp, count(*) FILTER (WHERE {t} AND NOT {p}) AS fn,
  count(*) FILTER (WHERE NOT {t} AND NOT {p}) AS tn FROM {source})
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM counts"""


@query(S.with_facts(f"{_GUESS}, " + _COUNTS.format(t="label = 1", p="predicted = 1", source="guesses")))
def binary_metrics(spark, sf_dir):
    return C.binary_metrics(_guesses(spark, sf_dir), "label", "predicted")


@query(S.with_facts(f"""{_GUESS}, per_class AS (
  SELECT c, count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE predicted = c) AS guessed,
    count(*) FILTER (WHERE label = c AND predicted = c) AS hit
  FROM guesses, (VALUES (0), (1)) AS v(c) GROUP BY c),
scored AS (SELECT CASE c WHEN 1 THEN 'othering' ELSE 'no_othering' END AS class,
  hit / guessed AS precision, hit / support AS recall, 2 * hit / (guessed + support) AS f1, support
  FROM per_class),
everything AS (SELECT * FROM scored UNION ALL
SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM scored UNION ALL
SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM scored)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM everything"""))
def classification_report(spark, sf_dir):
    return C.classification_report(_guesses(spark, sf_dir), "label", "predicted")


@query(S.with_facts(f"""{_GUESS} SELECT post_id,
  CASE label WHEN 1 THEN 'othering' ELSE 'no_othering' END AS true_label,
  CASE predicted WHEN 1 THEN 'othering' ELSE 'no_othering' END AS predicted_label,
  substr(clean_text, 1, 120) AS preview FROM guesses WHERE label <> predicted ORDER BY post_id LIMIT 10"""))
def error_examples(spark, sf_dir):
    return C.error_examples(_guesses(spark, sf_dir), "label", "predicted")


HASH = "(post_id * 7919 + 13) % 10007"
_PROXY = f"""sample AS (SELECT *, coalesce(toxicity > 0.5, FALSE) AND has_them AS proxy FROM facts
  ORDER BY {HASH}, post_id LIMIT 100)"""


def _key():
    return {"key": F.expr(HASH), "key_space": 10007}


@query(S.with_facts(f"{_PROXY}, " + _COUNTS.format(t="proxy", p="has_othering", source="sample")))
def proxy_validation(spark, sf_dir):
    narrow = facts(spark, sf_dir).select("post_id", "toxicity", "has_them", "has_othering")
    return C.proxy_validation(narrow, 100, **_key())


@query(S.with_facts(f"""{_PROXY} SELECT post_id, toxicity, array_to_string(matched, ',') AS
  matched_patterns FROM sample WHERE has_othering AND proxy ORDER BY post_id LIMIT 10"""))
def proxy_examples(spark, sf_dir):
    narrow = facts(spark, sf_dir).select(
        "post_id", "toxicity", "has_them", "has_othering", "matched_patterns"
    )
    examples = C.proxy_examples(narrow, agree=True, **_key())
    return examples.select("post_id", "toxicity", "matched_patterns")


def _split(spark, sf_dir):
    data = cleaned(spark, sf_dir).select("post_id", "clean_text", "has_othering")
    split = P.train_test_split(data, "has_othering")
    return split.withColumn("label", F.col("has_othering").cast("int"))


_trained = {}


def _models(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _trained:
        _trained[key] = C.train_models(_split(spark, sf_dir), features=("TF-IDF", "Hashed"))
    return _trained[key]


@query()
def model_comparison(spark, sf_dir):
    """Two models on two kinds of features, on the held-out fifth."""
    return _models(spark, sf_dir)[1].drop("trained")


@query()
def classify(spark, sf_dir):
    """The best model applied to every post."""
    best = C.select_best(*_models(spark, sf_dir))
    return best.classify(cleaned(spark, sf_dir).select("post_id", "clean_text")).select(
        "post_id", "othering_predicted", "othering_proba"
    )


@query(S.with_facts("""SELECT (SELECT count(*) FROM facts) AS n_posts, (SELECT count(*) FROM facts) AS n_scored,
  CAST(0 AS BIGINT) AS n_out_of_range, CAST(0 AS BIGINT) AS n_contradictions, CAST(4 AS BIGINT) AS n_models,
  true AS stored_alike"""))
def classifier_invariants(spark, sf_dir):
    """What must hold for any trained model: every post scored once, probabilities in range, predictions
    on their side of one half, four models compared, and the same scores from a stored and loaded copy."""
    fitted, comparison = _models(spark, sf_dir)
    best = C.select_best(fitted, comparison)
    folder = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    best.save(folder)
    texts = cleaned(spark, sf_dir).select("post_id", "clean_text")
    scored = best.classify(texts).select("post_id", "othering_predicted", "othering_proba")
    again = C.OtheringClassifier.load(folder, best.name).classify(texts).select(
        "post_id", F.col("othering_predicted").alias("p"), F.col("othering_proba").alias("q")
    )
    p, q = F.col("othering_predicted"), F.col("othering_proba")
    facts_ = scored.join(again, "post_id").agg(
        F.count("*").alias("n_scored"), F.count_if(~q.between(0, 1) | ~p.isin(0, 1)).alias("n_out_of_range"),
        F.count_if((F.abs(q - 0.5) > 1e-4) & ((q > 0.5) != (p == 1))).alias("n_contradictions"),
        (F.count_if((p != F.col("p")) | (q != F.col("q"))) == 0).alias("stored_alike"),
    )
    models = comparison.agg(F.count("*").alias("n_models"))
    sizes = texts.agg(F.count("*").alias("n_posts"))
    return facts_.withColumns({
        c: df.select(c).scalar() for df in (models, sizes) for c in df.columns
    })


@query(S.with_facts("""SELECT fit, (SELECT count(*) FROM facts WHERE has_othering) > 0 AS has_labels, true AS stationary,
  true AS no_better_nearby FROM range(6) AS r(fit)"""))
def svc_optimum(spark, sf_dir):
    """Each fit of the linear SVC and its calibration folds: the gradient vanishes at its weights, and no
    weights nearby have a smaller loss."""
    data = _split(spark, sf_dir).select("post_id", "clean_text", F.col("label").cast("double").alias("label"))
    ready = materialize(C.hashed_features().transform(data), "svc-rows")
    fits, size, blocked = C.svc_fits(ready, "label", 1.0, 5, 2000, "post_id")

    def loss(w):
        def of_block(b):
            y = np.where(b.targets > 0.5, 1.0, -1.0)
            z = b.dot(w)
            slopes = b.back(b.weights * N.SQUARED_HINGE.slope(z, y), size)
            return np.hstack([slopes, (b.weights * N.SQUARED_HINGE.value(z, y)).sum(axis=1, keepdims=True)])

        total = N.tree_sum(blocked, of_block, (6, size + 2))
        return total[:, -1] + 0.5 * (w * w).sum(axis=1), np.linalg.norm(total[:, :-1] + w, axis=1)

    w = fits.weights
    at, slope = loss(w)
    start = loss(np.zeros_like(w))[1]
    near = [loss(w * (1 + e))[0] for e in (-0.01, 0.01)] + [loss(w + e * np.eye(1, size + 1, size))[0] for e in (-0.01, 0.01)]
    labels = bool(data.where("label = 1").limit(1).count())
    return spark.createDataFrame(
        [(k, labels, bool(slope[k] <= 1e-4 * start[k]), bool(all(at[k] <= n[k] + 1e-9 for n in near))) for k in range(6)],
        "fit long, has_labels boolean, stationary boolean, no_better_nearby boolean",
    )


@query(S.with_clean("""words_ AS (SELECT topic, unnest(regexp_extract_all(clean_text, '[a-z0-9_]{2,}')) AS term
  FROM clean),
counts AS (SELECT topic, term, count(*) AS tf FROM words_ GROUP BY ALL),
sizes AS (SELECT topic, sum(tf) AS words FROM counts GROUP BY 1),
idfs AS (SELECT term, ln(1 + (SELECT avg(words) FROM sizes) / sum(tf)) AS idf FROM counts GROUP BY 1)
SELECT topic, term, tf, round(idf, 6) AS idf, round(tf / words * idf, 6) AS score
FROM counts JOIN sizes USING (topic) JOIN idfs USING (term)"""))
def c_tf_idf(spark, sf_dir):
    return B.c_tf_idf(cleaned(spark, sf_dir))


@query(S.with_clean("""words_ AS (SELECT topic, unnest(regexp_extract_all(clean_text, '[a-z0-9_]{2,}')) AS term
  FROM clean),
counts AS (SELECT topic, term, count(*) AS tf FROM words_ GROUP BY ALL),
sizes AS (SELECT topic, sum(tf) AS words FROM counts GROUP BY 1),
idfs AS (SELECT term, ln(1 + (SELECT avg(words) FROM sizes) / sum(tf)) AS idf FROM counts GROUP BY 1),
ranked AS (SELECT topic, term, row_number() OVER (PARTITION BY topic
    ORDER BY tf / words * idf DESC, term) AS r
  FROM counts JOIN sizes USING (topic) JOIN idfs USING (term)),
names AS (SELECT topic, string_agg(term, '_' ORDER BY r) AS words FROM ranked WHERE r <= 3 GROUP BY 1)
SELECT topic, CASE topic WHEN -1 THEN 'outlier' WHEN 3 THEN 'manual name' ELSE words END AS topic_name
FROM names"""))
def topic_name(spark, sf_dir):
    posts = cleaned(spark, sf_dir)
    return B.topic_names(topic_scores(spark, sf_dir), posts, overrides={3: "manual name"})


@query(S.with_posts("""SELECT topic, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM posts GROUP BY topic"""))
def topic_info(spark, sf_dir):
    return B.topic_info(facts(spark, sf_dir))


@query(S.with_facts("""modes AS (SELECT topic_name, emotion, row_number() OVER (PARTITION BY topic_name
    ORDER BY count(*) DESC, emotion) AS r FROM facts WHERE topic <> -1 AND emotion IS NOT NULL
  GROUP BY topic_name, emotion)
SELECT f.topic_name, count(*) AS n, round(avg(toxicity), 6) AS toxicity_mean,
  round(avg(othering_predicted) * 100, 6) AS othering_pct,
  round(avg(othering_score), 6) AS othering_score_mean, any_value(m.emotion) AS top_emotion
FROM facts f LEFT JOIN modes m ON m.topic_name = f.topic_name AND r = 1
WHERE topic <> -1 GROUP BY f.topic_name"""))
def topic_crosstab(spark, sf_dir):
    return B.topic_crosstab(facts(spark, sf_dir))


_STATS = """stats AS (SELECT topic, topic_name, count(*) AS nb_posts, avg(toxicity) AS t,
  avg(othering_predicted) * 100 AS o FROM facts WHERE topic >= 0 GROUP BY ALL)"""
_STATS_COLUMNS = """SELECT topic, topic_name, nb_posts, round(t, 6) AS mean_toxicity,
  round(o, 6) AS pct_othering FROM stats"""


@query(S.with_facts(f"{_STATS} {_STATS_COLUMNS}"))
def topic_stats(spark, sf_dir):
    return B.topic_stats(facts(spark, sf_dir))


@query(S.with_facts(f"""{_STATS} SELECT count(*) AS n_topics, max(nb_posts) AS largest_posts,
  (SELECT topic_name FROM stats ORDER BY nb_posts DESC, topic LIMIT 1) AS largest_topic,
  (SELECT topic_name FROM stats ORDER BY o DESC, topic LIMIT 1) AS most_othering_topic,
  round(max(o), 6) AS most_othering_pct,
  (SELECT count(*) FROM facts WHERE topic = -1) AS n_outliers FROM stats"""))
def topic_headline(spark, sf_dir):
    return B.topic_headline(facts(spark, sf_dir))


@query(S.with_facts(f"{_STATS} {_STATS_COLUMNS} ORDER BY nb_posts DESC, topic LIMIT 5"))
def top_topics(spark, sf_dir):
    return B.top_topics(facts(spark, sf_dir), 5)


@query(S.with_facts(f"{_STATS} {_STATS_COLUMNS} WHERE nb_posts >= 10 ORDER BY o DESC, topic LIMIT 5"))
def top_othering_topics(spark, sf_dir):
    return B.top_othering_topics(facts(spark, sf_dir), 5)


_PLACED = """words_ AS (SELECT post_id, topic,
    unnest(regexp_extract_all(clean_text, '[a-z0-9_]{2,}')) AS term FROM clean),
counts AS (SELECT topic, term, count(*) AS tf FROM words_ GROUP BY ALL),
sizes AS (SELECT topic, sum(tf) AS words FROM counts GROUP BY 1),
idfs AS (SELECT term, ln(1 + (SELECT avg(words) FROM sizes) / sum(tf)) AS idf FROM counts GROUP BY 1),
scores AS (SELECT topic, term, idf, tf / words * idf AS score
  FROM counts JOIN sizes USING (topic) JOIN idfs USING (term) WHERE topic <> -1),
norms AS (SELECT topic, sqrt(sum(score * score)) AS norm FROM scores GROUP BY 1),
in_post AS (SELECT post_id, term, count(*) AS n FROM words_ WHERE topic = -1 GROUP BY ALL),
similar_ AS (SELECT post_id, s.topic, round(sum(n * idf * score / norm), 9) AS similarity
  FROM in_post JOIN scores s USING (term) JOIN norms USING (topic) GROUP BY ALL),
best AS (SELECT post_id, topic, row_number() OVER (PARTITION BY post_id
    ORDER BY similarity DESC, topic) AS r FROM similar_),
placed AS (SELECT c.post_id, c.topic AS topic_before,
    CASE WHEN c.topic <> -1 THEN c.topic ELSE coalesce(b.topic, -1) END AS topic
  FROM clean c LEFT JOIN best b ON b.post_id = c.post_id AND r = 1)"""


@query(S.with_clean(f"{_PLACED} SELECT post_id, topic FROM placed"))
def reduce_outliers(spark, sf_dir):
    texts = cleaned(spark, sf_dir).select("post_id", "topic", "clean_text")
    return B.reduce_outliers(texts, topic_scores(spark, sf_dir)).select("post_id", "topic")


@query(S.with_clean(f"""{_PLACED} SELECT count(*) AS n, count(*) FILTER (WHERE topic_before = -1) AS n_before,
  round(100.0 * count(*) FILTER (WHERE topic_before = -1) / count(*), 6) AS pct_before,
  count(*) FILTER (WHERE topic = -1) AS n_after,
  round(100.0 * count(*) FILTER (WHERE topic = -1) / count(*), 6) AS pct_after FROM placed"""))
def outlier_change(spark, sf_dir):
    texts = cleaned(spark, sf_dir).select("post_id", "topic", "clean_text", F.col("topic").alias("topic_before"))
    return B.outlier_change(B.reduce_outliers(texts, topic_scores(spark, sf_dir)))


@query(S.with_clean("""words_ AS (SELECT topic, unnest(regexp_extract_all(clean_text, '[a-z0-9_]{2,}')) AS term
  FROM clean),
counts AS (SELECT topic, term, count(*) AS tf FROM words_ GROUP BY ALL),
sizes AS (SELECT topic, sum(tf) AS words FROM counts GROUP BY 1),
idfs AS (SELECT term, ln(1 + (SELECT avg(words) FROM sizes) / sum(tf)) AS idf FROM counts GROUP BY 1),
scores AS (SELECT topic, term, tf / words * idf AS score
  FROM counts JOIN sizes USING (topic) JOIN idfs USING (term) WHERE topic <> -1),
norms AS (SELECT topic, sqrt(sum(score * score)) AS norm FROM scores GROUP BY 1)
SELECT x.topic AS a, y.topic AS b, round(sum(x.score * y.score) / any_value(p.norm * q.norm), 6) AS cosine
FROM scores x JOIN scores y ON x.term = y.term AND x.topic < y.topic
JOIN norms p ON p.topic = x.topic JOIN norms q ON q.topic = y.topic GROUP BY x.topic, y.topic"""))
def topic_similarity(spark, sf_dir):
    return B.topic_similarity(topic_scores(spark, sf_dir), k=12)


@query()
def merge_topics(spark, sf_dir):
    """Topic sizes after merging similar topics."""
    posts = cleaned(spark, sf_dir)
    similarity = B.topic_similarity(topic_scores(spark, sf_dir), k=12)
    return B.topic_info(B.merge_topics(posts, similarity, threshold=0.97))


def _vectors(spark, sf_dir):
    return C.as_features(table(spark, sf_dir, "embeddings"))


@query()
def reduce_dims(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    reduced = B.reduce_dims(_vectors(spark, sf_dir), 5)
    values = vector_to_array("reduced")
    return reduced.select("vec_id", *[F.abs(values[i]).alias(f"d{i}") for i in range(5)])


@query()
def cluster_vectors(spark, sf_dir):
    """Clusters of the given embeddings against their labels."""
    reduced = B.reduce_dims(_vectors(spark, sf_dir), 10)
    clustered = B.cluster(reduced, k=10, min_size=5)
    return clustered.groupBy("topic", "label").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS n_vectors, CAST(5 AS BIGINT) AS n_directions, true AS orthonormal, true AS ordered, true AS within_total,
  true AS invariant FROM embeddings""")
def projection_invariants(spark, sf_dir):
    """Main directions are orthonormal, ordered by variance, capture no more than there is, and are
    multiplied by the covariance of the rows into multiples of themselves."""
    vectors = _vectors(spark, sf_dir)
    found = R.main_directions(vectors, 5, rounds=30)
    placed = R.project(vectors, found)
    v = found.vectors
    moments = placed.select(F.posexplode("reduced").alias("d", "x")).groupBy("d").agg(
        F.avg(F.col("x") * F.col("x")).alias("variance")
    ).orderBy("d").collect()
    along = np.array([r["variance"] for r in moments])
    facts_ = {
        "orthonormal": bool(np.allclose(v.T @ v, np.eye(5), atol=1e-8)),
        "ordered": bool((np.diff(found.variance) <= 1e-12).all()), "within_total": found.captured() <= 1 + 1e-9,
        "invariant": bool(np.allclose(along, found.variance, rtol=1e-3)),
    }
    return placed.agg(F.count("*").alias("n_vectors")).withColumns(
        {"n_directions": F.lit(v.shape[1]), **{k: F.lit(x) for k, x in facts_.items()}}
    )


@query("""WITH RECURSIVE points AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y
  FROM embeddings),
near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b,
    (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS away FROM points a JOIN points b
  ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.0225),
core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 20),
links AS MATERIALIZED (SELECT a, b FROM near SEMI JOIN core c ON c.id = a SEMI JOIN core d ON d.id = b),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
lowest AS (SELECT a, min(b) AS cluster FROM reached GROUP BY a),
nearest AS (SELECT a, b FROM near SEMI JOIN core c ON c.id = b WHERE a NOT IN (SELECT id FROM core)
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY away, b) = 1)
SELECT vec_id, coalesce(l.cluster, m.cluster) AS cluster FROM points
LEFT JOIN lowest l ON l.a = vec_id LEFT JOIN nearest n ON n.a = vec_id LEFT JOIN lowest m ON m.a = n.b""")
def density_clusters(spark, sf_dir):
    """Density clusters of all vectors by their first two components; null is noise."""
    points = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("x")
    )
    return D.density_clusters(points, 0.15, 20, "x", "vec_id").select("vec_id", "cluster")
