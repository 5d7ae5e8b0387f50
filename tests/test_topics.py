"""Planted clusters, class-based TF-IDF by hand, outliers, merging, names."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from discourse_spark.operators import topics as B

DOCS = [(1, 0, "apple pear apple"), (2, 0, "pear plum apple"), (3, 1, "car bus car"), (4, 1, "bus tram"),
        (5, -1, "apple plum"), (6, -1, "tram tram pear"), (7, -1, "unseen"), (8, -1, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "post_id long, topic int, clean_text string")


def test_c_tf_idf_by_hand(docs):
    counts = {}
    for _, topic, text in DOCS:
        for word in text.split():
            counts.setdefault(topic, {}).setdefault(word, 0)
            counts[topic][word] += 1
    mean_words = sum(sum(c.values()) for c in counts.values()) / len(counts)
    rows = B.c_tf_idf(docs).collect()
    assert len(rows) == sum(len(c) for c in counts.values())
    for r in rows:
        frequency = sum(c.get(r.term, 0) for c in counts.values())
        share = counts[r.topic][r.term] / sum(counts[r.topic].values())
        assert r.score == pytest.approx(share * math.log(1 + mean_words / frequency))


def python_scores(docs):
    """(topic, term) -> (idf, score) of a list of (topic, text)."""
    counts, frequency = {}, Counter()
    for topic, text in docs:
        counts.setdefault(topic, Counter()).update(text.split())
        frequency.update(text.split())
    counts = {t: c for t, c in counts.items() if c}
    mean_words = sum(frequency.values()) / len(counts)
    idf = {w: math.log(1 + mean_words / n) for w, n in frequency.items()}
    return {(t, w): (idf[w], n / c.total() * idf[w]) for t, c in counts.items() for w, n in c.items()}


def norm(scores, topic):
    return math.sqrt(sum(s * s for (t, _), (_, s) in scores.items() if t == topic))


def test_outliers_move_to_the_closest_topic(docs):
    scores = python_scores([(t, text) for _, t, text in DOCS])
    want = {}
    for i, topic, text in DOCS:
        pull = {t: sum(scores[t, w][0] * scores[t, w][1] for w in text.split() if (t, w) in scores)
                / norm(scores, t) for t in (0, 1)}
        if topic == -1 and max(pull.values()) > 0:
            topic = max(pull, key=pull.get)
        want[i] = topic
    moved = {r.post_id: r.topic for r in B.reduce_outliers(docs).collect()}
    assert moved == want and want[5] == 0 and want[7] == want[8] == -1


def test_terms_are_counted_within_the_row(spark):
    rows = [(1, "pear apple pear fig apple pear"), (2, ""), (3, None), (4, "one"), (4, "one one")]
    df = spark.createDataFrame(rows, "post_id long, clean_text string")
    counted = sorted(map(tuple, B.counted_terms(df, ["post_id"]).collect()))
    want = [(i, w, n) for i, text in rows for w, n in Counter((text or "").split()).items() if len(w) > 1]
    assert counted == sorted((i, w, n) for i, w, n in want)


def test_closest_topic_meets_one_index_row_per_term(docs, spark):
    scores = B.c_tf_idf(docs)
    index, topics = B.pull_index(scores)
    assert topics == sorted({r.topic for r in scores.collect()} - {-1})
    terms = [r.term for r in index.collect()]
    assert len(terms) == len(set(terms))
    outliers = scores.where(F.col("topic") == -1)
    assert B.pull_index(outliers)[1] == []
    assert B.closest_topic(docs, outliers).collect() == []


def test_names(docs, spark):
    scores = B.c_tf_idf(docs)
    extra = docs.unionByName(spark.createDataFrame([(9, 7, "")], docs.schema))
    names = {r.topic: r.topic_name for r in B.topic_names(scores, extra, {1: "traffic"}).collect()}
    assert names[0] == "apple_pear_plum" and names[1] == "traffic"
    assert names[-1] == "outlier" and names[7] == "topic_7"


def test_similarity_and_merging(spark):
    rows = [(0, "aa bb cc"), (1, "aa bb cc"), (2, "xx yy zz"), (3, "aa bb cc dd"), (-1, "aa xx")]
    docs = spark.createDataFrame(rows, "topic int, clean_text string")
    similarity = B.topic_similarity(B.c_tf_idf(docs), k=4)
    found = {(r.a, r.b): r.cosine for r in similarity.collect()}
    assert found[(0, 1)] == pytest.approx(1.0) and (0, 2) not in found
    scores = python_scores(rows)
    both = sum(scores[0, w][1] * scores[3, w][1] for w in ("aa", "bb", "cc"))
    assert found[(0, 3)] == pytest.approx(both / norm(scores, 0) / norm(scores, 3))
    merged = B.merge_topics(docs, similarity, found[(0, 3)] - 0.01).select("topic").collect()
    assert [r.topic for r in merged] == [0, 0, 2, 0, -1]


def test_similarity_sums_over_terms_once(spark, capsys):
    """Pairs and both norms come from one written sum over all terms."""
    scores = spark.range(40).select(
        (F.col("id") % 4).cast("int").alias("topic"), F.concat(F.lit("w"), (F.col("id") / 4).cast("int")).alias("term"),
        F.col("id").cast("double").alias("score"))
    similarity = B.topic_similarity(scores, k=4)
    similarity.explain()
    assert "MapInPandas" not in capsys.readouterr().out
    found = {(r.a, r.b): r.cosine for r in similarity.collect()}
    x = np.arange(40.0).reshape(10, 4)
    norms = np.linalg.norm(x, axis=0)
    assert len(found) == 6
    for a, b in found:
        assert found[a, b] == pytest.approx(x[:, a] @ x[:, b] / (norms[a] * norms[b]))


@pytest.fixture(scope="module")
def blobs(spark):
    """Three far blobs of 60, 40 and 20 points, and one of 3."""
    i = F.col("post_id")
    group = F.when(i < 60, 0).when(i < 100, 1).when(i < 120, 2).otherwise(3)
    noise = [((i * k) % 7).cast("double") / 100 for k in (3, 5, 11, 13)]
    axes = [F.when(group == g, 10.0).otherwise(0.0) + noise[g] for g in range(4)]
    return spark.range(123).withColumnRenamed("id", "post_id").select(
        "post_id", group.alias("truth"), array_to_vector(F.array(*axes)).alias("features"))


def test_planted_clusters_are_recovered(blobs):
    found = B.cluster(B.reduce_dims(blobs, 3), k=4, min_size=5, noise_share=0.0)
    pairs = found.groupBy("truth", "topic").count().collect()
    assert {(r.truth, r.topic): r["count"] for r in pairs} == {(0, 0): 60, (1, 1): 40, (2, 2): 20, (3, -1): 3}


def test_bisecting_clusters_keep_the_contract(blobs):
    found = B.cluster(B.reduce_dims(blobs, 3), k=4, min_size=25, noise_share=0.0, bisecting=True)
    sizes = {r.topic: r["count"] for r in found.groupBy("topic").count().collect()}
    kept = [sizes[t] for t in sorted(sizes) if t >= 0]
    assert sum(sizes.values()) == 123 and kept == sorted(kept, reverse=True) and min(kept) >= 25


def test_far_points_are_noise(blobs):
    found = B.cluster(B.reduce_dims(blobs, 3), k=4, min_size=5, noise_share=0.2)
    noise = found.where("topic = -1 AND truth = 0").count()
    assert 0 < noise <= 12


def test_sizes_and_statistics(spark):
    assert (B.min_topic_size(), B.min_topic_size(300), B.min_topic_size(1500)) == (20, 5, 10)
    rows = [(0, "a", 0.5, 1, "joy", 2)] * 12 + [(1, "b", None, 0, None, 0)] * 9 + [(-1, "outlier", 0.1, 0, "joy", 0)]
    df = spark.createDataFrame(
        rows, "topic int, topic_name string, toxicity double, othering_predicted int, emotion string, othering_score int")
    assert [(r.topic, r.nb_posts) for r in B.top_topics(df, 5).collect()] == [(0, 12), (1, 9)]
    assert [r.topic for r in B.top_othering_topics(df, 5).collect()] == [0]
    head = B.topic_headline(df).first()
    assert (head.n_topics, head.largest_topic, head.most_othering_topic, head.n_outliers) == (2, "a", "a", 1)
    cross = {r.topic_name: r for r in B.topic_crosstab(df).collect()}
    assert cross["a"].top_emotion == "joy" and cross["b"].top_emotion is None
    assert B.topic_info(df).agg(F.sum("pct")).first()[0] == pytest.approx(100)


def test_whole_topic_model(spark):
    i = F.col("post_id")
    text = F.when(i % 3 == 0, "apple pear plum fruit").when(i % 3 == 1, "car bus tram road").otherwise(
        "rain snow wind cloud")
    df = spark.range(90).withColumnRenamed("id", "post_id").select("post_id", text.alias("clean_text"))
    modelled = B.model_topics(df, k=3, dims=3, min_size=5, keep_before=True)
    change = B.outlier_change(modelled).first()
    assert change.n == df.count() and change.n_after <= change.n_before
    assert change.pct_before == pytest.approx(100 * change.n_before / change.n)
    rows = modelled.groupBy("clean_text").agg(
        F.countDistinct("topic").alias("n"), F.first("topic_name").alias("name")).collect()
    assert len(rows) == 3 and all(r.n == 1 for r in rows)
    assert {r.name for r in rows} == {"apple_fruit_pear", "bus_car_road", "cloud_rain_snow"}


def test_outlier_change_of_no_rows(spark):
    empty = spark.createDataFrame([], "topic int, topic_before int")
    assert tuple(B.outlier_change(empty).first()) == (0, 0, None, 0, None)


def test_topics_are_modelled_from_one_reading_of_the_input(spark, monkeypatch):
    """Each text is made once, its terms are counted once, and counts of merged topics are those of their posts."""
    made, counted, class_terms = spark.sparkContext.accumulator(0), [], B.class_terms
    monkeypatch.setattr(B, "class_terms", lambda df, *a: counted.append(df.count()) or class_terms(df, *a))

    @F.udf("string")
    def make(i):
        made.add(1)
        kind = ("apple pear plum fruit", "apple pear plum juice", "car bus tram road")[i % 3]
        return kind + "".join(f" w{(i * j) % 61}" for j in range(1, 2 + i % 9))

    df = spark.range(120).select(F.col("id").alias("post_id"), make("id").alias("clean_text"))
    modelled = B.model_topics(df, k=4, dims=3, min_size=5, merge_above=0.3, keep_before=True).collect()
    assert made.value == len(modelled) == 120
    outliers = sum(r.topic_before == -1 for r in modelled)
    assert counted == [120, outliers] and outliers > 0
    monkeypatch.undo()
    again = spark.createDataFrame(modelled).drop("topic_name")
    names = {r.topic: r.topic_name for r in modelled}
    assert len(names) < 4
    assert names == {r.topic: r.topic_name for r in B.add_topic_names(again).collect()}
