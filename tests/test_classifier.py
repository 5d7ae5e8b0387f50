"""Features against a hand computation, models on separable data, metrics, storage."""

import inspect
import math
import re
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from discourse_spark.operators import classifier as C
from discourse_spark.operators import sampling as P

TEXTS = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "", None, "cat cat cat dog"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "post_id long, clean_text string")


def python_tfidf(texts, max_features, min_df):
    grams = []
    for t in texts:
        w = re.findall(r"\b\w\w+\b", t or "")
        grams.append(Counter(w + [" ".join(p) for p in zip(w, w[1:])]))
    tf, df = Counter(), Counter()
    for g in grams:
        tf.update(g)
        df.update(g.keys())
    kept = sorted((t for t in tf if df[t] >= min_df), key=lambda t: (-tf[t], t))[:max_features]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in kept}
    vectors = []
    for g in grams:
        v = {t: (1 + math.log(g[t])) * idf[t] for t in kept if t in g}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vectors.append({t: x / norm for t, x in v.items()})
    return idf, vectors


@pytest.mark.parametrize("max_features", [1, 3, 50])
def test_tfidf_equals_hand_computation(texts, max_features):
    idf, vectors = python_tfidf(TEXTS, max_features, 2)
    found = {r.term: r.idf for r in C.tfidf_vocabulary(texts, max_features=max_features).collect()}
    assert found == pytest.approx(idf)
    model = C.fit_tfidf(texts, max_features=max_features)
    names = model.stages[1].vocabulary
    for row in model.transform(texts).collect():
        got = {names[int(i)]: v for i, v in zip(row.features.indices, row.features.values)}
        assert got == pytest.approx(vectors[row.post_id])


def test_vocabulary_cuts_ties_by_term(spark):
    df = spark.createDataFrame([(" ".join(f"w{i:03}" for i in range(200)),)] * 2 + [("top w199 top",)] * 2,
                               "clean_text string")
    terms = [r.term for r in C.tfidf_vocabulary(df, max_features=40).collect()]
    counts = C.term_statistics(df).where("df >= 2").collect()
    assert sorted(terms) == sorted(r.term for r in sorted(counts, key=lambda r: (-r.tf, r.term))[:40])
    assert C.tfidf_vocabulary(df.limit(0)).count() == 0


def test_empty_vocabulary_is_an_error(spark):
    df = spark.createDataFrame([("one two",)], "clean_text string")
    with pytest.raises(ValueError):
        C.fit_tfidf(df)


@pytest.fixture(scope="module")
def separable(spark):
    i = F.col("post_id")
    label = (i % 4 == 0).cast("int")
    filler = F.element_at(F.array(*[F.lit(w) for w in ["red", "green", "blue"]]), (i % 3 + 1).cast("int"))
    word = F.when(label == 1, "send them back").otherwise("nice garden")
    df = spark.range(200).withColumnRenamed("id", "post_id").select(
        "post_id", F.concat_ws(" ", filler, word).alias("clean_text"), label.alias("label"))
    return P.train_test_split(df, "label")


def test_models_separate_toy_data_and_store(separable, tmp_path):
    fitted, comparison = C.train_models(separable, features=("TF-IDF", "Hashed"), folds=2, max_iter=10)
    rows = comparison.orderBy("trained").collect()
    assert [(r.model, r.features) for r in rows] == [
        ("LogisticRegression", "TF-IDF"), ("LinearSVC", "TF-IDF"),
        ("LogisticRegression", "Hashed"), ("LinearSVC", "Hashed")]
    assert all(r.f1 == 1.0 and r.tp == 10 and r.tn == 30 for r in rows)
    best = C.select_best(fitted, comparison)
    assert best.name == "LogisticRegression_TFIDF"
    best.save(str(tmp_path))
    again = C.OtheringClassifier.load(str(tmp_path), best.name)
    a = best.classify(separable.select("post_id", "clean_text"))
    b = again.classify(separable.select("post_id", "clean_text"))
    assert a.exceptAll(b).isEmpty() and a.columns == [
        "post_id", "clean_text", "othering_predicted", "othering_proba"]
    document = C.metrics_document(best, separable, comparison).first()
    assert (document.n_train, document.n_test, document.n_pos_train, document.n_pos_test) == (160, 40, 40, 10)
    assert document.confusion_matrix == [[30, 0], [0, 10]] and len(document.all_models) == 4


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


class WordEncoder:
    def __call__(self, texts):
        return [[t.count("them"), t.count("garden"), len(t) / 100] for t in texts]


def test_models_on_embeddings(separable, tmp_path):
    fitted, comparison = C.train_models(separable, features=("Embeddings",), encoder=WordEncoder, folds=2)
    assert [(r.features, r.f1) for r in comparison.collect()] == [("Embeddings", 1.0)] * 2
    best = C.select_best(fitted, comparison)
    best.save(str(tmp_path))
    again = C.OtheringClassifier.load(str(tmp_path), best.name)
    odd = separable.selectExpr("post_id", "if(post_id = 1, null, clean_text) clean_text", "'kept' embedding")
    a, b = best.classify(odd), again.classify(odd)
    assert a.exceptAll(b).isEmpty() and a.count() == 200
    assert a.where("embedding = 'kept' and othering_predicted is not null").count() == 200


@pytest.mark.parametrize("options", [
    {"features": ("Hased",)}, {"features": ("Embeddings",)},
    {"features": ("Embeddings",), "encoder": lambda: WordEncoder()},
])
def test_unknown_features_are_an_error(separable, options):
    with pytest.raises(ValueError):
        C.train_models(separable, **options)


def test_training_is_not_cut_by_default():
    """Iterations and calibration folds are those of the reference."""
    defaults = {k: p.default for k, p in inspect.signature(C.fit_linear_svc).parameters.items()}
    assert defaults["max_iter"] >= 2000 and defaults["folds"] == 5


def test_metrics_and_report(spark):
    rows = [(1, 1, 1, "a"), (2, 1, 0, "b\nc"), (3, 0, 1, "d"), (4, 0, 0, "e"), (5, 0, 0, "f")]
    df = spark.createDataFrame(rows, "post_id long, y int, p int, clean_text string")
    m = C.binary_metrics(df, "y", "p").first()
    assert (m.tp, m.fp, m.fn, m.tn, m.precision, m.recall, m.f1) == (1, 1, 1, 2, 0.5, 0.5, 0.5)
    report = {r["class"]: r for r in C.classification_report(df, "y", "p").collect()}
    assert report["no_othering"].precision == pytest.approx(2 / 3)
    assert report["macro avg"].f1 == pytest.approx((0.5 + 2 / 3) / 2)
    assert report["weighted avg"].support == 5
    wrong = C.error_examples(df, "y", "p").collect()
    assert [(r.post_id, r.true_label, r.preview) for r in wrong] == [
        (2, "othering", "b c"), (3, "no_othering", "d")]
    nothing = C.binary_metrics(df.where("y = 0 AND p = 0"), "y", "p").first()
    assert (nothing.precision, nothing.recall, nothing.f1) == (0.0, 0.0, 0.0)


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    weights = {(r.label, round(r.weight, 4)) for r in C.balanced_weights(df, "label").collect()}
    assert weights == {(1, 2.0), (0, 0.6667)}


def test_embedding_cache_encodes_only_new_posts(spark, texts, tmp_path):
    seen = []

    def encode(df):
        seen.append(sorted(r.post_id for r in df.collect()))
        return df.withColumn("embedding", F.array(F.lit(1.0)))

    path = str(tmp_path / "cache.parquet")
    C.embedding_cache(texts.where("post_id < 2"), path, encode)
    assert C.embedding_cache(texts, path, encode).count() == len(TEXTS)
    assert seen == [[0, 1], [2, 3, 4, 5]]
