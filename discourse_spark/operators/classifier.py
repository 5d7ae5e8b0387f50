"""Divisive-language classifier: TF-IDF or dense features, two linear models, metrics."""

from __future__ import annotations

import importlib
import operator
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import (
    CountVectorizer,
    ElementwiseProduct,
    HashingTF,
    Normalizer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discourse_spark.functions.text import bigrams, tokens
from discourse_spark.operators.analytics import rows
from discourse_spark.operators.newton import LOGISTIC, SQUARED_HINGE, Block, blocks, newton
from discourse_spark.operators.ranks import with_running_total
from discourse_spark.operators.sampling import hash_key, random_sample
from discourse_spark.operators.store import KeyedStore, once_per_text
from discourse_spark.session import materialize

MAX_FEATURES = 50_000
MIN_DF = 2
TOLERANCE = 1e-4


def with_grams(df: DataFrame, text_col: str = "clean_text", name: str = "grams") -> DataFrame:
    """Add words and word pairs of a cleaned text, with repeats.

    The words get a column of their own first, so that they are extracted once.
    """
    words = df.withColumn("_words", tokens(F.coalesce(F.col(text_col), F.lit(""))))
    both = F.concat(F.col("_words"), bigrams(F.col("_words")))
    return words.withColumn(name, both).drop("_words")


def term_statistics(df: DataFrame, text_col: str = "clean_text") -> DataFrame:
    """Per term: total frequency and number of posts, in one scan and one shuffle.

    In a sorted row a term's first occurrence is the one that differs from the
    entry before it, so every occurrence is exploded once.
    """
    ordered = with_grams(df.select(text_col), text_col, "g").select(F.sort_array("g").alias("g"))
    shifted = F.concat(F.array(F.lit(None).cast("string")), F.col("g"))
    pairs = ordered.select(F.inline(F.arrays_zip("g", shifted))).toDF("term", "before")
    first = F.col("before").isNull() | (F.col("before") != F.col("term"))
    return (
        pairs.where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(rows().alias("tf"), F.count_if(first).alias("df"))
    )


def tfidf_vocabulary(df: DataFrame, text_col: str = "clean_text",
                     max_features: int = MAX_FEATURES, min_df: int = MIN_DF) -> DataFrame:
    """The ``max_features`` most frequent terms of at least ``min_df`` posts, with smooth idf.

    Term counts are written once. How many terms have a frequency of how many binary digits,
    64 rows at most, gives the shortest one that can make the cut. The terms from there on are
    numbered in ranges of frequency and term, ties too, so no task holds the vocabulary.
    """
    terms = materialize(term_statistics(df, text_col).where(F.col("df") >= min_df), "terms")
    digits = F.length(F.bin("tf"))
    sizes = dict(sorted(terms.groupBy(digits).agg(rows()).collect(), reverse=True))
    shortest, above = 0, 0
    for length, n in sizes.items():
        if above < max_features:
            shortest, above = length, above + n
    near = terms.where(digits >= shortest).withColumn("_less", -F.col("tf"))
    n_docs = df.agg(rows()).scalar()
    return (
        with_running_total(near, ["_less", "term"]).where(F.col("_running") <= max_features)
        .drop("_less", "_running")
        .withColumn("idf", F.log((n_docs + 1) / (F.col("df") + 1)) + 1)
    )


class Grams(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Stage: cleaned text to words and word pairs."""

    def __init__(self, inputCol: str = "clean_text", outputCol: str = "grams") -> None:
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return with_grams(dataset, self.getInputCol(), self.getOutputCol())


def vector_fields(vector: Column) -> Column:
    """A sparse vector column as its struct with ``type``, ``size``, ``indices`` and ``values``."""
    return F.unwrap_udt(vector)


class SublinearTf(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                  DefaultParamsWritable):
    """Stage: replace each count of a sparse vector by ``1 + ln(count)``."""

    def __init__(self, inputCol: str = "counts", outputCol: str = "sublinear") -> None:
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fields = vector_fields(F.col(self.getInputCol()))
        damped = fields.withField("values", F.transform(fields["values"], lambda x: 1 + F.log(x)))
        as_vector = T.StructType([T.StructField("v", VectorUDT())])
        rebuilt = F.from_json(F.to_json(F.struct(damped.alias("v"))), as_vector)["v"]
        return dataset.withColumn(self.getOutputCol(), rebuilt)


def fit_tfidf(df: DataFrame, text_col: str = "clean_text", max_features: int = MAX_FEATURES,
              min_df: int = MIN_DF) -> PipelineModel:
    """TF-IDF features (sublinear counts, smooth idf, unit length) as a fitted pipeline.

    Only the vocabulary, at most ``max_features`` terms, comes to the driver.
    Transforming needs no shuffle: each post is counted inside its own row.
    """
    vocabulary = materialize(
        tfidf_vocabulary(df, text_col, max_features, min_df).select("term", "idf"), "vocabulary"
    )
    idf = {r["term"]: r["idf"] for r in vocabulary.collect()}
    if not idf:
        raise ValueError("no term occurs in enough texts")
    counter = CountVectorizer(
        inputCol="grams", outputCol="counts", vocabSize=max_features, minDF=1.0
    )
    counts = counter.fit(vocabulary.select(F.array("term").alias("grams")))
    stages = [
        Grams(inputCol=text_col, outputCol="grams"),
        counts,
        SublinearTf(inputCol="counts", outputCol="sublinear"),
        ElementwiseProduct(
            scalingVec=Vectors.dense([idf[t] for t in counts.vocabulary]),
            inputCol="sublinear", outputCol="weighted",
        ),
        Normalizer(p=2.0, inputCol="weighted", outputCol="features"),
    ]
    return PipelineModel(stages)


def hashed_features(text_col: str = "clean_text", size: int = 256) -> PipelineModel:
    """Dense-size features without a vocabulary: hashed words, unit length."""
    stages = [
        Grams(inputCol=text_col, outputCol="grams"),
        HashingTF(inputCol="grams", outputCol="counts", numFeatures=size),
        Normalizer(p=2.0, inputCol="counts", outputCol="features"),
    ]
    return PipelineModel(stages)


Encoder = Callable[[list[str]], "list[list[float]]"]


def embed_texts(df: DataFrame, load: Callable[[], Encoder], text_col: str = "clean_text",
                batch_size: int = 256, output_col: str = "embedding") -> DataFrame:
    """Add ``embedding`` from a pluggable encoder, loaded once per task."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for series in batches:
            vectors: list = []
            for start in range(0, len(series), batch_size):
                vectors.extend(encode(series.iloc[start:start + batch_size].tolist()))
            yield pd.Series([list(map(float, v)) for v in vectors])

    return df.withColumn(output_col, embed(F.coalesce(F.col(text_col), F.lit(""))))


class Embedding(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                DefaultParamsWritable):
    """Stage: texts to dense vectors by an encoder.

    The encoder's loader is kept as ``module:name``, so that a stored pipeline finds it again.
    """

    loader = Param(Params._dummy(), "loader", "the encoder's loader as module:name", TypeConverters.toString)

    def __init__(self, inputCol: str = "clean_text", outputCol: str = "features",
                 loader: str | None = None) -> None:
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, loader=loader)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        module, name = self.getOrDefault(self.loader).split(":")
        load = operator.attrgetter(name)(importlib.import_module(module))
        column = self.getOutputCol()
        embedded = embed_texts(dataset, load, self.getInputCol(), output_col=column)
        return embedded.withColumn(column, array_to_vector(F.col(column).cast("array<double>")))


def embedded_features(load: Callable[[], Encoder], text_col: str = "clean_text") -> PipelineModel:
    """Dense features from an encoder, whose loader must be a function or class of a module."""
    if "<" in load.__qualname__:
        raise ValueError("the encoder's loader must be importable by its name")
    return PipelineModel([Embedding(text_col, "features", f"{load.__module__}:{load.__qualname__}")])


def embedding_cache(df: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame],
                    id_col: str = "post_id") -> DataFrame:
    """Embeddings by id, kept in a store: only posts not yet there are encoded. Null ids are left out."""
    store = KeyedStore(df.sparkSession, path, id_col)
    encoded = encode(store.without_known(df).drop("_bucket")).select(id_col, "embedding")
    store.add(encoded)
    stored = store.read()
    return encoded if stored is None else stored.drop("_bucket")


def embed_once(df: DataFrame, path: str, load: Callable[[], Encoder], text_col: str = "clean_text",
               id_col: str = "post_id", ranges: int = 16, tries: int = 1) -> DataFrame:
    """Add ``embedding``, kept by content: copies of a text and texts of earlier calls cost nothing."""
    def encode(texts: DataFrame) -> DataFrame:
        return embed_texts(texts, load, text_col)

    return once_per_text(df, path, encode, text_col, id_col, ranges, tries)


def as_features(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight`` = n / (2 * class size) for a 0/1 label, from one aggregation."""
    positive = F.col(label).cast("int") == 1
    sizes = df.agg(
        F.struct(rows().alias("n"), F.count_if(positive).alias("positive"))
    ).scalar()
    of_class = F.when(positive, sizes["positive"]).otherwise(sizes["n"] - sizes["positive"])
    return df.withColumn("weight", sizes["n"] / (2 * of_class))


def fit_logistic(train: DataFrame, n: int, label: str = "label", c: float = 1.0) -> PipelineModel:
    """Balanced, L2-regularised logistic regression on ``features``."""
    model = LogisticRegression(
        labelCol=label, weightCol="weight", regParam=1.0 / (c * n), elasticNetParam=0.0,
        standardization=False, maxIter=1000, tol=TOLERANCE,
    )
    return Pipeline(stages=[model]).fit(balanced_weights(train, label))


def fit_linear_svc(train: DataFrame, n: int, label: str = "label", c: float = 1.0,
                   folds: int = 5, max_iter: int = 2000, id_col: str = "post_id") -> PipelineModel:
    """Balanced linear SVC (squared hinge, intercept in the penalty) with calibrated probabilities.

    The model and those of all folds are fitted in one sweep. Each fold's margins come
    from the model that has not seen it; one logistic curve over all of them, with smoothed
    targets, turns margins into probabilities. Margin and curve are linear in the features, so
    what comes back is one linear model.
    """
    fits, size, _ = svc_fits(train, label, c, folds, max_iter, id_col)
    slope, offset = fits.curve
    weights = slope * fits.weights[0]
    spark = train.sparkSession
    java = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        f"calibrated-svc-{uuid.uuid4().hex[:12]}", _py2java(spark.sparkContext, Vectors.dense(weights[:size].tolist())),
        float(weights[size] + offset),
    )
    return PipelineModel([LogisticRegressionModel(java)])


@dataclass
class SvcFits:
    """Weights of the whole fit and of each fold's, objectives, passes, and the curve's slope and offset."""

    weights: np.ndarray
    objective: np.ndarray
    passes: int
    curve: tuple[float, float]


def svc_fits(train: DataFrame, label: str, c: float, folds: int, max_iter: int,
             id_col: str) -> tuple[SvcFits, int, DataFrame]:
    """The fits behind ``fit_linear_svc``, the number of features, and the rows in blocks."""
    first = train.select("features").where("features is not null").first()
    size = first[0].size if first else 0
    fold = F.pmod(hash_key(11, id_col), F.lit(folds))
    weighted = balanced_weights(train, label).select("features", label, "weight", *[
        F.when(fold != k, F.col("weight")).otherwise(0.0).alias(f"_without{k}") for k in range(folds)
    ])
    names = ["weight", *[f"_without{k}" for k in range(folds)]]
    blocked = blocks(weighted, "features", label, names)
    fit = newton(blocked, size, folds + 1, SQUARED_HINGE, 1.0 / c, penalise_intercept=True, max_steps=max_iter)
    curve = newton(_held_out_margins(blocked, fit.weights), 1, 1, LOGISTIC, penalty=0.0, max_steps=max_iter)
    return SvcFits(fit.weights, fit.objective, fit.passes, tuple(curve.weights[0])), size, blocked


def _held_out_margins(blocked: DataFrame, weights: np.ndarray) -> DataFrame:
    """Blocks of (margin, target), each row by the model of the fold that left it out. A row
    comes twice, weighted by its smoothed target and by the rest of it."""

    def margins(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                block = Block(part.slice(i, 1).to_pylist()[0])
                own = block.weights[1:].argmin(axis=0) + 1  # the fold in which it weighs nothing
                every = block.dot(weights)[own, np.arange(len(own))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every), pa.array(block.targets > 0.5)], names=["margin", "positive"]
                )

    rows_ = blocked.mapInArrow(margins, "margin double, positive boolean")
    sizes = rows_.agg(rows().alias("n"), F.count_if("positive").alias("p")).first()
    high, low = (sizes["p"] + 1) / (sizes["p"] + 2), 1 / (sizes["n"] - sizes["p"] + 2)
    target = F.when(F.col("positive"), high).otherwise(low)
    sides = F.inline(F.array(
        F.struct(F.lit(1.0).alias("label"), target.alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - target).alias("w"))
    ))
    return blocks(
        rows_.select(array_to_vector(F.array("margin")).alias("features"), sides), "features", "label", ["w"]
    )


def classify(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add othering_predicted (0/1) and othering_proba (4 decimals)."""
    scored = model.transform(df).withColumns(
        {
            "othering_predicted": F.col("prediction").cast("int"),
            "othering_proba": F.round(vector_to_array("probability")[1], 4),
        }
    )
    return scored.select(
        *[c for c in df.columns if c not in ("othering_predicted", "othering_proba")],
        "othering_predicted", "othering_proba",
    )


class OtheringClassifier:
    """A fitted feature-and-model pipeline that can be stored and applied."""

    def __init__(self, name: str, model: PipelineModel) -> None:
        self.name = name
        self.model = model

    def classify(self, df: DataFrame) -> DataFrame:
        return classify(df, self.model)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/{self.name}")

    @staticmethod
    def load(path: str, name: str) -> OtheringClassifier:
        return OtheringClassifier(name, PipelineModel.load(f"{path}/{name}"))


def train_models(split: DataFrame, label: str = "label", features: tuple[str, ...] = ("TF-IDF",),
                 text_col: str = "clean_text", id_col: str = "post_id",
                 encoder: Callable[[], Encoder] | None = None,
                 **options) -> tuple[list[OtheringClassifier], DataFrame]:
    """Train both models on each kind of features; return them with a comparison table.

    ``split`` has a ``split`` column (train/test). Kinds are ``TF-IDF``, ``Hashed`` and
    ``Embeddings``, which needs an ``encoder`` loader. Features are written once per
    kind, because every optimiser step reads them again.
    """
    featurizers = {
        "TF-IDF": lambda: fit_tfidf(train, text_col),
        "Hashed": lambda: hashed_features(text_col),
    }
    if encoder is not None:
        featurizers["Embeddings"] = lambda: embedded_features(encoder, text_col)
    if unknown := set(features) - set(featurizers):
        raise ValueError(f"no such features: {sorted(unknown)}; there are {sorted(featurizers)}")
    data = split.select(id_col, "split", text_col, F.col(label).cast("double").alias("label"))
    train = data.where(F.col("split") == "train")
    n_train = train.count()
    fitted, comparison = [], None
    for kind in features:
        featurizer = featurizers[kind]()
        ready = materialize(
            featurizer.transform(data).select(id_col, "split", "label", "features"), "features"
        )
        train_ready = ready.where(F.col("split") == "train")
        test_ready = ready.where(F.col("split") == "test")
        for name, fit in (("LogisticRegression", fit_logistic), ("LinearSVC", fit_linear_svc)):
            extra = options if name == "LinearSVC" else {}
            model = fit(train_ready, n_train, **extra)
            scored = classify(test_ready, model)
            metrics = binary_metrics(scored, "label", "othering_predicted").select(
                F.lit(name).alias("model"), F.lit(kind).alias("features"), "*",
                F.lit(len(fitted)).alias("trained"),
            )
            comparison = metrics if comparison is None else comparison.unionByName(metrics)
            whole = PipelineModel([*featurizer.stages, *model.stages])
            fitted.append(OtheringClassifier(f"{name}_{kind.replace('-', '')}", whole))
    return fitted, materialize(comparison, "comparison")


def select_best(fitted: list[OtheringClassifier], comparison: DataFrame) -> OtheringClassifier:
    """Highest F1; the earlier model wins a tie. The comparison has one row per model."""
    best = comparison.orderBy(F.desc("f1"), "trained").first()
    return fitted[best["trained"]]


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def binary_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: confusion matrix, precision, recall and F1; undefined ratios are 0."""
    truth, guess = F.col(label).cast("int") == 1, F.col(predicted).cast("int") == 1
    counts = df.agg(
        F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    truth, guess = F.col(label).cast("int"), F.col(predicted).cast("int")
    cells = df.groupBy(truth.alias("t"), guess.alias("p")).agg(rows().alias("n"))
    # each cell counts for its true class and for its predicted class
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("t").alias("c"), F.col("n").alias("support"),
                         F.lit(0).cast("long").alias("guessed"),
                         F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("support"),
                         F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hit")),
            )
        )
    )
    per_class = sides.groupBy("c").agg(
        F.sum("support").alias("support"), F.sum("guessed").alias("guessed"),
        F.sum("hit").alias("hit"),
    )
    scored = per_class.select(
        F.when(F.col("c") == 1, "othering").otherwise("no_othering").alias("class"),
        _ratio(F.col("hit"), F.col("guessed")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("guessed") + F.col("support")).alias("f1"),
        "support",
    )
    measures = ["precision", "recall", "f1"]
    macro = scored.agg(*[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support"))
    weighted = scored.agg(
        *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("support"),
    )
    return (
        scored.unionByName(macro.withColumn("class", F.lit("macro avg")))
        .unionByName(weighted.withColumn("class", F.lit("weighted avg")))
    )


def error_examples(df: DataFrame, label: str, predicted: str, n: int = 10,
                   text_col: str = "clean_text", id_col: str = "post_id") -> DataFrame:
    """The first ``n`` wrong predictions with a preview."""
    truth, guess = F.col(label).cast("int"), F.col(predicted).cast("int")

    def name(flag: Column) -> Column:
        return F.when(flag == 1, "othering").otherwise("no_othering")

    return (
        df.where(truth != guess).orderBy(id_col).limit(n)
        .select(
            id_col, name(truth).alias("true_label"), name(guess).alias("predicted_label"),
            F.translate(F.substring(text_col, 1, 120), "\n", " ").alias("preview"),
        )
    )


def with_proxy(df: DataFrame) -> DataFrame:
    """Stand-in truth: toxic above 0.5 and out-group pronouns."""
    proxy = (F.coalesce("toxicity", F.lit(0.0)) > 0.5) & F.coalesce("has_them", F.lit(False))
    return df.withColumn("proxy", proxy)


def proxy_validation(df: DataFrame, n: int = 100, **key) -> DataFrame:
    """Metrics of the rules against the stand-in truth on ``n`` sampled posts."""
    sample = with_proxy(random_sample(df, n, **key))
    return binary_metrics(sample, "proxy", "has_othering")


def proxy_examples(df: DataFrame, agree: bool, n: int = 10, sample: int = 100, **key) -> DataFrame:
    """Flagged posts of the sample on which the stand-in truth agrees, or disagrees."""
    flagged = with_proxy(random_sample(df, sample, **key)).where(
        F.col("has_othering") & (F.col("proxy") == agree)
    )
    return flagged.orderBy("post_id").limit(n)


def metrics_document(best: OtheringClassifier, split: DataFrame, comparison: DataFrame,
                     label: str = "label") -> DataFrame:
    """One nested row describing the chosen model, ready for ``write.json``."""
    flag = F.col(label).cast("int")
    sizes = split.agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
        F.count_if((F.col("split") == "train") & (flag == 1)).alias("n_pos_train"),
        F.count_if((F.col("split") == "test") & (flag == 1)).alias("n_pos_test"),
    )
    entry = F.struct(
        "model", "features", F.round("precision", 4).alias("precision"),
        F.round("recall", 4).alias("recall"), F.round("f1", 4).alias("f1"),
    )
    ordered = comparison.agg(
        F.max_by(F.struct("*"), F.struct(F.col("f1"), -F.col("trained"))).alias("best"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("trained", entry.alias("entry")))),
            lambda x: x["entry"],
        ).alias("all_models"),
    )
    one = ordered.select(
        F.lit(best.name).alias("model_name"),
        F.round("best.precision", 4).alias("precision"),
        F.round("best.recall", 4).alias("recall"),
        F.round("best.f1", 4).alias("f1"),
        F.array(F.array("best.tn", "best.fp"), F.array("best.fn", "best.tp"))
        .alias("confusion_matrix"),
        "all_models",
    )
    return one.withColumns({c: sizes.select(c).scalar() for c in sizes.columns})
