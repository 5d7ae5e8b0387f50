"""Topics: vectors to clusters, class-based TF-IDF, names, outliers, statistics.

Clusters are numbered from 0; -1 marks posts that belong to none. The number of
topics is bounded by the ``k`` given to ``cluster``, which bounds every table
with one row per topic or pair of topics.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discourse_spark.functions.text import tokens
from discourse_spark.operators.analytics import percent, rows, top_value_per_group
from discourse_spark.operators.classifier import hashed_features
from discourse_spark.operators.density import density_clusters, with_topics
from discourse_spark.operators.projection import main_directions, project
from discourse_spark.operators.skew import salted_join
from discourse_spark.session import materialize

OUTLIER = -1


def min_topic_size(n_rows: int | None = None) -> int:
    """20 on a full run, ``max(5, n // 150)`` on a capped or uploaded one."""
    return 20 if n_rows is None else max(5, n_rows // 150)


def reduce_dims(df: DataFrame, k: int = 5, features: str = "features") -> DataFrame:
    """Unit-length vectors projected on their ``k`` main directions, as vectors ``reduced``.

    Vectors may be as wide as a vocabulary. Null vectors stay null.
    """
    unit = Normalizer(p=2.0, inputCol=features, outputCol="_unit").transform(df.where(F.col(features).isNotNull()))
    found = main_directions(unit, k, "_unit")
    placed = project(unit, found, "_unit", "_placed").withColumn("reduced", array_to_vector("_placed"))
    return placed.drop("_unit", "_placed").unionByName(
        df.where(F.col(features).isNull()), allowMissingColumns=True
    )


def cluster_by_density(df: DataFrame, radius: float, min_points: int, min_size: int = 20,
                       features: str = "reduced", id_col: str = "post_id") -> DataFrame:
    """Add ``topic`` by density: clusters of core points by size, largest 0; noise and clusters
    below ``min_size`` are -1. No share of the points is noise beforehand."""
    is_array = dict(df.dtypes)[features].startswith("array")
    plain = df.withColumn("_x", F.col(features) if is_array else vector_to_array(features))
    found = density_clusters(plain, radius, min_points, "_x", id_col)
    return with_topics(found, min_size).drop("_x", "cluster")


def _squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g)


def cluster(df: DataFrame, k: int, min_size: int = 20, noise_share: float = 0.05,
            features: str = "reduced", seed: int = 42, bisecting: bool = False) -> DataFrame:
    """Add ``topic``: clusters by size, largest 0; small clusters and far points are -1.

    A point is far when its distance to the centre is in the last ``noise_share``
    of its cluster.
    """
    method = BisectingKMeans if bisecting else KMeans
    model = method(k=k, seed=seed, featuresCol=features, predictionCol="_cluster").fit(df)
    spark = df.sparkSession
    centers = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        "_cluster int, _center array<double>",
    )
    placed = (
        model.transform(df)
        .join(F.broadcast(centers), "_cluster")
        .withColumn(
            "_distance", _squared_distance(vector_to_array(features), F.col("_center"))
        )
        .drop("_center")
    )
    sizes = placed.groupBy("_cluster").agg(
        rows().alias("_size"),
        F.percentile_approx("_distance", F.lit(1 - noise_share), F.lit(10000)).alias("_limit"),
    )
    by_size = Window.orderBy(F.desc("_size"), "_cluster")
    named = sizes.where(F.col("_size") >= min_size).select(
        "_cluster", "_limit", (F.row_number().over(by_size) - 1).alias("_topic")
    )
    joined = placed.join(F.broadcast(named), "_cluster", "left")
    inside = F.col("_distance") <= F.col("_limit")
    return joined.withColumn(
        "topic", F.when(inside, F.col("_topic")).otherwise(OUTLIER).cast("int")
    ).drop("_cluster", "_distance", "_limit", "_topic")


def class_terms(df: DataFrame, topic: str = "topic", text_col: str = "clean_text") -> DataFrame:
    words = F.explode(tokens(F.coalesce(F.col(text_col), F.lit(""))))
    return df.select(F.col(topic).alias("topic"), words.alias("term")).groupBy(
        "topic", "term"
    ).agg(rows().alias("tf"))


def term_weights(counts: DataFrame) -> DataFrame:
    """Per term ``ln(1 + A / f)``: A the mean words per class, f the term's frequency."""
    words = counts.agg((F.sum("tf") / F.countDistinct("topic")).alias("a")).scalar()
    return counts.groupBy("term").agg(F.log(1 + words / F.sum("tf")).alias("idf"))


def c_tf_idf(df: DataFrame, topic: str = "topic", text_col: str = "clean_text") -> DataFrame:
    """Class-based TF-IDF: one row per topic and term with ``score``.

    ``tf`` is the term's share of the topic's words. Counting is combined before
    its shuffle, so frequent words and large topics cost no more than others. The
    counts are written once: texts are read a single time.
    """
    return term_scores(materialize(class_terms(df, topic, text_col), "class-terms"))


def term_scores(counts: DataFrame) -> DataFrame:
    """``c_tf_idf`` of the written counts of each topic's terms."""
    # one row per topic; once written, its true size lets the planner broadcast it or not
    sizes = materialize(counts.groupBy("topic").agg(F.sum("tf").alias("words")), "topic-words")
    # a term has at most one row per topic here, so no term is a hot key
    return (
        counts.join(term_weights(counts), "term")
        .join(sizes, "topic")
        .select(
            "topic", "term", "tf", "idf",
            (F.col("tf") / F.col("words") * F.col("idf")).alias("score"),
        )
    )


def top_terms(scores: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` best terms per topic; the literal limit trims before the shuffle."""
    best = Window.partitionBy("topic").orderBy(F.desc("score"), "term")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def topic_names(scores: DataFrame, topics: DataFrame,
                overrides: Mapping[int, str] | None = None) -> DataFrame:
    """Name per topic: override, ``outlier``, its three best terms, or ``topic_<id>``."""
    words = top_terms(scores, 3).groupBy("topic").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]),
            "_",
        ).alias("words")
    )
    manual = F.lit(None).cast("string")
    for topic, name in (overrides or {}).items():
        manual = F.when(F.col("topic") == topic, F.lit(name)).otherwise(manual)
    return topics.select("topic").distinct().join(words, "topic", "left").select(
        "topic",
        F.coalesce(
            F.when(F.col("topic") == OUTLIER, F.lit("outlier")), manual, "words",
            F.concat(F.lit("topic_"), F.col("topic").cast("string")),
        ).alias("topic_name"),
    )


def add_topic_names(df: DataFrame, overrides: Mapping[int, str] | None = None,
                    text_col: str = "clean_text", scores: DataFrame | None = None) -> DataFrame:
    """``scores`` are the c-TF-IDF scores of ``df`` if they are at hand."""
    names = topic_names(c_tf_idf(df, text_col=text_col) if scores is None else scores, df, overrides)
    return df.drop("topic_name").join(materialize(names, "topic-names"), "topic", "left")


def counted_terms(df: DataFrame, keep: list[str], text_col: str = "clean_text") -> DataFrame:
    """The columns ``keep`` with ``term`` and its count ``n``, one row per distinct term of a row.

    Counted within the row: in the sorted words every run of equal ones is a term.
    """
    ordered = df.select(*keep, F.sort_array(tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("_w"))
    last = F.size("_w") - 1
    starts = ordered.where(last >= 0).withColumn("_at", F.filter(
        F.sequence(F.lit(0), last),
        lambda i: (i == 0) | (F.get("_w", i) != F.get("_w", F.greatest(i - 1, F.lit(0)))),
    ))
    runs = F.transform("_at", lambda at, i: F.struct(
        F.get("_w", at).alias("term"),
        (F.coalesce(F.get("_at", i + 1), F.size("_w")) - at).cast("long").alias("n"),
    ))
    return starts.select(*keep, F.inline(runs))


def pull_index(scores: DataFrame) -> tuple[DataFrame, list[int]]:
    """One row per term with ``pulls``, an array of its pull on each topic, and those topics.

    A pull is null where the topic does not hold the term. One id per topic reaches the driver.
    """
    known = scores.where(F.col("topic") != OUTLIER)
    norms = materialize(
        known.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") ** 2)).alias("norm")), "topic-norms"
    )
    topics = sorted(r["topic"] for r in norms.select("topic").collect())
    directions = known.join(norms, "topic").select(
        "term", "topic", (F.col("idf") * F.col("score") / F.col("norm")).alias("pull")
    )
    of_topics = [F.sum(F.when(F.col("topic") == t, F.col("pull"))) for t in topics]
    pulls = F.array(*of_topics) if topics else F.array().cast("array<double>")
    return directions.groupBy("term").agg(pulls.alias("pulls")), topics


def closest_topic(posts: DataFrame, scores: DataFrame, text_col: str = "clean_text",
                  id_col: str = "post_id") -> DataFrame:
    """Per post with any known term: the topic of the most similar c-TF-IDF vector.

    A post's term meets one row of the index, and sums for all topics are combined before the
    one shuffle by post. Frequent words are hot join keys on the post side and are split over
    tasks. Texts are read once; what is joined are the written counts of terms. Equal
    similarities, to 9 decimals, go to the smallest topic.
    """
    index, topics = pull_index(scores)
    in_post = materialize(counted_terms(posts, [id_col], text_col), "post-terms")
    sums = salted_join(in_post, index, "term", spread_by=id_col).groupBy(id_col).agg(
        F.count(F.lit(1)).alias("_terms"),
        *[F.sum(F.col("n") * F.get("pulls", F.lit(i))).alias(f"_s{i}") for i in range(len(topics))],
    )
    none = F.lit(None).cast("struct<similarity:double,below:int>")
    rivals = [
        F.when(F.col(f"_s{i}").isNotNull(), F.struct(
            F.round(f"_s{i}", 9).alias("similarity"), F.lit(-t).alias("below")
        )) for i, t in enumerate(topics)
    ]
    best = F.array_max(F.array(none, *rivals))
    return sums.select(id_col, (-best["below"]).alias("closest")).where(F.col("closest").isNotNull())


def reduce_outliers(df: DataFrame, scores: DataFrame | None = None,
                    text_col: str = "clean_text", id_col: str = "post_id") -> DataFrame:
    """Give each outlier the topic closest by c-TF-IDF; without known terms it stays -1.

    ``scores`` are the c-TF-IDF scores of ``df`` if they are at hand.
    """
    if scores is None:
        scores = c_tf_idf(df, text_col=text_col)
    outliers = df.where(F.col("topic") == OUTLIER)
    found = closest_topic(outliers, scores, text_col, id_col)
    moved = outliers.join(found, id_col, "left").withColumn(
        "topic", F.coalesce(F.col("closest"), F.lit(OUTLIER)).cast("int")
    )
    return df.where(~F.col("topic").eqNullSafe(OUTLIER)).unionByName(moved.select(*df.columns))


def topic_similarity(scores: DataFrame, k: int) -> DataFrame:
    """Cosine of every two of the ``k`` topics (a < b); topics beyond ``k`` are an error.

    Each task adds up one ``k x k`` matrix over its terms, so what is shuffled is
    a matrix per task, not pairs per term.
    """
    largest = scores.agg(F.max("topic")).first()[0]
    if largest is not None and largest >= k:
        raise ValueError(f"topic {largest} is not among the first {k}")
    by_term = (
        scores.where(F.col("topic") != OUTLIER)
        .groupBy("term")
        .pivot("topic", list(range(k)))
        .agg(F.first("score"))
        .drop("term")
        .fillna(0.0)
    )

    def partial_products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for batch in batches:
            weights = batch.to_numpy(dtype="float64")
            total += weights.T @ weights
        a, b = np.nonzero(total)
        yield pd.DataFrame({"a": a, "b": b, "product": total[a, b]})

    # k * k rows, read three times; written, their sums over all terms are made once
    products = materialize(by_term.mapInPandas(partial_products, "a int, b int, product double").groupBy(
        "a", "b"
    ).agg(F.sum("product").alias("product")), "topic-products")
    # the diagonal carries the squared norms: one row per topic
    norms = products.where(F.col("a") == F.col("b")).select("a", F.sqrt("product").alias("norm"))
    return (
        products.where(F.col("a") < F.col("b"))
        .join(F.broadcast(norms.withColumnRenamed("norm", "norm_a")), "a")
        .join(F.broadcast(norms.select(F.col("a").alias("b"), F.col("norm").alias("norm_b"))), "b")
        .select("a", "b", (F.col("product") / (F.col("norm_a") * F.col("norm_b"))).alias("cosine"))
    )


def merge_topics(df: DataFrame, similarity: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Merge topics linked by a similarity above ``threshold`` into the smallest id.

    At most one pair per two topics reaches the driver.
    """
    return df.withColumn("topic", merged_topic(similarity, threshold))


def merged_topic(similarity: DataFrame, threshold: float) -> Column:
    """The topic of a row after ``merge_topics``."""
    target: dict[int, int] = {}

    def root(topic: int) -> int:
        while topic in target:
            topic = target[topic]
        return topic

    pairs = similarity.where(F.col("cosine") > threshold).orderBy("a", "b").collect()
    for pair in pairs:
        low, high = sorted((root(pair["a"]), root(pair["b"])))
        if low != high:
            target[high] = low
    merged = F.col("topic")
    if target:
        lookup = F.create_map(*[F.lit(x) for t in target for x in (t, root(t))])
        merged = F.coalesce(F.try_element_at(lookup, F.col("topic")), merged)
    return merged.cast("int")


def model_topics(df: DataFrame, k: int = 50, features=None, dims: int = 5,
                 min_size: int | None = 20, merge_above: float = 0.8,
                 overrides: Mapping[int, str] | None = None, seed: int = 42,
                 keep_before: bool = False) -> DataFrame:
    """Add topic and topic_name: features, projection, clusters, outliers, merging, names.

    Without ``features`` (a column name) texts are hashed into vectors. The features, the
    projected and the clustered table are written once, because later steps read
    them several times. Terms are counted once as well: where outliers are placed only their own
    texts are read again, and counts of merged topics are added up. With ``min_size`` None the
    number of rows gives it. ``keep_before`` adds ``topic_before``, the topic before outliers
    were placed and topics merged.
    """
    kept = [c for c in df.columns if c not in ("topic", "topic_name") and not (keep_before and c == "topic_before")]
    if features is None:
        source, features = hashed_features().transform(df), "features"
    else:
        source = df
    source = materialize(source.select(*kept, *([] if features in kept else [features])), "features")
    if min_size is None:
        min_size = min_topic_size(source.count())
    reduced = materialize(reduce_dims(source, dims, features).select(*kept, "reduced"), "reduced")
    clustered = cluster(reduced, k, min_size, seed=seed).select(*kept, "topic")
    if keep_before:
        clustered = clustered.withColumn("topic_before", F.col("topic"))
    clustered = materialize(clustered.withColumn("_outlier", F.col("topic") == OUTLIER), "clustered")
    counts = materialize(class_terms(clustered), "class-terms")
    placed = materialize(reduce_outliers(clustered, term_scores(counts)), "placed")

    def added(counts: DataFrame) -> DataFrame:
        return counts.groupBy("topic", "term").agg(F.sum("tf").alias("tf"))

    counts = materialize(
        added(counts.where(F.col("topic") != OUTLIER).unionByName(class_terms(placed.where("_outlier")))), "class-terms"
    )
    topic = merged_topic(topic_similarity(term_scores(counts), k), merge_above)
    scores = term_scores(materialize(added(counts.withColumn("topic", topic)), "class-terms"))
    return add_topic_names(placed.drop("_outlier").withColumn("topic", topic), overrides, scores=scores)


def outlier_change(df: DataFrame, before: str = "topic_before", after: str = "topic") -> DataFrame:
    """One row: outliers before and after they were placed, as numbers and in percent."""
    n = F.count(F.lit(1))
    columns = [n.alias("n")]
    for name, topic in (("before", before), ("after", after)):
        outliers = F.count_if(F.col(topic) == OUTLIER)
        columns += [outliers.alias(f"n_{name}"), F.try_divide(100.0 * outliers, n).alias(f"pct_{name}")]
    return df.agg(*columns)


def topic_info(df: DataFrame) -> DataFrame:
    """Size and share of every topic, outliers included."""
    sizes = df.groupBy("topic").agg(rows().alias("n"))
    return sizes.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def topic_crosstab(posts: DataFrame) -> DataFrame:
    """Per named topic: posts, mean toxicity, divisive percent, mean score, top emotion."""
    inside = posts.where(F.col("topic") != OUTLIER)
    base = inside.groupBy("topic_name").agg(
        rows().alias("n"), F.avg("toxicity").alias("toxicity_mean"),
        percent(F.col("othering_predicted") == 1).alias("othering_pct"),
        F.avg("othering_score").alias("othering_score_mean"),
    )
    return base.join(
        top_value_per_group(inside, "topic_name", "emotion", "top_emotion"), "topic_name", "left"
    )


def topic_stats(posts: DataFrame) -> DataFrame:
    return (
        posts.where((F.col("topic") >= 0) & F.col("topic_name").isNotNull())
        .groupBy("topic", "topic_name")
        .agg(
            rows().alias("nb_posts"), F.avg("toxicity").alias("mean_toxicity"),
            percent(F.col("othering_predicted") == 1).alias("pct_othering"),
        )
    )


def topic_headline(posts: DataFrame) -> DataFrame:
    """One row: number of topics, the largest, the most divisive, outliers."""
    stats = topic_stats(posts)
    outliers = posts.where(F.col("topic") == OUTLIER).agg(rows()).scalar()
    return stats.agg(
        rows().alias("n_topics"),
        F.max_by("topic_name", F.struct("nb_posts", -F.col("topic"))).alias("largest_topic"),
        F.max("nb_posts").alias("largest_posts"),
        F.max_by("topic_name", F.struct("pct_othering", -F.col("topic")))
        .alias("most_othering_topic"),
        F.max("pct_othering").alias("most_othering_pct"),
    ).withColumn("n_outliers", outliers)


def top_topics(posts: DataFrame, n: int = 20) -> DataFrame:
    return topic_stats(posts).orderBy(F.desc("nb_posts"), "topic").limit(n)


def top_othering_topics(posts: DataFrame, n: int = 15, min_posts: int = 10) -> DataFrame:
    large = topic_stats(posts).where(F.col("nb_posts") >= min_posts)
    return large.orderBy(F.desc("pct_othering"), "topic").limit(n)
