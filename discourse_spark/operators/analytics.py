"""Corpus questions: rates, shares, pivots, co-occurrence, rankings.

Inputs are analysed posts. Every grouping is combined before its shuffle, so a
dominant dataset or label costs no more than a rare one. Windows run over
already grouped rows (one per dataset, emotion, label), never over posts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discourse_spark.fixed_values import HIGH_TOXICITY
from discourse_spark.functions.rules import FAMILIES, family_hit
from discourse_spark.functions.text import dataset_short_name, emotion_valence
from discourse_spark.operators.ranks import with_running_total
from discourse_spark.operators.sampling import random_sample

MEDIAN_BINS = 65536
PRONOUN_TYPES = ["we_only", "them_only", "both"]


def all_groups():
    """The window over all grouped rows, for shares of a total."""
    return Window.partitionBy()


def percent(condition: Column) -> Column:
    """Share of rows in percent; rows where the condition is null do not count."""
    return F.avg(condition.cast("double")) * 100


def rows() -> Column:
    return F.count(F.lit(1))


def texts(df: DataFrame) -> Column:
    """Number of posts that have a text. A table without texts tells by ``has_text``; where
    that is missing too, every row counts."""
    if "text" in df.columns:
        return F.count("text")
    return F.count_if("has_text") if "has_text" in df.columns else rows()


def most_frequent(df: DataFrame, column: str) -> Column:
    """Modal value as a scalar; ties go to the smallest value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(rows().alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(1).select(column).scalar()


def top_value_per_group(df: DataFrame, group: str, column: str, name: str) -> DataFrame:
    """Modal value per group: count pairs first, then keep the best pair of each group."""
    counts = df.where(F.col(column).isNotNull()).groupBy(group, column).agg(rows().alias("n"))
    best = F.min_by(F.col(column), F.struct(-F.col("n"), F.col(column)))
    return counts.groupBy(group).agg(best.alias(name))


def overview_kpis(posts: DataFrame) -> DataFrame:
    return posts.agg(
        rows().alias("total"),
        percent(F.col("othering_predicted") == 1).alias("othering_pct"),
        percent(F.col("toxicity") > HIGH_TOXICITY).alias("high_toxicity_pct"),
        F.countDistinct("dataset").alias("n_datasets"),
    ).withColumn("top_emotion", most_frequent(posts, "emotion"))


def dataset_counts(posts: DataFrame) -> DataFrame:
    counts = posts.groupBy("dataset").agg(
        rows().alias("n"), percent(F.col("othering_predicted") == 1).alias("othering_pct")
    )
    return counts.withColumns(
        {
            "pct": F.col("n") * 100.0 / F.sum("n").over(all_groups()),
            "short": dataset_short_name(F.col("dataset")),
        }
    )


def pronoun_vs_othering(posts: DataFrame) -> DataFrame:
    counts = (
        posts.where(~F.col("pronoun_type").isin("unknown", "none", ""))
        .groupBy("pronoun_type")
        .agg(
            texts(posts).alias("n"),
            F.sum("othering_predicted").cast("long").alias("n_othering"),
            percent(F.col("othering_predicted") == 1).alias("othering_pct"),
        )
    )
    return counts.withColumn("pct_posts", F.col("n") * 100.0 / F.sum("n").over(all_groups()))


def othering_rate_by_dataset(posts: DataFrame) -> DataFrame:
    counts = posts.groupBy("dataset").agg(
        F.sum("othering_predicted").cast("long").alias("othering"),
        F.count("othering_predicted").alias("total"),
    )
    return counts.withColumns(
        {
            "pct": F.col("othering") * 100.0 / F.col("total"),
            "global_pct": F.sum("othering").over(all_groups()) * 100.0
            / F.sum("total").over(all_groups()),
            "short": dataset_short_name(F.col("dataset")),
        }
    )


def exact_median(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """One row ``median`` of a column in ``[low, high]``, exact and without one big task.

    A histogram of fixed bins (combined before the shuffle, at most MEDIAN_BINS
    rows) locates the one or two bins with the middle ranks; only their distinct
    values are counted, and ranked in ranges, however many fall into one bin.
    """
    scaled = F.floor((F.col(column) - low) / (high - low) * MEDIAN_BINS)
    bin_of = F.least(F.greatest(scaled, F.lit(0)), F.lit(MEDIAN_BINS - 1))
    binned = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"), bin_of.alias("b"))
    bins = binned.groupBy("b").agg(rows().alias("n"))
    running = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(all_groups())
    lower, upper = F.floor((total - 1) / 2), F.floor(total / 2)
    middle = (
        bins.withColumns({"end": F.sum("n").over(running), "lower": lower, "upper": upper})
        .withColumn("start", F.col("end") - F.col("n"))
        .where((F.col("start") <= F.col("upper")) & (F.col("end") > F.col("lower")))
        .select("b", "start", "lower", "upper")
    )
    values = binned.join(F.broadcast(middle), "b").groupBy("b", "v").agg(
        rows().alias("n"), F.first("start").alias("start"),
        F.first("lower").alias("lower"), F.first("upper").alias("upper"),
    )
    ranked = with_running_total(values, ["v"], "b", F.col("n")).withColumn(
        "end", F.col("start") + F.col("_running")
    ).withColumn("begin", F.col("end") - F.col("n"))

    def covers(rank: str) -> Column:
        return (F.col("begin") <= F.col(rank)) & (F.col("end") > F.col(rank))

    return ranked.agg(
        ((F.max(F.when(covers("lower"), F.col("v"))) + F.max(F.when(covers("upper"), F.col("v"))))
         / 2).alias("median")
    )


def toxicity_kpis(posts: DataFrame) -> DataFrame:
    scored = posts.where(F.col("toxicity").isNotNull())
    return scored.agg(
        rows().alias("n_scored"),
        F.avg("toxicity").alias("mean"),
        percent(F.col("toxicity") > HIGH_TOXICITY).alias("high_pct"),
        F.max("toxicity").alias("max"),
    ).withColumn("median", exact_median(scored, "toxicity").scalar())


def toxicity_by_score(posts: DataFrame, n: int = 4000, **key) -> DataFrame:
    """Points of a toxicity x score scatter, at most ``n`` by hash order."""
    scored = posts.where(F.col("toxicity").isNotNull()).select(
        "post_id", "toxicity",
        F.coalesce("othering_score", F.lit(0)).alias("othering_score"), "othering_predicted",
    )
    return random_sample(scored, n, **key)


def most_toxic(posts: DataFrame, n: int = 10) -> DataFrame:
    return (
        posts.where(F.col("toxicity").isNotNull())
        .orderBy(F.desc("toxicity"), "post_id")
        .limit(n)
    )


def emotion_distribution(posts: DataFrame) -> DataFrame:
    """Per emotion: count, share of labelled posts, valence; and overall coverage."""
    counts = posts.groupBy("emotion").agg(rows().alias("n"))
    everything = F.sum("n").over(all_groups())
    labelled = F.sum(F.when(F.col("emotion").isNotNull(), F.col("n"))).over(all_groups())
    return (
        counts.withColumns(
            {"pct": F.col("n") * 100.0 / labelled, "coverage_pct": labelled * 100.0 / everything}
        )
        .where(F.col("emotion").isNotNull())
        .withColumn("valence", emotion_valence(F.col("emotion")))
    )


def emotion_delta(posts: DataFrame) -> DataFrame:
    """Share within divisive posts minus share within the others; a missing side is 0."""
    flag = F.col("othering_predicted")
    counts = posts.where(F.col("emotion").isNotNull()).groupBy("emotion").agg(
        F.count_if(flag == 1).alias("n_othering"), F.count_if(flag == 0).alias("n_other")
    )

    def share(n: str) -> Column:
        return F.coalesce(F.try_divide(F.col(n) * 100.0, F.sum(n).over(all_groups())), F.lit(0.0))

    shares = counts.select(
        "emotion", share("n_othering").alias("othering"), share("n_other").alias("non_othering")
    )
    return shares.withColumn("delta", F.col("othering") - F.col("non_othering"))


def emotion_by_dataset(posts: DataFrame, top: int = 15) -> DataFrame:
    """Long heat map: share of each top emotion within its dataset."""
    counts = posts.where(F.col("emotion").isNotNull()).groupBy("dataset", "emotion").agg(
        rows().alias("n")
    )
    shares = counts.withColumn(
        "pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("dataset"))
    )
    leading = (
        counts.groupBy("emotion").agg(F.sum("n").alias("total"))
        .orderBy(F.desc("total"), "emotion").limit(top)
    )
    short = dataset_short_name(F.col("dataset")).alias("short")
    return (
        shares.join(leading, "emotion", "left_semi")
        .groupBy("emotion", short).agg(F.avg("pct").alias("pct"))
    )


def emotion_heatmap(posts: DataFrame, datasets: Sequence[str] | None = None,
                    top: int = 15) -> DataFrame:
    """The heat map with one column per dataset, of all or of those named; absent cells are 0."""
    long = emotion_by_dataset(posts, top)
    if datasets is None:
        names = posts.select(dataset_short_name(F.col("dataset")).alias("short")).distinct()
        datasets = sorted(r.short for r in names.collect() if r.short is not None)
    return long.groupBy("emotion").pivot("short", list(datasets)).agg(F.first("pct")).fillna(
        0.0, list(datasets)
    )


def othering_kpis(posts: DataFrame) -> DataFrame:
    return posts.agg(
        F.sum("othering_predicted").cast("long").alias("n_othering"),
        percent(F.col("othering_predicted") == 1).alias("othering_pct"),
        F.avg("othering_score").alias("mean_score"),
        percent(F.col("pronoun_type") == "both").alias("both_pct"),
    )


def pronoun_dataset_pivot(posts: DataFrame) -> DataFrame:
    by_dataset = (
        posts.where(F.col("pronoun_type").isin(PRONOUN_TYPES))
        .groupBy("dataset", "pronoun_type")
        .agg(percent(F.col("othering_predicted") == 1).alias("pct"))
    )
    return (
        by_dataset.groupBy(dataset_short_name(F.col("dataset")).alias("short"))
        .pivot("pronoun_type", PRONOUN_TYPES)
        .agg(F.avg("pct"))
        .fillna(0.0, PRONOUN_TYPES)
    )


def family_share_by_dataset(posts: DataFrame) -> DataFrame:
    """Percent of divisive posts per dataset whose labels touch each family.

    Families are counted as flags on the row, so nothing is exploded or joined.
    """
    divisive = posts.where(F.col("othering_predicted") == 1)
    counts = divisive.groupBy(dataset_short_name(F.col("dataset")).alias("dataset")).agg(
        rows().alias("n"),
        *[F.count_if(family_hit(F.col("matched_patterns"), f)).alias(f) for f in FAMILIES],
    )
    long = counts.unpivot(["dataset", "n"], FAMILIES, "family", "hits").where("hits > 0")
    return long.select("dataset", "family", (F.col("hits") * 100.0 / F.col("n")).alias("pct"))


def pattern_cooccurrence(posts: DataFrame) -> DataFrame:
    """Ordered label pairs on one post. Pairs form inside the row's short label array."""
    divisive = posts.where(F.col("othering_predicted") == 1).select("matched_patterns")
    return (
        divisive.where(F.size("matched_patterns") > 1)
        .select(F.explode("matched_patterns").alias("a"), "matched_patterns")
        .select("a", F.explode("matched_patterns").alias("b"))
        .where(F.col("a") != F.col("b"))
        .groupBy("a", "b")
        .agg(rows().alias("n"))
    )


def pattern_counts(posts: DataFrame, top: int = 15) -> DataFrame:
    total = posts.agg(rows().alias("n")).scalar()
    return (
        posts.select(F.explode("matched_patterns").alias("pattern"))
        .groupBy("pattern")
        .agg(rows().alias("n"))
        .withColumn("pct_posts", F.col("n") * 100.0 / total)
        .orderBy(F.desc("n"), "pattern")
        .limit(top)
    )


def score_distribution(posts: DataFrame) -> DataFrame:
    return posts.groupBy("othering_score").agg(rows().alias("n"))


def rate_by_group(posts: DataFrame) -> DataFrame:
    """Divisive share by source, and by board within forum posts, from one scan."""
    by_pair = posts.groupBy("source", "subreddit").agg(
        rows().alias("n"), F.count_if("has_othering").alias("hits")
    )

    def rate(df: DataFrame, level: str, column: str) -> DataFrame:
        return df.groupBy(F.lit(level).alias("level"), F.col(column).alias("value")).agg(
            F.sum("n").alias("n"),
            (F.sum("hits") * 100.0 / F.sum("n")).alias("othering_pct"),
        )

    forum = by_pair.where((F.col("source") == "reddit") & F.col("subreddit").isNotNull())
    return rate(by_pair, "source", "source").unionByName(rate(forum, "subreddit", "subreddit"))


def top_emotions_by_class(posts: DataFrame, top: int = 5) -> DataFrame:
    counts = posts.where(F.col("emotion").isNotNull()).groupBy("has_othering", "emotion").agg(
        rows().alias("n")
    )
    rank = F.row_number().over(
        Window.partitionBy("has_othering").orderBy(F.desc("n"), "emotion")
    )
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def toxicity_by_class(posts: DataFrame) -> DataFrame:
    return posts.groupBy("has_othering").agg(F.avg("toxicity").alias("mean_toxicity"))


def platform_comparison(posts: DataFrame) -> DataFrame:
    """Per forum board: posts, mean toxicity, divisive share, top emotion, top pattern."""
    forum = posts.where((F.col("source") == "reddit") & F.col("subreddit").isNotNull())
    base = forum.groupBy("subreddit").agg(
        rows().alias("n_posts"),
        F.avg("toxicity").alias("avg_toxicity"),
        percent(F.col("has_othering")).alias("othering_rate_pct"),
    )
    labels = forum.select("subreddit", F.explode("matched_patterns").alias("pattern"))
    return (
        base.join(top_value_per_group(forum, "subreddit", "emotion", "top_emotion"),
                  "subreddit", "left")
        .join(top_value_per_group(labels, "subreddit", "pattern", "top_pattern"),
              "subreddit", "left")
        .fillna("N/A", ["top_emotion", "top_pattern"])
    )


def enrichment_summary(posts: DataFrame) -> DataFrame:
    return posts.agg(
        rows().alias("n_posts"),
        percent(F.col("has_we")).alias("we_pct"),
        percent(F.col("has_them")).alias("them_pct"),
        percent(F.col("pronoun_type") == "both").alias("both_pct"),
        F.avg("toxicity").alias("mean_toxicity"),
        F.count("toxicity").alias("n_scored"),
    )


def top_emotions(posts: DataFrame, top: int = 5) -> DataFrame:
    return (
        posts.where(F.col("emotion").isNotNull())
        .groupBy("emotion").agg(rows().alias("n"))
        .orderBy(F.desc("n"), "emotion").limit(top)
    )


def matching_posts(posts: DataFrame, low: int = 0, high: int = 4,
                   othering_only: bool = True) -> DataFrame:
    kept = posts.where(F.col("othering_score").between(low, high))
    return kept.where(F.col("othering_predicted") == 1) if othering_only else kept


def filter_examples(posts: DataFrame, low: int = 0, high: int = 4, othering_only: bool = True,
                    n: int = 10) -> DataFrame:
    """The first ``n`` matching posts, each with the number of all matches."""
    kept = matching_posts(posts, low, high, othering_only)
    n_match = kept.agg(rows().alias("n")).scalar()
    return kept.orderBy("post_id").limit(n).withColumn("n_match", n_match)


def upload_summary(posts: DataFrame) -> DataFrame:
    return posts.agg(
        rows().alias("n_rows"),
        percent(F.col("othering_predicted") == 1).alias("othering_pct"),
        F.avg("toxicity").alias("mean_toxicity"),
        percent(F.col("pronoun_type").isin("them_only", "both")).alias("them_pct"),
    )
