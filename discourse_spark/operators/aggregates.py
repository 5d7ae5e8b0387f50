"""Key figures kept as partial sums per dataset and day, so that a changed dataset needs no rescan.

The sums lie in one folder per dataset. Replacing or removing a dataset rewrites that folder
alone; every figure is a sum over the rest. A dataset without rows keeps one row of zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from discourse_spark.fixed_values import HIGH_TOXICITY
from discourse_spark.functions.text import dataset_short_name
from discourse_spark.operators.analytics import all_groups, rows, texts
from discourse_spark.operators.temporal import period_of

KEYS = ["dataset", "day", "pronoun_type", "emotion"]
COUNTS = ["n", "n_texts", "n_predicted", "n_othering", "n_toxicity", "n_high_toxicity"]
SUMS = ["sum_othering", "sum_toxicity"]
SCHEMA = (
    "dataset string, day date, pronoun_type string, emotion string, "
    + ", ".join([f"{c} long" for c in COUNTS] + [f"{s} double" for s in SUMS])
)


def partial_sums(posts: DataFrame) -> DataFrame:
    """One row per dataset, day, pronoun type and emotion; a dataset without a name is null."""
    named = F.when(F.col("dataset") != "", F.col("dataset"))
    return posts.groupBy(
        named.alias("dataset"), F.to_date("post_date").alias("day"), "pronoun_type", "emotion"
    ).agg(
        rows().alias("n"), texts(posts).alias("n_texts"),
        F.count("othering_predicted").alias("n_predicted"),
        F.count_if(F.col("othering_predicted") == 1).alias("n_othering"),
        F.count("toxicity").alias("n_toxicity"),
        F.count_if(F.col("toxicity") > HIGH_TOXICITY).alias("n_high_toxicity"),
        F.coalesce(F.sum("othering_predicted"), F.lit(0)).cast("double").alias("sum_othering"),
        F.coalesce(F.sum("toxicity"), F.lit(0.0)).alias("sum_toxicity"),
    )


def keep_sums(posts: DataFrame, path: str) -> None:
    """Put the sums of exactly the datasets in ``posts`` in place of what was there for them."""
    _overwrite(partial_sums(posts), path)


def drop_sums(spark: SparkSession, path: str, dataset: str | None) -> None:
    """Take one dataset out of all figures."""
    zeros = {c: F.lit(0).cast("long") for c in COUNTS} | {s: F.lit(0.0) for s in SUMS}
    empty = {"day": F.lit(None).cast("date")} | {
        c: F.lit(None).cast("string") for c in ("pronoun_type", "emotion")
    }
    row = spark.range(1).select(F.lit(dataset).cast("string").alias("dataset")).withColumns(empty | zeros)
    _overwrite(row, path)


def _overwrite(sums: DataFrame, path: str) -> None:
    sums.repartition("dataset").write.partitionBy("dataset").option(
        "partitionOverwriteMode", "dynamic"
    ).mode("overwrite").parquet(path)


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """The sums of all datasets; a filter on ``dataset`` reads that one's folder alone."""
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("n") > 0).select(*KEYS, *COUNTS, *SUMS)


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def _pct(part: str, whole: str) -> Column:
    return F.try_divide(F.sum(part) * 100.0, F.sum(whole))


def overview_kpis(sums: DataFrame) -> DataFrame:
    by_emotion = sums.where(F.col("emotion").isNotNull()).groupBy("emotion").agg(F.sum("n").alias("n"))
    top = by_emotion.orderBy(F.desc("n"), "emotion").limit(1).select("emotion").scalar()
    return sums.agg(
        _total("n").alias("total"), _pct("n_othering", "n_predicted").alias("othering_pct"),
        _pct("n_high_toxicity", "n_toxicity").alias("high_toxicity_pct"),
        F.countDistinct("dataset").alias("n_datasets"),
    ).withColumn("top_emotion", top)


def dataset_counts(sums: DataFrame) -> DataFrame:
    counts = sums.groupBy("dataset").agg(
        F.sum("n").alias("n"), _pct("n_othering", "n_predicted").alias("othering_pct")
    )
    return counts.withColumns({
        "pct": F.col("n") * 100.0 / F.sum("n").over(all_groups()),
        "short": dataset_short_name(F.col("dataset")),
    })


def pronoun_vs_othering(sums: DataFrame) -> DataFrame:
    counts = sums.where(~F.col("pronoun_type").isin("unknown", "none", "")).groupBy("pronoun_type").agg(
        F.sum("n_texts").alias("n"), F.sum("sum_othering").cast("long").alias("n_othering"),
        _pct("n_othering", "n_predicted").alias("othering_pct"),
    )
    return counts.withColumn("pct_posts", F.col("n") * 100.0 / F.sum("n").over(all_groups()))


def othering_rate_by_dataset(sums: DataFrame) -> DataFrame:
    counts = sums.groupBy("dataset").agg(
        F.sum("sum_othering").cast("long").alias("othering"), F.sum("n_predicted").alias("total")
    )
    return counts.withColumns({
        "pct": F.try_divide(F.col("othering") * 100.0, F.col("total")),
        "global_pct": F.try_divide(
            F.sum("othering").over(all_groups()) * 100.0, F.sum("total").over(all_groups())
        ),
        "short": dataset_short_name(F.col("dataset")),
    })


def timeline(sums: DataFrame, granularity: str = "Month") -> DataFrame:
    dated = sums.where(F.col("day").isNotNull())
    return dated.groupBy(period_of(F.col("day"), granularity).alias("period"), "dataset").agg(
        F.sum("n_texts").alias("posts"),
        F.try_divide(F.sum("sum_othering"), F.sum("n_predicted")).alias("othering_rate"),
        F.try_divide(F.sum("sum_toxicity"), F.sum("n_toxicity")).alias("toxicity_mean"),
    )
