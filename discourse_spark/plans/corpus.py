"""The post corpus the registered queries run on, derived from the given tables.

The given documents contain no divisive phrasing, so every document gets a short
phrase appended by its id; texts are used whole. Everything else a post needs
(board, dataset, date, scores) follows from the id in plain arithmetic, which
the SQL counterparts repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discourse_spark.operators.enrich import enrich_base
from discourse_spark.session import materialize

PHRASES = [
    "they plan an invasion", "a flood of posts", "they swarm our town", "an infestation",
    "like a plague", "call them rats", "they act like animals", "parasites",
    "you dont belong", "go back to where you were", "they are not like us", "their kind",
    "not welcome here", "leave our country", "no place here", "send them back",
    "all of them", "these people always do it", "they never learn", "theyre all the same",
    "all they want", "every single one of them", "those people", "none of them",
    "taking over", "replacing us", "the great replacement", "destroying our home",
    "we are under attack", "erasing us", "threatening our way of life", "white genocide",
    "demographic replacement", "destroying our culture",
    "those people are taking over send them back", "rats taking over",
    "we met people like them", "those peoples of the sea", "they all agreed",
    "our ours ourselves", "they and them",
    "we saw http://a.example/x?y=1 and @some_user today", "infests rattle beastly",
    "we and they talk",
]
PHRASE_SLOTS = 83

CALENDAR = [
    ("2024-01-01", "Harbour strike begins", "protest", "AAA"),
    ("2024-01-20", "Regional vote", "election", "BBB"),
    ("2024-02-14", "Border summit", "politics", "AAA"),
    ("2024-03-05", "Stadium unrest", "riot", "CCC"),
    ("2024-03-06", "Court verdict", "justice", "CCC"),
    ("2024-04-06", "Coastal rescue", "migration", "BBB"),
    ("2030-01-01", "Far future event", "politics", "DDD"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROW_GROUP_BYTES = 1 << 20

_documents: dict[tuple[str, str], DataFrame] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and whole texts of the documents, written once per application in small row groups.

    The given file may be a single row group, which one core would read, clean and match
    alone in every query. A task writes what it reads, so nothing is shuffled.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _documents:
        given = table(spark, sf_dir, "documents").select("doc_id", "text")
        _documents[key] = materialize(given, "documents", ROW_GROUP_BYTES)
    return _documents[key]


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    phrases = F.array(*[F.lit(p) for p in PHRASES])
    phrase = F.try_element_at(phrases, (i % PHRASE_SLOTS + 1).cast("int"))

    def by_remainder(modulus: int, values: list[str | None], default: str | None = None):
        column = F.lit(default).cast("string")
        for k, value in reversed(list(enumerate(values))):
            column = F.when(i % modulus == k, F.lit(value).cast("string")).otherwise(column)
        return column

    date = F.date_add(F.lit("2024-01-01").cast("date"), (i % 97).cast("int")).cast("timestamp")
    emotions = ["neutral", "anger", "joy", "neutral", "fear", "annoyance", "curiosity", "anger"]
    return documents(spark, sf_dir).select(
        i.alias("post_id"),
        F.concat("text", F.coalesce(F.concat(F.lit(" "), phrase), F.lit(""))).alias("text"),
        F.when(i % 7 < 3, "reddit").otherwise("hate_speech").alias("source"),
        by_remainder(7, ["politics", "europe", "worldnews"]).alias("subreddit"),
        by_remainder(
            4, ["Twitter  ·  tw_a.csv", "Tiktok  ·  tk_b.csv", "Instagram  ·  ig_c.csv"],
            "Default  ·  dataset_final.csv",
        ).alias("dataset"),
        date.alias("post_date"),
        F.when(i % 11 == 0, F.lit(0)).otherwise(F.unix_timestamp(date) + i % 86400)
        .cast("long").alias("created_utc"),
        F.when(i % 5 != 0, ((i * 37) % 101).cast("double") / 100).alias("toxicity"),
        by_remainder(9, emotions).alias("emotion"),
        (i % 13 - 1).cast("int").alias("topic"),
        F.when(i % 13 == 0, "outlier").otherwise(
            F.concat(F.lit("topic_"), (i % 13 - 1).cast("string"))
        ).alias("topic_name"),
    )


def calendar(spark: SparkSession) -> DataFrame:
    """The event calendar as literals, whose size the planner knows."""
    names = ["date", "title", "category", "country"]
    entries = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in CALENDAR]
    raw = spark.range(1).select(F.inline(F.array(*entries)))
    return raw.withColumn("date", F.col("date").cast("date"))


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts after the base analysis, text included, computed where it is used."""
    return enrich_base(posts(spark, sf_dir))


_facts: dict[tuple[str, str], DataFrame] = {}


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysed posts without their texts, written once per application.

    Texts are scanned and matched once; rates, pivots and timelines then read a
    few narrow columns. The table lives in the shared folder, not in executors.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _facts:
        _facts[key] = write_facts(spark, sf_dir)
    return _facts[key]


def write_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = analysed(spark, sf_dir).withColumn("has_text", F.col("text").isNotNull())
    return materialize(posts.drop("text", "clean_text"), "facts")
