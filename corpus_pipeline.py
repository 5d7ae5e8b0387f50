"""A training-data pipeline over ``documents``: what is left after each stage goes to the next.

Every stage is an operator of ``discourse_spark.llm``. All but the last return the columns
they were given; texts that change have ``n_chars`` counted again. Run as a whole, each
stage's rows are written to the shared folder and read by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discourse_spark.llm import minmax_dedup, packing, secret_scan, suffix_dedup, toxicity
from discourse_spark.llm.common import position, table, written
from discourse_spark.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict to be toxic. It is fitted on the labels."""
    model = toxicity.fit_by_id(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(_documents(docs), model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return minmax_dedup.keep_first(_documents(docs))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that also start in a document with a smaller id."""
    rest = suffix_dedup.remove_repeats(_documents(docs), keep_text=True)
    return _documents(rest.withColumn("text", F.col("kept_text")).withColumn(
        "n_chars", F.length("kept_text").cast("long")
    ))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which a mark stands for each secret that looks live."""
    return secret_scan.mask(_documents(docs)).withColumn(
        "n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 4096 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


def _documents(docs: DataFrame) -> DataFrame:
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    return plain.select(*[F.col(f"_{position(docs.columns, c)}").alias(c) for c in COLUMNS])


STAGES = [
    ("toxicity", without_toxic),
    ("minhash near-dedup", without_near_copies),
    ("suffix-array dedup", without_repeats),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

ORACLE_SQL = None  # classifiers, suffix order and tokenizers are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
