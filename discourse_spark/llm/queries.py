"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discourse_spark.llm import (
    cross_alignment, embedding_dedup, language_cnn, minmax_dedup, packing, phrases, quality_bands, secret_scan,
    sentencepiece_fst, suffix_dedup, token_files, toxicity, url_filter,
)
from discourse_spark.llm.common import table
from discourse_spark.llm.oracles import EMBEDDING_SQL, MINMAX_SQL, PHRASE_SQL, SECRET_SQL


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(parts: int, left: int):
    """Whether the checksum of the id as text leaves this remainder."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == left


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).drop("kept_text")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bands.quality(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(3, 1)
    network = language_cnn.fit(docs.where(~F.coalesce(out, F.lit(True))))
    return language_cnn.predict(docs, network).select(
        "doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(4, 2)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~F.coalesce(out, F.lit(True)))
    model = toxicity.fit_by_id(docs, labels)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", "predicted"
    )


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_alignment.align_documents(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    ).documents


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f for f in (
        op1_suffix_array_dedup, op2_embedding_near_dedup, op3_best_fit_packing, op4_token_id_output,
        op5_sentencepiece_codec, op6_quality_rules, op7_language_id, op8_minhash_near_dedup, op9_toxicity,
        op10_secret_scans, op11_cross_tokenizer_alignment, op12_phrase_mining, op13_url_filter,
    )
}

SQL = {
    "op2_embedding_near_dedup": EMBEDDING_SQL,
    "op8_minhash_near_dedup": MINMAX_SQL,
    "op10_secret_scans": SECRET_SQL,
    "op12_phrase_mining": PHRASE_SQL,
}
