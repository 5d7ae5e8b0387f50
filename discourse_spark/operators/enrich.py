"""Base analysis of a post table: defaults, cleaning, pronouns, rules, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discourse_spark.fixed_values import DATASET_SEPARATOR, TOXICITY_COLUMNS
from discourse_spark.functions.rules import apply_othering
from discourse_spark.functions.text import clean_text, tag_pronouns
from discourse_spark.operators.normalize import (
    coerce_numeric,
    detect_text_column,
    drop_duplicate_columns,
    ensure_columns,
    parse_post_date,
    rename_text,
)
from discourse_spark.operators.scoring import score_batches, top1_label

SCORE_COLUMNS = {
    **{c: ("double", None) for c in TOXICITY_COLUMNS},
    "emotion": ("string", None),
    "emotion_score": ("double", None),
}


def _or_null(df: DataFrame, name: str, data_type: str) -> Column:
    return F.col(name).cast(data_type) if name in df.columns else F.lit(None).cast(data_type)


def predicted_fallback(df: DataFrame) -> DataFrame:
    """Flag: model, else rule flag, else 0. Probability: model, else score/4, else 0."""
    flag = F.coalesce(
        _or_null(df, "othering_predicted", "int"), _or_null(df, "has_othering", "int"), F.lit(0)
    )
    probability = F.coalesce(
        _or_null(df, "othering_proba", "double"),
        _or_null(df, "othering_score", "double") / 4.0,
        F.lit(0.0),
    )
    return df.withColumns({"othering_predicted": flag, "othering_proba": probability})


def enrich_base(df: DataFrame, run_othering: bool = True, pronoun_mode: str = "lexicon",
                model=None) -> DataFrame:
    """All stages that need no language model; stages already present are skipped."""
    df = ensure_columns(df, {"source": ("string", "external"), "subreddit": ("string", "unknown")})
    if "clean_text" not in df.columns:
        df = df.withColumn("clean_text", clean_text("text"))
    if "pronoun_type" not in df.columns:
        df = tag_pronouns(df, "clean_text", pronoun_mode)
    if run_othering and "has_othering" not in df.columns:
        df = apply_othering(df)
    if model is not None and run_othering and "othering_predicted" not in df.columns:
        df = model.classify(df)
    df = predicted_fallback(df)
    df = ensure_columns(df, SCORE_COLUMNS)
    return ensure_columns(df, {"pronoun_type": ("string", "none")})


def _unscored(df: DataFrame, column: str) -> bool:
    """Is the column absent or null everywhere? The check stops at the first value."""
    return column not in df.columns or df.where(F.col(column).isNotNull()).isEmpty()


def enrich_full(df: DataFrame, run_othering: bool = True, toxicity=None, emotion=None,
                topics=None, model=None) -> DataFrame:
    """The base analysis and the optional stages that were asked for.

    ``toxicity`` and ``emotion`` are scorer loaders, ``topics`` adds topic and
    topic_name. Scores that are already there are kept.
    """
    need_toxicity = toxicity is not None and _unscored(df, "toxicity")
    need_emotion = emotion is not None and _unscored(df, "emotion")
    df = enrich_base(df, run_othering, model=model)
    if need_toxicity:
        df = score_batches(df, toxicity)
    if need_emotion:
        df = top1_label(df, emotion)
    return df if topics is None else topics(df)


def canonical_posts(df: DataFrame, dataset: str, already_analyzed: bool = False) -> DataFrame:
    """One raw table of any shape as canonical posts labelled with its dataset."""
    column, _ = detect_text_column(df)
    df = rename_text(drop_duplicate_columns(df), column)
    if already_analyzed and "othering_predicted" in df.columns:
        numeric = ["othering_predicted", "othering_proba", "othering_score", "toxicity"]
        df = coerce_numeric(df, numeric)
        df = df.withColumn(
            "othering_predicted", F.coalesce("othering_predicted", F.lit(0.0)).cast("int")
        )
        unknown = ("string", "unknown")
        df = ensure_columns(df, {c: unknown for c in ("subreddit", "source", "pronoun_type")})
        df = ensure_columns(
            df, {c: SCORE_COLUMNS[c] for c in ("toxicity", "emotion", "emotion_score")}
        )
    else:
        df = enrich_base(df)
    if "post_date" not in df.columns:
        df = parse_post_date(df)
    return df.withColumn("dataset", F.lit(dataset))


def dataset_label(group: str, file_name: str) -> str:
    return f"{group}{DATASET_SEPARATOR}{file_name}"


def completeness(columns_of: dict[str, list[str]], spark) -> DataFrame:
    """Which analysis stages each dataset already carries, from its header alone."""
    rows = []
    for dataset, columns in columns_of.items():
        have = set(columns)
        rows.append(
            (
                dataset,
                {"has_othering", "othering_predicted", "pronoun_type"} <= have,
                "toxicity" in have,
                "emotion" in have,
                {"topic", "topic_name"} <= have,
            )
        )
    schema = "dataset string, othering boolean, toxicity boolean, emotions boolean, topics boolean"
    return spark.createDataFrame(rows, schema)
