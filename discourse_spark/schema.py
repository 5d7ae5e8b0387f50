"""The canonical post table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discourse_spark.operators.normalize import parse_pattern_list, parse_timestamp


def _struct(*groups: tuple[str, str]) -> T.StructType:
    """A schema from (type, names) groups, built without a session."""
    schema = T.StructType()
    for data_type, names in groups:
        for name in names.split():
            schema.add(name, data_type)
    return schema


POSTS = _struct(
    ("long", "post_id"),
    ("string", "text source subreddit dataset"),
    ("long", "score created_utc"),
    ("timestamp", "post_date"),
    ("string", "clean_text"),
    ("boolean", "has_we has_them"),
    ("integer", "we_count them_count"),
    ("string", "pronoun_type"),
    ("boolean", "has_othering"),
    ("integer", "othering_score"),
    ("double", "toxicity severe_toxicity identity_attack insult threat"),
    ("string", "emotion"),
    ("double", "emotion_score"),
    ("integer", "othering_predicted"),
    ("double", "othering_proba"),
    ("integer", "topic"),
    ("string", "topic_name"),
).add("matched_patterns", T.ArrayType(T.StringType()))

CALENDAR = _struct(("string", "date title category country region source"))


def conform(df: DataFrame) -> DataFrame:
    """Cast the known columns to their canonical types; what does not parse is null."""
    new = {}
    for field in POSTS.fields:
        if field.name not in df.columns or df.schema[field.name].dataType == field.dataType:
            continue
        column = F.col(field.name)
        if field.name == "matched_patterns":
            new[field.name] = parse_pattern_list(column)
        elif field.name == "post_date":
            new[field.name] = parse_timestamp(column.cast("string"))
        elif isinstance(field.dataType, (T.IntegerType, T.LongType)):
            # exact first: a double holds no integer beyond 2^53
            new[field.name] = F.coalesce(
                column.try_cast(field.dataType), column.try_cast("double").try_cast(field.dataType)
            )
        else:
            new[field.name] = column.try_cast(field.dataType)
    return df.withColumns(new)
