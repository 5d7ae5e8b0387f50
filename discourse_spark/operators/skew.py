"""Equi-joins whose left side may have a few very frequent keys."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discourse_spark.session import materialize

HOT_SHARE = 0.001


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner",
                spread_by: str = "post_id", hot_share: float = HOT_SHARE) -> DataFrame:
    """Join on ``key``, splitting hot left keys until no task has more than ``hot_share`` of them.

    A key is hot when it holds more than ``hot_share`` of the left rows with a key,
    so there are at most ``1 / hot_share`` hot keys: a proven bound for a broadcast.
    Each gets as many salts as its share needs, and only the right rows of hot keys are
    repeated. Null keys match nothing and are spread too. The left side is read twice,
    once for its keys. It is the preserved one: ``how`` is inner or left.
    """
    counts = materialize(
        left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(
            F.count(F.lit(1)).alias("_n")
        ),
        "key-counts",
    )
    allowed = hot_share * counts.agg(F.sum("_n")).scalar()
    hot = F.broadcast(materialize(
        counts.where(F.col("_n") > allowed).select("_hot", F.ceil(F.col("_n") / allowed).alias("_salts")),
        "hot-keys",
    ))
    of_row = F.xxhash64(spread_by)
    spread = (
        F.when(F.col(key).isNull(), F.pmod(of_row, F.lit(math.ceil(1 / hot_share))))
        .when(F.col("_hot").isNotNull(), F.pmod(of_row, F.col("_salts")))
        .otherwise(F.lit(0))
    )
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1)
    is_hot = F.col(key) == F.col("_hot")
    salted_left = left.join(hot, is_hot, "left").withColumn("_salt", spread.cast("long"))
    salted_right = right.join(hot, is_hot, "left").withColumn("_salt", F.explode(copies))
    return (
        salted_left.drop("_hot", "_salts")
        .join(salted_right.drop("_hot", "_salts"), [key, "_salt"], how).drop("_salt")
    )
