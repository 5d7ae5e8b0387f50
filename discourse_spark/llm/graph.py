"""Connected components of a large edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discourse_spark.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b); component is the smallest id.

    Every round hangs neighbours below the smallest one seen, first on the large side,
    then on the small side, until each id hangs below its root. Rounds grow with the
    logarithm of the longest path. Frequent ids only meet in aggregates that combine
    before the shuffle and in joins that adaptive execution can split. Each round is a
    written table. Null ends and loops are left out; an empty table gives no rows.
    """
    now = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b").distinct(),
        "edges",
    )
    while True:
        large = written(_hang(now, "b"), "large-star")
        small = written(_small_star(large), "small-star")
        moved = large.where("moved").limit(1).count() or _moves(large, small)
        for old in (now, large):
            discard(old)
        now = small
        if not moved:
            break
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    own = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return roots.unionByName(own)


def _hang(edges: DataFrame, side: str) -> DataFrame:
    """Replace ``b`` of each edge by the smallest neighbour of its end ``side``."""
    lowest = edges.groupBy(F.col("a").alias("_end")).agg(F.min("b").alias("_lowest"))
    joined = edges.join(lowest, F.col(side) == F.col("_end"), "left")
    target = F.coalesce("_lowest", "b")
    return joined.groupBy("a", target.alias("b")).agg(
        F.max(target != F.col("b")).alias("moved")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie all smaller neighbours of an id, and the id itself, to the smallest one."""
    lowest = edges.groupBy(F.col("a").alias("_end")).agg(F.min("b").alias("_lowest"))
    moved = edges.join(lowest, F.col("a") == F.col("_end")).where("b <> _lowest").select(
        F.col("b").alias("a"), F.col("_lowest").alias("b")
    )
    kept = lowest.select(F.col("_end").alias("a"), F.col("_lowest").alias("b"))
    return moved.unionByName(kept).distinct()


def _moves(before: DataFrame, after: DataFrame) -> int:
    """Whether an id still has two neighbours, or a root hangs below another id."""
    two = before.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return two or after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
