"""Density clusters over a grid of cells.

A point is a core point if at least ``min_points`` points, itself included, lie within
``radius`` of it; core points within the radius of each other are one cluster, a point that is
within the radius of a core point belongs to the cluster of its nearest one, and all others are
noise. That is the definition of density clusters, found here without comparing all points:

1. Points fall into cells whose diagonal is the radius, so all points of a cell are within it.
   A cell of ``min_points`` or more holds core points only, and needs no counting.
2. Other points count neighbours in the cells around. A cell meets another one only if both
   hold points and their gap is below the radius; crowded cells are split into blocks, and
   blocks meet in tasks of bounded size.
3. Cells are nodes: two cells with core points within the radius are joined. Components come
   from rounds of star contraction over cells, of which there are far fewer than points.

Dimensions should be few (five after projection): the cells around one number up to
(2 ceil(sqrt(d)) + 1)^d, but only those that hold points are ever joined, over a coarse grid of
keys whose side is the radius plus a cell, so each cell looks into 3^d coarse neighbours.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discourse_spark.operators.ranks import with_running_total
from discourse_spark.session import materialize

NOISE = -1
BLOCK = 2_000  # points of a cell that one task compares with as many others


def _cells(point: str, side: float) -> Column:
    return F.transform(point, lambda x: F.floor(x / side).cast("long"))


def density_clusters(df: DataFrame, radius: float, min_points: int, features: str = "reduced",
                     id_col: str = "post_id") -> DataFrame:
    """Add ``cluster``: the smallest core id of the cluster a row belongs to, or null for noise.

    ``features`` is an array of doubles, the same length in all rows; ``id_col`` is unique.
    Rows with a null, empty, or non-finite vector are noise. A point near core points of
    several clusters goes to that of the nearest, of equally near ones to the smallest core id.
    """
    usable = F.size(features) > 0
    finite = ~F.exists(features, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    points = df.where(F.col(features).isNotNull() & usable & finite).select(
        F.col(id_col).alias("id"), F.col(features).cast("array<double>").alias("x")
    )
    first = points.first()
    if first is None:
        return df.withColumn("cluster", F.lit(None).cast("long"))
    dims = len(first["x"])
    side = radius / np.sqrt(dims)
    placed = materialize(points.withColumn("cell", _cells("x", side)), "points")
    sizes = materialize(placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    ), "cells")
    near = materialize(_near_cells(sizes.select("cell"), dims, side, radius), "near-cells")
    blocked = materialize(
        placed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "blocks"
    )
    crowded = F.col("n") >= min_points
    few = blocked.where(~crowded)
    counts = _met(few, blocked, near, sizes, _count_within(radius), "id long, found long").groupBy("id").agg(
        F.sum("found").alias("found")
    )
    core = materialize(
        blocked.where(crowded).select("id", "x", "cell", "block", "blocks").unionByName(
            few.join(counts.where(F.col("found") >= min_points), "id").select("id", "x", "cell", "block", "blocks")
        ), "core",
    )
    core_cells = core.groupBy("cell").agg(F.min("id").alias("low"))
    lows = materialize(core_cells, "core-cells")
    joined = _met(core, core, near, sizes, _any_within(radius), "a array<long>, b array<long>").distinct()
    edges = joined.join(lows.select(F.col("cell").alias("a"), F.col("low").alias("u")), "a").join(
        lows.select(F.col("cell").alias("b"), F.col("low").alias("v")), "b"
    ).where("u <> v").select("u", "v")
    found = _components(edges)
    cell_of = lows.join(found, F.col("low") == F.col("node"), "left").select(
        "cell", F.coalesce("root", "low").alias("cluster")
    )
    of_core = core.join(cell_of, "cell").select("id", "cluster")
    rest = blocked.join(core.select("id"), "id", "left_anti")
    nearest = _met(rest, core, near, sizes, _nearest_within(radius), "id long, away double, other long").groupBy("id").agg(
        F.min(F.struct("away", "other")).alias("best")
    ).select("id", F.col("best.other").alias("other"))
    of_border = nearest.join(of_core.withColumnRenamed("id", "other"), "other").select("id", "cluster")
    labels = of_core.unionByName(of_border).withColumnRenamed("id", "_of")
    return df.join(labels, F.col(id_col) == F.col("_of"), "left").drop("_of")


def _near_cells(cells: DataFrame, dims: int, side: float, radius: float) -> DataFrame:
    """(a, b): all pairs of cells, a cell with itself included, whose gap is at most the radius."""
    reach = int(np.ceil(radius / side)) + 1  # cells that one coarse key spans
    coarse = F.transform("cell", lambda c: F.floor(c / reach).cast("long"))
    keyed = cells.withColumn("key", coarse)
    moves = F.array(*[F.array(*[F.lit(m).cast("long") for m in move]) for move in itertools.product((-1, 0, 1), repeat=dims)])
    around = keyed.withColumn("move", F.explode(moves)).select(
        F.col("cell").alias("a"), F.zip_with("key", "move", lambda k, m: k + m).alias("key")
    )
    gaps = F.zip_with("a", "b", lambda a, b: F.pow(F.greatest(F.abs(a - b) - 1, F.lit(0)) * side, F.lit(2)))
    gap = F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g)
    return around.join(keyed.select(F.col("cell").alias("b"), "key"), "key").select("a", "b").where(
        gap <= radius * radius * (1 + 1e-9)
    )


def _met(left: DataFrame, right: DataFrame, near: DataFrame, sizes: DataFrame, work, schema: str) -> DataFrame:
    """Give ``work`` the points of each block of ``left`` with those of each block of ``right`` in near cells."""
    blocks = sizes.select(F.col("cell").alias("b"), F.col("blocks").alias("other_blocks"))
    some_left, some_right = (d.select("cell").distinct() for d in (left, right))
    pairs = materialize(
        near.join(some_left.withColumnRenamed("cell", "a"), "a").join(some_right.withColumnRenamed("cell", "b"), "b")
        .join(blocks, "b").join(sizes.select(F.col("cell").alias("a"), F.col("blocks").alias("own_blocks")), "a"),
        "meetings",
    )
    own = left.select(F.col("cell").alias("a"), "block", "id", "x").join(pairs.drop("own_blocks"), "a").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1))
    ).select("a", "block", "b", "other", F.lit(0).alias("side"), "id", "x")
    theirs = right.select(F.col("cell").alias("b"), F.col("block").alias("other"), "id", "x").join(
        pairs.drop("other_blocks"), "b"
    ).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1))).select(
        "a", "block", "b", "other", F.lit(1).alias("side"), "id", "x"
    )
    return own.unionByName(theirs).groupBy("a", "block", "b", "other").applyInPandas(work, schema)


def _sides(points: pd.DataFrame):
    one, two = points[points["side"] == 0], points[points["side"] == 1]
    if not len(one) or not len(two):
        return None
    x, y = np.stack(one["x"].to_numpy()), np.stack(two["x"].to_numpy())
    away = np.zeros((len(x), len(y)))
    for d in range(x.shape[1]):
        away += (x[:, d, None] - y[None, :, d]) ** 2
    return one["id"].to_numpy(), two["id"].to_numpy(), away


def _count_within(radius: float):
    def work(points: pd.DataFrame) -> pd.DataFrame:
        both = _sides(points)
        if both is None:
            return pd.DataFrame({"id": [], "found": []})
        ids, _, away = both
        return pd.DataFrame({"id": ids, "found": (away <= radius * radius).sum(axis=1)})

    return work


def _any_within(radius: float):
    def work(key, points: pd.DataFrame) -> pd.DataFrame:
        both = _sides(points)
        if both is None or not (both[2] <= radius * radius).any():
            return pd.DataFrame({"a": [], "b": []}, dtype=object)
        return pd.DataFrame({"a": [list(key[0])], "b": [list(key[2])]})

    return work


def _nearest_within(radius: float):
    def work(points: pd.DataFrame) -> pd.DataFrame:
        both = _sides(points)
        if both is None:
            return pd.DataFrame({"id": [], "away": [], "other": []})
        ids, others, away = both
        order = np.argsort(others)
        best = away[:, order].argmin(axis=1)  # the first of equals has the smallest id
        least = away[:, order][np.arange(len(ids)), best]
        some = least <= radius * radius
        return pd.DataFrame({"id": ids[some], "away": least[some], "other": others[order][best[some]]})

    return work


def _components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, by rounds of star contraction.

    A round links the larger neighbours of each node to its smallest neighbour, then the smaller
    ones; the number of rounds grows with the logarithm of the longest path.
    """
    both = materialize(edges.select("u", "v").distinct(), "edges")
    while True:
        around = both.union(both.select("v", "u")).toDF("u", "v")
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.join(low, "u").where("v > u").select(F.col("v"), F.col("m")).where("v <> m")
        large = materialize(large.distinct().toDF("u", "v"), "large-star")  # u > v
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = materialize(
            large.join(least, "u").where("v <> m").select("v", "m").union(least.select("u", "m")).toDF("u", "v")
            .distinct(), "small-star",
        )
        changed = small.join(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), ["u", "v"], "left_anti")
        done = changed.isEmpty() and small.count() == both.count()
        both = small
        if done:
            return both.select(F.col("u").alias("node"), F.col("v").alias("root"))


def with_topics(df: DataFrame, min_size: int, cluster: str = "cluster") -> DataFrame:
    """Add ``topic``: clusters of at least ``min_size`` rows by size, the largest 0; the rest is -1."""
    sizes = materialize(df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("_n")).where(
        F.col("_n") >= min_size
    ), "cluster-sizes")
    ranked = with_running_total(sizes.withColumn("_s", -F.col("_n")), ["_s", cluster]).select(
        F.col(cluster).alias("_c"), (F.col("_running") - 1).cast("int").alias("topic")
    )
    return df.drop("topic").join(ranked, F.col(cluster) == F.col("_c"), "left").withColumn(
        "topic", F.coalesce("topic", F.lit(NOISE)).cast("int")
    ).drop("_c")
