"""Main directions of wide vectors by a randomised block method.

A few more random directions than wanted are multiplied with the rows and back, some times, each
time as one pass that adds up arrays per task. The arrays have one row per feature and one
column per direction, never one per pair of features, so vectors may be as wide as a
vocabulary. Only such an array, and small matrices between directions, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discourse_spark.operators.newton import Block, blocks, tree_sum

EXTRA = 10  # random directions more than wanted
ROUNDS = 4  # passes that sharpen them


@dataclass
class Directions:
    """Orthonormal directions (columns), the variance of the rows along each, and all of it."""

    vectors: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    total: float

    def captured(self) -> float:
        return float(self.variance.sum() / self.total) if self.total > 0 else 0.0


def main_directions(df: DataFrame, k: int, features: str = "features", rounds: int = ROUNDS,
                    seed: int = 42) -> Directions:
    """The ``k`` directions along which rows vary most, about their mean.

    Each direction points so that its largest entry is positive. Null vectors are left out. With
    fewer features or no rows there are as many directions as features, along which
    nothing varies.
    """
    first = df.select(features).where(F.col(features).isNotNull()).first()
    size = first[0].size if first else 0
    ones = df.select(F.col(features).alias("features"), F.lit(1.0).alias("label"), F.lit(1.0).alias("w"))
    blocked = blocks(ones, "features", "label", ["w"])
    width = min(k + EXTRA, size)

    def moments(b: Block) -> np.ndarray:
        n = np.ones((1, len(b.targets)))
        squares = np.append(np.bincount(b.columns, b.values**2, minlength=size), len(b.targets))
        return np.stack([b.back(n, size)[0], squares])

    sums = tree_sum(blocked, moments, (2, size + 1))
    n = max(sums[0, -1], 1.0)
    mean = sums[0, :-1] / n
    total = float((sums[1, :-1] / n - mean**2).sum())

    def covariance_times(v: np.ndarray) -> np.ndarray:
        """Of the rows about their mean; ``v`` has directions as columns."""
        shift = mean @ v

        def of_block(b: Block) -> np.ndarray:
            z = b.dot(np.hstack([v.T, -shift[:, None]]))
            back = b.back(z, size)
            return back[:, :-1].T - np.outer(mean, back[:, -1])

        return tree_sum(blocked, of_block, (size, v.shape[1])) / n

    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    for _ in range(rounds - 1):
        basis = np.linalg.qr(covariance_times(basis))[0]
    product = covariance_times(basis)
    values, turns = np.linalg.eigh((basis.T @ product + product.T @ basis) / 2)
    order = np.argsort(-values)[:k]
    vectors = basis @ turns[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if size else np.ones(0)
    return Directions(vectors * np.where(signs == 0, 1, signs), mean, np.maximum(values[order], 0), total)


def project(df: DataFrame, directions: Directions, features: str = "features", output: str = "reduced") -> DataFrame:
    """Add the coordinates of each row along the directions as an array; null for null vectors.

    The directions are broadcast once: a row per feature, a column per direction.
    """
    held = df.sparkSession.sparkContext.broadcast((directions.vectors, directions.mean @ directions.vectors))
    vector = F.unwrap_udt(F.col(features))
    indices = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(vector["values"]) - 1))

    @F.arrow_udf("array<double>")
    def placed(at: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        vectors, shift = held.value
        for columns, values in at:
            sizes = np.where(columns.is_valid().to_numpy(zero_copy_only=False), np.asarray(
                pa.compute.fill_null(pa.compute.list_value_length(columns), 0)), 0).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            c = columns.flatten().to_numpy(zero_copy_only=False)
            x = values.flatten().to_numpy(zero_copy_only=False)
            out = np.stack([
                np.bincount(owner, x * vectors[c, j], minlength=len(sizes)) - shift[j] for j in range(len(shift))
            ], axis=1) if len(shift) else np.zeros((len(sizes), 0))
            offsets = pa.array(np.arange(len(sizes) + 1) * len(shift), pa.int32())
            yield pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return df.withColumn(output, F.when(F.col(features).isNotNull(), placed(indices, vector["values"])))
