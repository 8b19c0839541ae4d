"""Self-supervised embedding of contigs: redundancy-reduction loss, a linear encoder, projection.

The encoder is linear. For linear maps the redundancy-reduction objective is a spectral problem on the covariance of the
two views, which a sum over the partitions gives; training is thus one pass and an eigen-decomposition of a matrix as wide
as the features, instead of epochs of gradient steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandbin.operators.sums import matrix_sum

#: Weight of the off-diagonal part of the loss; added to standard deviations.
OFF_DIAGONAL, EPSILON = 5e-3, 1e-6


def _views(b: pd.DataFrame, first: str, second: str) -> tuple[np.ndarray, np.ndarray]:
    return np.array(b[first].tolist(), dtype=np.float64), np.array(b[second].tolist(), dtype=np.float64)


def pair_moments(pairs: DataFrame, first: str, second: str, width: int) -> tuple[int, np.ndarray]:
    """Number of pairs and the sums of outer products of (1, x, y) with itself."""
    rows = pairs.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(first, second)

    def part(b: pd.DataFrame) -> np.ndarray:
        z = np.column_stack([np.ones(len(b)), *_views(b, first, second)])
        return z.T @ z

    sums = matrix_sum(rows, (2 * width + 1, 2 * width + 1), part)
    return int(sums[0, 0]), sums


def cross_correlation(pairs: DataFrame, first: str, second: str, width: int) -> np.ndarray:
    """Of both views' columns, each standardised by its sample deviation; zeros for fewer than two pairs."""
    n, s = pair_moments(pairs, first, second, width)
    if n < 2:
        return np.zeros((width, width))
    x, y = slice(1, width + 1), slice(width + 1, None)
    mean = s[0] / n
    dev = np.sqrt(np.maximum(np.diag(s) - n * mean**2, 0.0) / (n - 1)) + EPSILON
    cov = s[x, y] - n * np.outer(mean[x], mean[y])
    return cov / np.outer(dev[x], dev[y]) / n


def redundancy_loss(c: np.ndarray, off_diagonal: float = OFF_DIAGONAL) -> float:
    on = ((np.diag(c) - 1) ** 2).sum()
    return float(on + off_diagonal * ((c**2).sum() - (np.diag(c) ** 2).sum()))


@dataclass
class Encoder:
    mean: np.ndarray
    weights: np.ndarray


def fit_encoder(pairs: DataFrame, first: str, second: str, width: int, dim: int, ridge: float = 1e-3) -> Encoder:
    """The ``dim`` directions along which the two views of a contig agree best, whitened."""
    n, s = pair_moments(pairs, first, second, width)
    n = max(n, 1)
    x, y = slice(1, width + 1), slice(width + 1, None)
    mean = (s[0, x] + s[0, y]) / (2 * n)
    within = (s[x, x] + s[y, y]) / (2 * n) - np.outer(mean, mean)
    across = (s[x, y] + s[y, x]) / (2 * n) - np.outer(mean, mean)
    value, vector = np.linalg.eigh(within + ridge * np.trace(within) / width * np.eye(width) + 1e-15 * np.eye(width))
    white = vector / np.sqrt(value)
    shared, turn = np.linalg.eigh(white.T @ across @ white)
    return Encoder(mean, white @ turn[:, np.argsort(-shared)[:dim]])


def encode(rows: DataFrame, key: str, vector: str, encoder: Encoder, normalise: bool = True) -> DataFrame:
    """``key, embedding``: vectors of length 1, unless ``normalise`` is off; null vectors are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(encoder)
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = shared.value
        for b in batches:
            if len(b):
                z = (np.array(b["v"].tolist(), dtype=np.float64) - e.mean) @ e.weights
                if normalise:
                    z /= np.maximum(np.sqrt((z * z).sum(1)), 1e-12)[:, None]
                yield pd.DataFrame({"key": b["key"], "embedding": list(z.astype(np.float32))})

    picked = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    return picked.mapInPandas(run, f"key {kind}, embedding array<float>").withColumnRenamed("key", key)


def principal_axes(rows: DataFrame, vector: str, width: int, dim: int = 2) -> Encoder:
    """Principal axes from one sum; each axis' sign makes its largest entry positive."""

    def part(b: pd.DataFrame) -> np.ndarray:
        z = np.column_stack([np.ones(len(b)), np.array(b[vector].tolist(), dtype=np.float64)])
        return z.T @ z

    s = matrix_sum(rows.where(F.col(vector).isNotNull()).select(vector), (width + 1, width + 1), part)
    n = max(s[0, 0], 1.0)
    mean = s[0, 1:] / n
    _, axes = np.linalg.eigh(s[1:, 1:] / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :dim]
    return Encoder(mean, axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])]))


def project(rows: DataFrame, key: str, vector: str, axes: Encoder) -> DataFrame:
    """``key, x, y``."""
    w, mean = axes.weights, axes.mean

    def coordinate(j: int) -> F.Column:
        return F.aggregate(F.zip_with(vector, F.lit(w[:, j].tolist()), lambda a, b: a.cast("double") * b), F.lit(-float(mean @ w[:, j])), lambda s, x: s + x)

    return rows.where(F.col(vector).isNotNull()).select(key, coordinate(0).alias("x"), coordinate(1).alias("y"))
