"""Small weight tables along one coordinate, computed on the driver: as many rows as the coordinate has labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A coordinate with more labels is no grid axis; its weights are joined without a broadcast.
AXIS_LABELS = 100_000


def axis(df: DataFrame, column: str) -> list:
    """Sorted labels of a grid axis."""
    return sorted(r[0] for r in df.select(column).distinct().collect())


def latitude_weights(latitudes: list[float]) -> np.ndarray:
    """Area of each latitude's band, scaled to mean 1. Bands meet half-way; the outer ones end at the poles."""
    points = np.radians(np.asarray(latitudes, float))
    bounds = np.concatenate([[-np.pi / 2], (points[:-1] + points[1:]) / 2, [np.pi / 2]])
    if not (np.diff(bounds) > 0).all():
        raise ValueError("latitudes must increase strictly between the poles")
    w = np.diff(np.sin(bounds))
    return w / w.mean()


def table(spark: SparkSession, labels: list[float], weights: np.ndarray, label: str, weight: str) -> DataFrame:
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(labels, weights, strict=True)], f"{label} double, {weight} double")


def with_latitude_weights(df: DataFrame, latitudes: list[float] | None = None, column: str = "latitude", weight: str = "w") -> DataFrame:
    """df with the weight of its latitude; latitudes: those of the whole frame, before any region."""
    labels = sorted(latitudes) if latitudes is not None else axis(df, column)
    weights = table(df.sparkSession, labels, latitude_weights(labels), column, weight)
    return df.join(F.broadcast(weights) if len(labels) <= AXIS_LABELS else weights, column)


def window_weights(size: int) -> np.ndarray:
    """Triangular weights of an odd window, mean 1; both end weights are 0."""
    if size % 2 != 1 or size < 1:
        raise ValueError("a window's size must be odd")
    half = np.linspace(0, 1, size // 2 + 1)
    w = np.concatenate([half, half[::-1][1:]]) if size > 1 else np.ones(1)
    return w / w.mean()
