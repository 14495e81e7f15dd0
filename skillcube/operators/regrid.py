"""Regridding between rectilinear grids: nearest, bilinear, conservative.

Weights are separable and sparse, computed on the driver along one axis at a time (as many rows as the axes' labels meet), so a field
is joined with two small tables and never with a whole matrix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.functions.numeric import fdiv

#: An axis' table with more rows is joined without a broadcast.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Grid:
    latitudes: tuple[float, ...]
    longitudes: tuple[float, ...]
    periodic: bool = True
    includes_poles: bool = True

    @staticmethod
    def regular(n_lat: int, n_lon: int, poles: bool = True, start_at_zero: bool = True) -> Grid:
        lat = np.linspace(-90, 90, n_lat) if poles else np.linspace(-90 + 90 / n_lat, 90 - 90 / n_lat, n_lat)
        step = 360 / n_lon
        lon = np.arange(n_lon) * step + (0 if start_at_zero else step / 2)
        return Grid(tuple(lat.tolist()), tuple(lon.tolist()), True, poles)

    def covers_globe(self) -> bool:
        """Whether the outer cells reach the poles and close the circle."""
        lat, lon = np.asarray(self.latitudes), np.asarray(self.longitudes)
        half = np.diff(lat).max() / 2 if len(lat) > 1 else 90
        return bool(lat.min() - half <= -90 + 1e-6 and lat.max() + half >= 90 - 1e-6 and (lon[-1] - lon[0]) + np.diff(lon).max() >= 360 - 1e-6)


def _broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _pairs(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return _broadcast(spark.createDataFrame(rows, schema), len(rows))


# ---- nearest


def nearest_pairs(source: Grid, target: Grid) -> list[tuple[float, float, float, float]]:
    """(lat, lon, source lat, source lon) of the nearest source point by great-circle distance; ties to the first in order of latitude, longitude."""
    lats, lons = np.radians(np.asarray(source.latitudes, float)), np.radians(np.asarray(source.longitudes, float))
    across = np.sin((lons[:, None] - np.radians(np.asarray(target.longitudes, float))) / 2) ** 2
    out = []
    for lat in target.latitudes:
        a = np.radians(lat)
        up, scale = np.sin((lats - a) / 2) ** 2, np.cos(a) * np.cos(lats)
        # on a rectilinear grid the nearest row is found with each target's smallest distance along the row, then the place in that row
        row = np.argmin(np.round(up[:, None] + scale[:, None] * across.min(axis=0), 12), axis=0)
        place = np.argmin(np.round(up[row] + scale[row] * across, 12), axis=0)
        out += [(float(lat), float(lon), float(source.latitudes[i]), float(source.longitudes[j])) for lon, i, j in zip(target.longitudes, row, place, strict=True)]
    return out


def nearest(df: DataFrame, values: Sequence[str], by: Sequence[str], source: Grid, target: Grid) -> DataFrame:
    table = _pairs(df.sparkSession, nearest_pairs(source, target), "lat double, lon double, latitude double, longitude double")
    return df.join(table, ["latitude", "longitude"]).select(*by, F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), *values)


# ---- bilinear


def linear_weights(source: Sequence[float], target: Sequence[float], period: float | None, clamp: bool) -> list[tuple[float, float, float]]:
    """(target, source, weight) of 1-D linear interpolation; targets without neighbours have no rows."""
    x = np.asarray(source, float)
    keys = x
    if period:
        keys, x = np.concatenate([[x[-1]], x, [x[0]]]), np.concatenate([[x[-1] - period], x, [x[0] + period]])
    out = []
    for t in target:
        p = float(t) % period if period else float(t)
        if period and p < x[0]:
            p += period
        if p < x[0] or p > x[-1]:
            if clamp:
                out.append((float(t), float(keys[0] if p < x[0] else keys[-1]), 1.0))
            continue
        i = int(min(np.searchsorted(x, p, "right") - 1, len(x) - 2)) if len(x) > 1 else 0
        if len(x) == 1:
            out.append((float(t), float(keys[0]), 1.0))
            continue
        f = (p - x[i]) / (x[i + 1] - x[i])
        out += [(float(t), float(k), float(w)) for k, w in ((keys[i], 1 - f), (keys[i + 1], f)) if w > 0]
    return out


def _linear_along(df: DataFrame, values: Sequence[str], by: Sequence[str], dim: str, rows: list[tuple[float, float, float]], labels: Sequence[float]) -> DataFrame:
    table = _pairs(df.sparkSession, rows, f"__to double, {dim} double, __k double")
    other = [c for c in by if c != dim]
    sums = [F.when(F.count(v) == F.count(F.lit(1)), F.sum(F.col(v) * F.col("__k"))).alias(v) for v in values]
    out = df.join(table, dim).groupBy(*other, F.col("__to").alias(dim)).agg(*sums)
    missing = sorted(set(map(float, labels)) - {r[0] for r in rows})
    if missing:
        gaps = df.select(*other).distinct().withColumn(dim, F.explode(F.array(*map(F.lit, missing))))
        out = out.unionByName(gaps, allowMissingColumns=True)
    return out


def bilinear(df: DataFrame, values: Sequence[str], by: Sequence[str], source: Grid, target: Grid) -> DataFrame:
    """Latitude first, then longitude. Beyond the outer latitudes: the outer value if the source has poles, else missing."""
    dims = [*by, "latitude", "longitude"]
    rows = _linear_along(df, values, dims, "latitude", linear_weights(source.latitudes, target.latitudes, None, source.includes_poles), target.latitudes)
    return _linear_along(rows, values, dims, "longitude", linear_weights(source.longitudes, target.longitudes, 360.0 if source.periodic else None, False), target.longitudes)


# ---- conservative


def bounds(points: Sequence[float], poles: bool) -> np.ndarray:
    """Cell edges: midpoints, the outer ones at the poles or half a cell out."""
    p = np.asarray(points, float)
    mid = (p[:-1] + p[1:]) / 2
    if poles:
        return np.concatenate([[-90.0], mid, [90.0]])
    return np.concatenate([[p[0] - (mid[0] - p[0])], mid, [p[-1] + (p[-1] - mid[-1])]])


def align_phase(x: np.ndarray, target: float, period: float = 360.0) -> np.ndarray:
    """x moved by whole periods to within half a period of target."""
    return x + np.round((target - x) / period) * period


def conservative_latitudes(source: Grid, target: Grid) -> list[tuple[float, float, float]]:
    s, t = np.clip(bounds(source.latitudes, source.includes_poles), -90, 90), np.clip(bounds(target.latitudes, target.includes_poles), -90, 90)
    sines, out = np.sin, []
    for j, label in enumerate(target.latitudes):
        lo, hi = np.maximum(s[:-1], t[j]), np.minimum(s[1:], t[j + 1])
        area = np.where(hi > lo, sines(np.radians(hi)) - sines(np.radians(lo)), 0)
        whole = sines(np.radians(t[j + 1])) - sines(np.radians(t[j]))
        if area.sum() <= 0 or not np.isclose(area.sum(), whole, rtol=1e-3):
            continue
        out += [(float(label), float(a), float(w / area.sum())) for a, w in zip(source.latitudes, area, strict=True) if w > 0]
    return out


def conservative_longitudes(source: Grid, target: Grid) -> list[tuple[float, float, float]]:
    def edges(points: Sequence[float], periodic: bool) -> tuple[np.ndarray, np.ndarray]:
        p = np.asarray(points, float)
        if periodic:
            around = np.concatenate([[p[-1] - 360], p, [p[0] + 360]])
            mid = (around[:-1] + around[1:]) / 2
        else:
            mid = bounds(p, False)
        return mid[:-1], mid[1:]

    if target.periodic and len(target.longitudes) < 3:
        raise ValueError("a periodic target needs three longitudes")
    (sl, sh), (tl, th) = edges(source.longitudes, source.periodic), edges(target.longitudes, target.periodic)
    out = []
    for j, label in enumerate(target.longitudes):
        total = np.zeros(len(sl))
        for shift in (-360.0, 0.0, 360.0) if source.periodic else (0.0,):
            total += np.maximum(0, np.minimum(sh + shift, th[j]) - np.maximum(sl + shift, tl[j]))
        if total.sum() <= 0 or not np.isclose(total.sum(), th[j] - tl[j], rtol=1e-3):
            continue
        out += [(float(label), float(a), float(w / total.sum())) for a, w in zip(source.longitudes, total, strict=True) if w > 1e-12]
    return out


def conservative(df: DataFrame, values: Sequence[str], by: Sequence[str], source: Grid, target: Grid) -> DataFrame:
    """Area-weighted means of overlapping source cells; missing cells leave both sums, none left is missing.

    Weighted sums and weights of present cells pass through both axes together, so missing cells are treated as in one two-dimensional sum.
    """
    spark = df.sparkSession
    lat, lon = conservative_latitudes(source, target), conservative_longitudes(source, target)
    rows = df.select(*by, "latitude", "longitude", *(F.col(v).alias(f"__s_{v}") for v in values), *(F.when(F.col(v).isNotNull(), 1.0).otherwise(0.0).alias(f"__w_{v}") for v in values))
    rows = rows.fillna(0.0, [f"__s_{v}" for v in values])
    for dim, table in (("longitude", lon), ("latitude", lat)):
        other = [c for c in (*by, "latitude", "longitude") if c != dim]
        pairs = _pairs(spark, table, f"__to double, {dim} double, __k double")
        rows = rows.join(pairs, dim).groupBy(*other, F.col("__to").alias(dim)).agg(*(F.sum(F.col(c) * F.col("__k")).alias(c) for v in values for c in (f"__s_{v}", f"__w_{v}")))
    return rows.select(*by, "latitude", "longitude", *(fdiv(F.col(f"__s_{v}"), F.when(F.col(f"__w_{v}") > 0, F.col(f"__w_{v}"))).alias(v) for v in values))


METHODS = {"nearest": nearest, "bilinear": bilinear, "conservative": conservative}


def regrid(df: DataFrame, values: Sequence[str], by: Sequence[str], source: Grid, target: Grid, method: str = "conservative") -> DataFrame:
    return METHODS[method](df, values, by, source, target)
