"""Climatologies by day of year: explicit (window over days and years) and fast (smoothed daily means).

The window is a circular one on a ring of 366 days. A line (a grid cell, and an hour if there are hours) is one row with all its days, which
no window multiplies: means are products with the ring's matrix of weights, for many lines at once, and quantiles sort a line's values once
and read every day's window off that order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skillcube.functions.numeric import fdiv
from skillcube.functions.weights import window_weights
from skillcube.operators.select import ordinals

RING = 366
#: Lines that are worked on at once.
LINES = 64


def _offsets(size: int) -> Column:
    """Structs of a day's distance o and its weight ww, over the window's days of positive weight."""
    half = size // 2
    return F.array(*(F.struct(F.lit(o - half).alias("o"), F.lit(float(x)).alias("ww")) for o, x in enumerate(window_weights(size)) if x > 0))


def _spread(df: DataFrame, size: int) -> DataFrame:
    """A row for each day of year whose window holds the row's day, with the weight ww. Zero weights at the ends make no rows."""
    rows = df.withColumn("__w", F.explode(_offsets(size)))
    return rows.withColumns({"dayofyear": F.pmod(F.col("dayofyear") - F.col("__w.o") - 1, F.lit(RING)) + 1, "ww": F.col("__w.ww")}).drop("__w")


def by_year_and_day(df: DataFrame, value: str, space: Sequence[str], hourly: bool, time: str = "time") -> DataFrame:
    """year, dayofyear 1..366 (and hour) with each year's missing days filled by its day 365. Daily means unless hourly."""
    extra = ["hour"] if hourly else []
    keyed = df.withColumns({"year": F.year(time), "dayofyear": F.dayofyear(time)} | ({"hour": F.hour(time)} if hourly else {}))
    per_day = keyed.groupBy("year", "dayofyear", *extra, *space).agg(F.avg(value).alias(value))
    lines = per_day.groupBy("year", *extra, *space).agg(F.max(F.when(F.col("dayofyear") == 365, F.col(value))).alias("__fill"))
    grid = lines.withColumn("dayofyear", F.explode(F.sequence(F.lit(1), F.lit(RING))))
    keys = ["year", "dayofyear", *extra, *space]
    return grid.join(per_day, keys, "left").select(*keys, F.coalesce(value, "__fill").alias(value))


def lines(df: DataFrame, value: str, space: Sequence[str], hourly: bool, time: str = "time") -> DataFrame:
    """A row per line with __days, an array of (year, dayofyear, value) that is as long as the series has days."""
    extra = ["hour"] if hourly else []
    keyed = df.withColumns({"year": F.year(time), "dayofyear": F.dayofyear(time)} | ({"hour": F.hour(time)} if hourly else {}))
    days = keyed.groupBy("year", "dayofyear", *extra, *space).agg(F.avg(value).alias("value"))
    return days.groupBy(*extra, *space).agg(F.collect_list(F.struct("year", "dayofyear", F.col("value").cast("double").alias("value"))).alias("__days"))


def _matrix(days: pa.StructArray) -> np.ndarray:
    """Years by 366 days of one line; a year's missing days are filled by its day 365, what is still missing is NaN."""
    year, day, x = (np.asarray(days.field(k).to_numpy(zero_copy_only=False)) for k in ("year", "dayofyear", "value"))
    _, row = np.unique(year, return_inverse=True)
    out = np.full((row.max(initial=-1) + 1, RING), np.nan)
    out[row, day - 1] = x.astype(float)
    return np.where(np.isnan(out), out[:, 364:365], out)


def _around_the_ring(rows: DataFrame, columns: dict[str, str], per_line: Callable[[list[np.ndarray]], list[dict[str, np.ndarray]]]) -> DataFrame:
    """A line's rows with the columns that per_line makes of its matrix; per_line gets some lines at once."""
    names = [c for c in rows.columns if c != "__days"]
    schema = T.StructType([T.StructField(k, {"int": T.IntegerType(), "double": T.DoubleType()}[t], True) for k, t in columns.items()] + [rows.schema[n] for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LINES):
                part = batch.slice(at, LINES)
                days = part.column("__days")
                made = per_line([_matrix(days[k].values) for k in range(len(days))])
                line = pa.array(np.repeat(np.arange(len(made)), [len(next(iter(m.values()))) for m in made]))
                new = {k: np.concatenate([m[k] for m in made]) for k in columns}
                arrays = [pa.array(x, mask=np.isnan(x) if x.dtype.kind == "f" else None) for x in new.values()]
                yield pa.RecordBatch.from_arrays([*arrays, *(part.column(n).take(line) for n in names)], [*columns, *names])

    return rows.mapInArrow(run, schema)


def _ring_weights(size: int) -> np.ndarray:
    """Weight of a day at each distance (0 to 365) after the window's own day."""
    if size > RING:
        raise ValueError("a window is no longer than the ring")
    out = np.zeros(RING)
    out[np.arange(-(size // 2), size // 2 + 1) % RING] = window_weights(size)
    return out


def explicit(df: DataFrame, value: str, space: Sequence[str], statistics: Sequence[str] = ("mean",), window: int = 61, hourly: bool = False, time: str = "time") -> DataFrame:
    """Weighted mean and population std over window and years, missing values skipped: columns value and value_std.

    Sums of counts, differences from the line's mean and their squares by day of year, each times the ring's matrix of weights.
    """
    weights = _ring_weights(window)
    circle = weights[(np.arange(RING)[:, None] - np.arange(RING)) % RING]  # symmetric: the window is

    def per_line(matrices: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
        centre = np.array([np.nanmean(m) if not np.isnan(m).all() else 0.0 for m in matrices])
        off = [m - c for m, c in zip(matrices, centre, strict=True)]
        n, x, xx = (np.array(s) @ circle for s in ([(~np.isnan(o)).sum(0) for o in off], [np.nansum(o, 0) for o in off], [np.nansum(o * o, 0) for o in off]))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean, square = x / n, xx / n
        out = []
        for k in range(len(matrices)):
            there = n[k] > 1e-9
            std = np.sqrt(np.maximum(square[k] - mean[k] ** 2, 0))[there]
            out.append({"dayofyear": np.flatnonzero(there).astype(np.int32) + 1, value: (centre[k] + mean[k])[there], f"{value}_std": std})
        return out

    rows = _around_the_ring(lines(df, value, space, hourly, time), {"dayofyear": "int", value: "double", f"{value}_std": "double"}, per_line)
    return rows.drop(*(c for s, c in (("mean", value), ("std", f"{value}_std")) if s not in statistics))


def custom(df: DataFrame, value: str, space: Sequence[str], statistic, window: int = 61, hourly: bool = False, time: str = "time") -> DataFrame:
    """Any statistic over window and years: statistic(value column, weight column) gives an aggregate. Missing values are there as NULL."""
    rows = _spread(by_year_and_day(df, value, space, hourly, time), window)
    return rows.groupBy("dayofyear", *(["hour"] if hourly else []), *space).agg(statistic(F.col(value), F.col("ww")).alias(value))


def _smoothed(df: DataFrame, value: str, keys: Sequence[str], window: int) -> DataFrame:
    """Mean over the window's days of value times weight, on the ring of the days that occur; missing values do not count."""
    w = window_weights(window)
    half = window // 2
    days = ordinals(df, "dayofyear", "__p")
    ring = days.count()
    pairs = F.array(*(F.struct(F.lit(o - half).alias("o"), F.lit(float(x)).alias("ww")) for o, x in enumerate(w)))
    rows = df.join(F.broadcast(days), "dayofyear").drop("dayofyear").withColumn("__w", F.explode(pairs))  # at most 366 days
    rows = rows.withColumn("__p", F.pmod(F.col("__p") + F.col("__w.o"), F.lit(max(1, ring))))
    means = rows.groupBy("__p", *keys).agg(F.avg(F.col(value) * F.col("__w.ww")).alias(value))
    return means.join(F.broadcast(days), "__p").select("dayofyear", *keys, value)


def fast(df: DataFrame, value: str, space: Sequence[str], statistic: str = "mean", window: int = 61, hourly: bool = False, time: str = "time") -> DataFrame:
    """Statistics per day of year over all years, then circular smoothing over the days that occur. A daily std is of daily means."""
    extra = ["hour"] if hourly else []
    keyed = df
    if statistic == "std" and not hourly:
        keyed = df.withColumn(time, F.date_trunc("day", F.col(time))).groupBy(time, *space).agg(F.avg(value).alias(value))
    keyed = keyed.withColumns({"dayofyear": F.dayofyear(time)} | ({"hour": F.hour(time)} if hourly else {}))
    agg = {"mean": F.avg, "std": F.stddev_pop}[statistic]
    per_day = keyed.groupBy("dayofyear", *extra, *space).agg(agg(value).alias(value))
    out = _smoothed(per_day, value, [*extra, *space], window)
    return out.withColumnRenamed(value, f"{value}_std") if statistic == "std" else out


def weighted_quantiles(df: DataFrame, value: str, weight: str, by: Sequence[str], q: Sequence[float]) -> DataFrame:
    """Weighted quantiles (type 7 with Kish's effective size) on a dimension quantile; missing values and zero weights are dropped."""
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    cell = Window.partitionBy(*by)
    run = cell.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    w = F.col(weight)
    rows = rows.withColumns({"__n": F.sum(w).over(cell) ** 2 / F.sum(w * w).over(cell), "__hi": F.sum(w).over(run) / F.sum(w).over(cell)})
    rows = rows.withColumn("__lo", F.col("__hi") - w / F.sum(w).over(cell)).withColumn("quantile", F.explode(F.array(*(F.lit(float(x)) for x in q))))
    n, h = F.col("__n"), (F.col("__n") - 1) * F.col("quantile") + 1

    def v(edge: Column) -> Column:
        u = F.greatest((h - 1) / n, F.least(h / n, edge))
        return u * n - h + 1

    return rows.groupBy(*by, "quantile").agg(F.sum(F.col(value) * (v(F.col("__hi")) - v(F.greatest(F.col("__lo"), F.lit(0.0))))).alias(value))


def _quantiles(x: np.ndarray, w: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Weighted quantiles (type 7 with Kish's effective size) of sorted values; no value, no quantile."""
    if not len(x):
        return np.full(len(q), np.nan)
    total = w.sum()
    n = total**2 / (w * w).sum()
    edges = np.concatenate([[0.0], np.cumsum(w) / total])
    h = ((n - 1) * q + 1)[:, None]
    u = np.maximum((h - 1) / n, np.minimum(h / n, edges)) * n - h + 1
    return (np.diff(u, axis=1) * x).sum(1)


def _windows(matrix: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted values and weights of every day's window, in order of the days. The line is sorted once."""
    day = np.broadcast_to(np.arange(RING), matrix.shape)
    there = ~np.isnan(matrix)
    x, day = matrix[there], day[there]
    order = np.argsort(x, kind="stable")
    x, day = x[order], day[order]
    for d in range(RING):
        w = weights[(day - d) % RING]
        inside = w > 0
        yield x[inside], w[inside]


def quantile(df: DataFrame, value: str, space: Sequence[str], q: Sequence[float], window: int = 61, hourly: bool = False, time: str = "time") -> DataFrame:
    """Weighted quantiles over window and years (see weighted_quantiles), missing values skipped: value_quantile on a dimension quantile."""
    weights, levels = _ring_weights(window), np.array([float(x) for x in q])

    def per_line(matrices: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
        out = []
        for m in matrices:
            found = np.array([_quantiles(x, w, levels) for x, w in _windows(m, weights)])
            kept = np.repeat(~np.isnan(found).all(1), len(levels))
            days = np.repeat(np.arange(1, RING + 1, dtype=np.int32), len(levels))
            out.append({"dayofyear": days[kept], "quantile": np.tile(levels, RING)[kept], f"{value}_quantile": found.ravel()[kept]})
        return out

    return _around_the_ring(lines(df, value, space, hourly, time), {"dayofyear": "int", "quantile": "double", f"{value}_quantile": "double"}, per_line)


def seeps(df: DataFrame, value: str, space: Sequence[str], dry_mm: float = 0.25, window: int = 61, hourly: bool = False, time: str = "time") -> DataFrame:
    """value_seeps_threshold: weighted 2/3 quantile of amounts that are not dry; value_seeps_dry_fraction: plain share of dry ones, missing counted as not dry."""
    d, weights, half = dry_mm / 1000, _ring_weights(window), window // 2

    def per_line(matrices: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
        out = []
        for m in matrices:
            dry = np.nan_to_num(m, nan=np.inf) < d
            around = np.cumsum(np.concatenate([[0], np.take(dry.sum(0), np.arange(-half, RING + half), mode="wrap")]))
            wet = np.array([_quantiles(x, w, np.array([2 / 3]))[0] for x, w in _windows(np.where(dry, np.nan, m), weights)])
            out.append({"dayofyear": np.arange(1, RING + 1, dtype=np.int32), f"{value}_seeps_dry_fraction": (around[window:] - around[:-window]) / (window * len(m)), f"{value}_seeps_threshold": wet})
        return out

    return _around_the_ring(lines(df, value, space, hourly, time), {"dayofyear": "int", f"{value}_seeps_dry_fraction": "double", f"{value}_seeps_threshold": "double"}, per_line)


def expand(climatology: DataFrame, times: DataFrame, time: str = "time") -> DataFrame:
    """A climatology written out on a time index."""
    from skillcube.operators.align import calendar_keys

    keys = calendar_keys(time, "hour" in climatology.columns)
    return times.withColumns(keys).join(climatology, list(keys)).drop(*keys)


def mean_dry_fraction(climatology: DataFrame, value: str, space: Sequence[str]) -> DataFrame:
    return climatology.groupBy(*space).agg(F.avg(f"{value}_seeps_dry_fraction").alias("p1"))


__all__ = ["by_year_and_day", "expand", "explicit", "fast", "fdiv", "mean_dry_fraction", "quantile", "seeps", "weighted_quantiles"]
