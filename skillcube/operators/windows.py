"""Moving windows and time bucketing."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillcube.operators.select import uniform_step

_AGGREGATES = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}


def _hours(n: int) -> Column:
    return F.expr(f"make_dt_interval(0, {int(n)})")


def rolling(df: DataFrame, value: str, by: Sequence[str], k: int, how: str = "mean", time: str = "time", name: str | None = None) -> DataFrame:
    """Trailing windows of k rows; missing until k values are there, and if any of them is missing."""
    run = Window.partitionBy(*by).orderBy(time).rowsBetween(-(k - 1), 0)
    return df.withColumn(name or value, F.when(F.count(value).over(run) == k, _AGGREGATES[how](value).over(run)))


def rolling_labelled(df: DataFrame, value: str, by: Sequence[str], period_hours: int, step_hours: int, how: str = "mean", side: str = "left", time: str = "time") -> DataFrame:
    """Rolling windows labelled by their start (left) or by the step after their end (right)."""
    if period_hours % step_hours:
        raise ValueError("the period must be a multiple of the step")
    rows = rolling(df, value, by, period_hours // step_hours, how, time)
    shift = step_hours - period_hours if side == "left" else step_hours
    return rows.withColumn(time, F.col(time) + _hours(shift))


def resample(df: DataFrame, values: dict[str, str], by: Sequence[str], period_hours: int, side: str = "left", time: str = "time", fill: bool = True, skipna: bool = True) -> DataFrame:
    """Buckets of period_hours that start at the first label's day. values: variable -> mean, min, max or sum.

    left: [T, T + period) labelled T. right: (T - period, T] labelled T, without the first bucket, which is not whole. fill: empty buckets appear with missing values.
    """
    period = int(period_hours) * 3600
    ends = df.agg(F.date_trunc("day", F.min(time)).alias("a"), F.max(time).alias("b")).first()
    if ends.a is None:
        return df.select(*by, time, *values)
    origin = F.lit(ends.a).cast("timestamp_ntz")
    seconds = F.timestamp_diff("SECOND", origin, F.col(time).cast("timestamp_ntz"))
    bucket = F.floor(seconds / period) if side == "left" else F.ceil(seconds / period)
    rows = df.withColumn("__b", bucket.cast("long"))
    if side == "right":
        rows = rows.where("__b > 0")
    out = rows.groupBy(*by, "__b").agg(*(_AGGREGATES[how](v).alias(v) if skipna else F.when(F.count(v) == F.count(F.lit(1)), _AGGREGATES[how](v)).alias(v) for v, how in values.items()))
    if fill:
        span = (ends.b - ends.a).total_seconds()
        last = int(span // period) if side == "left" else -int(-span // period)
        first = 0 if side == "left" else 1
        keys = out.select(*by).distinct() if by else df.sparkSession.range(1).select()
        grid = keys.withColumn("__b", F.explode(F.sequence(F.lit(first), F.lit(max(first, last))))).withColumn("__b", F.col("__b").cast("long"))
        out = grid.join(out, [*by, "__b"], "left")
    return out.select(*by, F.timestamp_add("SECOND", F.col("__b") * period, origin).alias(time), *values)


def resample_in_time(df: DataFrame, by: Sequence[str], period_hours: int, means: Sequence[str] = (), mins: Sequence[str] = (), maxs: Sequence[str] = (), sums: Sequence[str] = (), step_hours: int | None = None, method: str = "resample", side: str = "left", mean_suffix: bool = False, time: str = "time", skipna: bool = False) -> DataFrame:
    """Several statistics per variable. A variable with one statistic keeps its name unless it is a min, max or sum, which get a suffix, as means do with mean_suffix.

    method: resample (buckets) or rolling (windows of step_hours data).
    """
    wanted = [(v, how) for how, names in (("mean", means), ("min", mins), ("max", maxs), ("sum", sums)) for v in names]
    named = {(v, how): v if how == "mean" and not mean_suffix else f"{v}_{how}" for v, how in wanted}
    rows = df.select(*by, time, *(F.col(v).alias(n) for (v, _), n in named.items()))
    if method == "resample":
        return resample(rows, {n: how for (_, how), n in named.items()}, by, period_hours, side, time, skipna=skipna)
    if method != "rolling" or not step_hours or period_hours % step_hours:
        raise ValueError("rolling windows need the data's step, of which the period is a multiple")
    for (_, how), n in named.items():
        rows = rolling(rows, n, by, period_hours // step_hours, how, time)
    return rows.withColumn(time, F.col(time) + _hours(step_hours - period_hours if side == "left" else step_hours))


def weekly(df: DataFrame, value: str, by: Sequence[str], weeks: int = 1, how: str = "mean", time: str = "time") -> DataFrame:
    """Windows of whole weeks over daily data, labelled by their first day."""
    return rolling_labelled(df, value, by, weeks * 7 * 24, 24, how, "left", time)


def daily(df: DataFrame, value: str, by: Sequence[str], how: str = "mean", time: str = "time") -> DataFrame:
    return df.withColumn(time, F.date_trunc("day", F.col(time))).groupBy(*by, time).agg(_AGGREGATES[how](value).alias(value))


def daily_precipitation(df: DataFrame, by: Sequence[str], value: str = "total_precipitation", time: str = "time") -> DataFrame:
    """Daily sums of hourly amounts labelled by their end, as value_24hr: labels move back one hour first."""
    rows = df.withColumn(time, F.col(time) - _hours(1)).withColumnRenamed(value, f"{value}_24hr")
    return daily(rows, f"{value}_24hr", by, "sum", time)


#: Fixed names: amounts that are summed over a day, and the variable that becomes one.
ACCUMULATED, RENAMED = ("total_precipitation_24hr",), {"total_precipitation": "total_precipitation_24hr"}


def resample_daily(df: DataFrame, values: Sequence[str], by: Sequence[str], period: str = "1d", statistics: Sequence[str] = ("mean",), suffix: bool = False, method: str = "resample", time: str = "time") -> DataFrame:
    """Days (period Nd) of finer data, or windows of whole weeks (period Nw, method roll) of daily data labelled by their first day.

    statistics: mean, min, max. With suffix, which several statistics need, min and max are called value_min and value_max. Accumulated amounts are
    labelled by their end: they move back an hour and are summed, once whatever the statistics; what then falls before the first day goes. Missing
    values are skipped; a sum of none is 0, other statistics of none are missing.
    """
    n, unit = int(period[:-1]), period[-1]
    if unit not in "dw" or n < 1 or not statistics or set(statistics) - {"mean", "min", "max"} or method not in ("resample", "roll"):
        raise ValueError(f"period {period!r}, statistics {list(statistics)}, method {method!r}")
    if len(statistics) > 1 and not suffix:
        raise ValueError("several statistics need suffixes")
    if (method == "roll") != (unit == "w"):
        raise ValueError("weeks are rolled from days, days are resampled")
    df = df.withColumnsRenamed({k: v for k, v in RENAMED.items() if k in values})
    values = [RENAMED.get(v, v) for v in values]
    name = lambda v, how: f"{v}_{how}" if suffix and how != "mean" else v
    if method == "roll":
        if uniform_step(df, time) != timedelta(days=1):
            raise ValueError("weeks are rolled from daily data")
        rows = df.select(*by, time, *(F.col(v).alias(name(v, how)) for v in values for how in statistics))
        for v in values:
            for how in statistics:
                rows = rolling(rows, name(v, how), by, 7 * n, how, time)
        return rows.withColumn(time, F.col(time) - F.expr(f"INTERVAL {7 * n - 1} DAY"))
    plain, sums = [v for v in values if v not in ACCUMULATED], [v for v in values if v in ACCUMULATED]
    out = None
    if plain:
        rows = df.select(*by, time, *(F.col(v).alias(name(v, how)) for v in plain for how in statistics))
        out = resample(rows, {name(v, how): how for v in plain for how in statistics}, by, 24 * n, "left", time)
    if sums:
        first = df.agg(F.date_trunc("day", F.min(time)).cast("timestamp_ntz")).first()[0]
        rows = df.select(*by, F.col(time) - _hours(1), *sums).toDF(*by, time, *sums).where(F.col(time) >= F.lit(first))
        days = resample(rows, dict.fromkeys(sums, "sum"), by, 24 * n, "left", time).fillna(0.0, sums)
        out = days if out is None else out.join(days, [*by, time], "left")
    return out
