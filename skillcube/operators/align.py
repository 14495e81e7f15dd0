"""Alignment of forecasts with observations, climatologies and analyses through joins on labels.

Frames are joined on their keys without hints: Spark broadcasts a side that it knows to be small and merges sorted sides otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillcube.operators.select import MissingLabel


def guard(wanted: DataFrame, have: DataFrame, what: str) -> None:
    """Raise unless every row that is wanted is among those there are."""
    if wanted.join(have, wanted.columns, "left_anti").take(1):
        raise MissingLabel(f"{what} lacks labels that are needed")


def _renamed(df: DataFrame, keys: Sequence[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c not in keys})


def time_conventions(forecast: DataFrame, by_init: bool, lead: str = "lead_hours") -> DataFrame:
    """By init: time becomes init_time and valid_time follows. By valid: time stays and init_time follows."""
    hours = F.expr(f"make_dt_interval(0, CAST({lead} AS INT))")
    if by_init:
        return forecast.withColumnRenamed("time", "init_time").withColumn("valid_time", F.col("init_time") + hours)
    return forecast.withColumn("init_time", F.col("time") - hours)


def with_truth(forecast: DataFrame, truth: DataFrame, space: Sequence[str], by_init: bool = True, suffix: str = "_t", strict: bool = False) -> DataFrame:
    """Forecast rows with the truth at their valid time (by init) or time (by valid). strict: a missing time raises."""
    key = "valid_time" if by_init else "time"
    right = _renamed(truth.withColumnRenamed("time", key), [key, *space], suffix)
    if strict:
        guard(forecast.select(key).distinct(), right.select(key).distinct(), "truth")
    return forecast.join(right, [key, *space])


def calendar_keys(time: str, hourly: bool) -> dict[str, Column]:
    keys = {"dayofyear": F.dayofyear(time)}
    return keys | {"hour": F.hour(time)} if hourly else keys


def with_climatology(df: DataFrame, climatology: DataFrame, space: Sequence[str], time: str = "valid_time", suffix: str = "_c", how: str = "inner", strict: bool = False) -> DataFrame:
    """Rows with the climatology of their day of year, and hour if the climatology has hours. strict: a missing one raises."""
    keys = calendar_keys(time, "hour" in climatology.columns)
    if strict:
        guard(df.select(time).distinct().select(*(c.alias(k) for k, c in keys.items())).distinct(), climatology.select(*keys).distinct(), "climatology")
        guard(df.select(*space).distinct(), climatology.select(*space).distinct(), "the climatology's grid")
    right = _renamed(climatology, [*keys, *space], suffix)
    return df.withColumns(keys).join(right, [*keys, *space], how).drop(*keys)


def climatology_column(columns: Sequence[str], name: str) -> str:
    """name or name_mean, whichever a climatology has."""
    for c in (name, f"{name}_mean"):
        if c in columns:
            return c
    raise KeyError(name)


def climatology_forecast(forecast: DataFrame, climatology: DataFrame, values: Sequence[str], space: Sequence[str], time: str = "valid_time", strict: bool = False) -> DataFrame:
    """The forecast's cells with the climatology's values in place of its own."""
    cells = forecast.drop(*values)
    chosen = {v: climatology_column(climatology.columns, v) for v in values}
    joined = with_climatology(cells, climatology, space, time, strict=strict)
    return joined.select(*cells.columns, *(F.col(c + "_c").alias(v) for v, c in chosen.items()))


def stack_years(observations: DataFrame, start_year: int, time: str = "time") -> DataFrame:
    """Observations keyed by day of year and hour, the year as a member number."""
    return observations.withColumns({**calendar_keys(time, True), "number": F.year(time) - start_year}).drop(time)


def probabilistic_climatology_forecast(cells: DataFrame, stacked: DataFrame, space: Sequence[str], time: str = "valid_time", strict: bool = False) -> DataFrame:
    """Every year's value for a cell's day of year and hour, as members."""
    keys = calendar_keys(time, True)
    if strict:
        guard(cells.select(time).distinct().select(*(c.alias(k) for k, c in keys.items())).distinct(), stacked.select(*keys).distinct(), "the years observed")
    return cells.withColumns(keys).join(stacked, [*keys, *space]).drop(*keys)


def persistence_forecast(cells: DataFrame, truth: DataFrame, space: Sequence[str], init: str = "init_time", strict: bool = False) -> DataFrame:
    """The value observed at the initial time, for every lead time. strict: a missing time raises."""
    if strict:
        guard(cells.select(init).distinct(), truth.select(F.col("time").alias(init)).distinct(), "truth at initial times")
    return cells.join(truth.withColumnRenamed("time", init), [init, *space])


def analysis_truth(forecast: DataFrame, values: Sequence[str], space: Sequence[str]) -> DataFrame:
    """The forecast's own values at lead time 0 as truth, keyed by time. by-init frames."""
    return forecast.where("lead_hours = 0").select(F.col("init_time").alias("time"), *space, *values)


def match_analysis_steps(forecast: DataFrame, init_step_hours: int) -> DataFrame:
    """Lead times that analyses exist for: multiples of the spacing of initial times."""
    return forecast.where(F.col("lead_hours") % init_step_hours == 0)


def sampled(mapping: DataFrame, observations: DataFrame) -> DataFrame:
    """Rows (time, member, lead_hours, source_time) with the observations at their source time, all of which must exist."""
    guard(mapping.select(F.col("source_time").alias("time")).distinct(), observations.select("time").distinct(), "observations")
    return mapping.join(observations.withColumnRenamed("time", "source_time"), "source_time")


def merge(results: Sequence[DataFrame]) -> DataFrame:
    """Result tables in one, missing variables as NULL."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def index_on_valid_time(forecast: DataFrame, dims: Sequence[str], init_step_hours: int, values: Sequence[str], pad: bool = True) -> DataFrame:
    """valid time and lead: keeps leads in step with initial times (counted from the first lead), time = init + lead; cells that no initial time fills are missing."""
    first = forecast.agg(F.min("lead_hours")).first()[0]
    step = F.expr("make_dt_interval(0, CAST(lead_hours AS INT))")
    kept = forecast.where((F.col("lead_hours") - first) % init_step_hours == 0).withColumn("time", F.col("init_time") + step)
    other = [d for d in dims if d not in ("init_time", "lead_hours")]
    kept = kept.select("time", "lead_hours", *other, *(F.col(v).cast("float").alias(v) for v in values))
    if not pad:
        return kept
    from skillcube.operators.reduce import densify

    return densify(kept, [["time"], ["lead_hours"], *([other] if other else [])])


def valid_and_init(forecast: DataFrame) -> DataFrame:
    """valid time and initial time in place of the lead time."""
    return forecast.withColumn("time", F.col("init_time") + F.expr("make_dt_interval(0, CAST(lead_hours AS INT))")).drop("lead_hours")
