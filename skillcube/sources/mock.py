"""Cubes without data, random values and random gaps, for tests and templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLES_3D = ("geopotential", "temperature", "u_component_of_wind", "v_component_of_wind", "specific_humidity")
VARIABLES_2D = ("2m_temperature",)


def _axis(df: DataFrame, name: str, values) -> DataFrame:
    return df.withColumn(name, F.explode(values))


def _space(df: DataFrame, levels: Sequence[int], degrees: float) -> DataFrame:
    n_lat, n_lon = round(180 / degrees) + 1, round(360 / degrees)
    df = _axis(df, "__lat", F.sequence(F.lit(0), F.lit(n_lat - 1))).withColumn("latitude", F.col("__lat") * (180 / (n_lat - 1)) - 90).drop("__lat")
    df = _axis(df, "__lon", F.sequence(F.lit(0), F.lit(n_lon - 1))).withColumn("longitude", F.col("__lon") * (360 / n_lon)).drop("__lon")
    return _axis(df, "level", F.array(*(F.lit(int(x)) for x in levels))) if levels else df


def _zeros(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: F.lit(0.0) for n in names})


def truth(spark: SparkSession, variables_3d: Sequence[str] = VARIABLES_3D, variables_2d: Sequence[str] = VARIABLES_2D, levels: Sequence[int] = (500, 700, 850), degrees: float = 10.0, start: str = "2020-01-01", stop: str = "2021-01-01", step_hours: int = 24) -> dict[str, DataFrame]:
    """Zeros on a regular grid, the end time excluded: {'3d': frame, '2d': frame}, those with variables."""
    times = spark.range(1).select(F.explode(F.expr(f"sequence(TIMESTAMP_NTZ'{start}', TIMESTAMP_NTZ'{stop}', INTERVAL {step_hours} HOUR)")).alias("time")).where(F.col("time") < F.lit(stop).cast("timestamp_ntz"))
    out = {}
    if variables_3d and levels:
        out["3d"] = _zeros(_space(times, levels, degrees), variables_3d)
    if variables_2d:
        out["2d"] = _zeros(_space(times, (), degrees), variables_2d)
    return out


def forecast(spark: SparkSession, lead_start: int = 0, lead_stop: int = 240, lead_step: int = 24, members: int | None = None, **kw) -> dict[str, DataFrame]:
    """As truth, with lead_hours (the end included) and members."""
    out = {}
    for k, df in truth(spark, **kw).items():
        df = _axis(df, "lead_hours", F.sequence(F.lit(lead_start).cast("long"), F.lit(lead_stop).cast("long"), F.lit(lead_step).cast("long")))
        out[k] = _axis(df, "member", F.sequence(F.lit(0), F.lit(members - 1))) if members else df
    return out


def hourly_climatology(spark: SparkSession, hour_step: int = 24, **kw) -> dict[str, DataFrame]:
    """Zeros by hour and day of year 1 to 366."""
    kw = {"start": "2020-01-01", "stop": "2020-01-02", "step_hours": 24} | kw
    out = {}
    for k, df in truth(spark, **kw).items():
        df = _axis(df.drop("time"), "hour", F.sequence(F.lit(0), F.lit(23), F.lit(hour_step)))
        out[k] = _axis(df, "dayofyear", F.sequence(F.lit(1), F.lit(366)))
    return out


def random_like(df: DataFrame, values: Sequence[str], seed: int = 0) -> DataFrame:
    return df.withColumns({v: F.randn(seed + i) for i, v in enumerate(values)})


def insert_gaps(df: DataFrame, values: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """The given share of values, at random, becomes missing."""
    return df.withColumns({v: F.when(F.rand(seed + i) >= share, F.col(v)) for i, v in enumerate(values)})
