"""Stream-stream verification: forecasts wait for the observation of their valid time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(forecasts: DataFrame, observations: DataFrame, space: Sequence[str], late: str = "2 days") -> DataFrame:
    """Forecast rows (valid_time, ...) with the observed value (time, ...), as both streams deliver them; state older than `late` goes.

    Works on batch frames too, where watermarks mean nothing.
    """
    f = forecasts.withWatermark("valid_time", late)
    o = observations.withColumnsRenamed({c: f"{c}_o" for c in observations.columns}).withWatermark("time_o", late)
    keys = [F.col("valid_time") == F.col("time_o"), *(F.col(c) == F.col(f"{c}_o") for c in space)]
    on = keys[0]
    for k in keys[1:]:
        on &= k
    return f.join(o, on)


def rolling_scores(pairs: DataFrame, value: str, by: Sequence[str], window: str = "1 day") -> DataFrame:
    """Mean squared and absolute error and bias per window of valid time and key; works with a watermark on valid_time."""
    error = F.col(value) - F.col(f"{value}_o")
    return pairs.groupBy(F.window("valid_time", window), *by).agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias"), F.count(F.lit(1)).alias("n"))
