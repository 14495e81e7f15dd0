"""Cubes in files: Parquet tables with dimension columns and one double column per variable, Zarr stores (paths that end in .zarr) or classic
netCDF files (.nc)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.operators import select
from skillcube.operators.align import time_conventions
from skillcube.sources.netcdf import File, read_netcdf, write_netcdf
from skillcube.sources.zarr import Cube, read_zarr, write_zarr

#: Dimensions of a cube in the order in which a store has them.
DIMS = ("time", "lead_hours", "init_time", "member", "level", "latitude", "longitude")


def is_zarr(path: str) -> bool:
    return path.rstrip("/").endswith(".zarr")


def read_cube(spark: SparkSession, path: str, variables: Sequence[str] | None = None, dims: Sequence[str] = DIMS) -> DataFrame:
    """A cube; only the wanted columns are read, of a store or an array file only those arrays. NaN becomes missing. A store's prediction_timedelta is lead_hours."""
    if is_zarr(path) or path.endswith(".nc"):
        opened, read = (Cube, read_zarr) if is_zarr(path) else (File, read_netcdf)
        wanted = list(variables) if variables is not None else opened(path).variables()
        df = read(spark, path, wanted).withColumnRenamed("prediction_timedelta", "lead_hours")
        keys = [c for c in df.columns if c not in wanted]
    else:
        df = spark.read.parquet(path)
        keys = [d for d in dims if d in df.columns]
    df = df.select(*keys, *(variables if variables is not None else [c for c in df.columns if c not in keys]))
    numbers = {f.name for f in df.schema.fields if f.name not in keys and f.dataType.typeName() in ("float", "double")}
    # what is known of a variable's dimensions stays with its column
    return df.select(*(F.when(~F.isnan(f.name), F.col(f.name).cast("double")).alias(f.name, metadata=f.metadata) if f.name in numbers else F.col(f.name) for f in df.schema.fields))


def open_forecast(spark: SparkSession, path: str, by_init: bool, rename: dict[str, str] | None = None, level_suffixes: bool = False, variables: Sequence[str] | None = None) -> DataFrame:
    """Read, rename, decode level suffixes, and put time conventions in place."""
    df = read_cube(spark, path, variables)
    df = select.rename(df, {"prediction_timedelta": "lead_hours"} | (rename or {}))
    if level_suffixes:
        df = select.decode_levels(df, [c for c in ("time", "lead_hours", "member", "latitude", "longitude") if c in df.columns])
    return time_conventions(df, by_init) if "lead_hours" in df.columns else df


def write_cube(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error", dims: Sequence[str] = (*DIMS, "hour", "dayofyear", "quantile"), chunks: dict[str, int] | None = None) -> None:
    """A cube as Parquet, or as a store with chunks of so many labels (dims: which columns are dimensions)."""
    if is_zarr(path):
        return write_zarr(df, path, [d for d in dims if d in df.columns], chunks)
    if path.endswith(".nc"):
        return write_netcdf(df, path, [d for d in dims if d in df.columns])
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share; on a single machine a local one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='skillcube-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove what was written to a path when the driver's JVM ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def remove(spark: SparkSession, path: str) -> None:
    """Remove what was written to a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_result(df: DataFrame, output_dir: str, name: str, prefix: str = "", fmt: str = "parquet") -> str:
    """A result cube, small by construction, under {dir}/{prefix}{name}. Formats: parquet, csv, json, and zarr or netcdf (metrics and regions are then labels)."""
    path = f"{output_dir.rstrip('/')}/{prefix}{name}"
    if fmt in ("zarr", "netcdf"):
        labels = [c for c in ("metric", "region", *DIMS, "quantile", "bin") if c in df.columns]
        path += ".zarr" if fmt == "zarr" else ".nc"
        (write_zarr if fmt == "zarr" else write_netcdf)(df, path, labels)
        return path
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"format {fmt!r}")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        getattr(writer, fmt)(path)
    return path


def read_stations(spark: SparkSession, path: str, months: Sequence[int] | None = None) -> DataFrame:
    """Station reports partitioned by month, day and hour; the months wanted prune partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("month").isin(list(months))) if months else df
