"""Cubes made of the relational test tables, as frames and as SQL common table expressions of the same meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.operators.reduce import densify

LATITUDES, LONGITUDES = [-60.0, -20.0, 20.0, 60.0], [0.0, 120.0, 240.0]
LEVELS, COLUMN_LATITUDES, COLUMN_LONGITUDES = [1000, 850, 700, 500, 300, 200, 100], [-75.0, -45.0, -15.0, 15.0, 45.0, 75.0], [45.0 * i for i in range(8)]
LEADS = [0, 24, 48]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(values: list, i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def _day(c: str) -> Column:
    return F.to_date(c).cast("timestamp_ntz")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(_day("ts").alias("time"), _pick(LATITUDES, F.col("user_id") % 4).alias("latitude"), _pick(LONGITUDES, F.col("event_id") % 3).alias("longitude"), "event_type", "value")


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """time, latitude, longitude, temperature; dense."""
    raw = _events(spark, sf).groupBy("time", "latitude", "longitude").agg(F.avg("value").alias("temperature"))
    return densify(raw, [["time"]], {"latitude": LATITUDES, "longitude": LONGITUDES})


def ens(spark: SparkSession, sf: str) -> DataFrame:
    """init_time, member, lead_hours, valid_time, latitude, longitude, temperature; dense. Members are event types in order of their names."""
    events = _events(spark, sf)
    names = sorted(r[0] for r in events.select("event_type").distinct().collect())
    member = F.array_position(F.array(*map(F.lit, names)), F.col("event_type")).cast("int") - 1
    raw = events.groupBy(F.col("time").alias("init_time"), member.alias("member"), "latitude", "longitude").agg(F.avg("value").alias("temperature"))
    dense = densify(raw, [["init_time"]], {"member": list(range(len(names))), "latitude": LATITUDES, "longitude": LONGITUDES})
    leads = dense.withColumn("lead_hours", F.explode(F.array(*(F.lit(x).cast("long") for x in LEADS))))
    return leads.withColumn("valid_time", F.col("init_time") + F.expr("make_dt_interval(0, CAST(lead_hours AS INT))"))


def det(spark: SparkSession, sf: str) -> DataFrame:
    """Ensemble mean and spread per cell: temperature, temperature_std."""
    whole = lambda a: F.when(F.count("temperature") == F.count(F.lit(1)), a)
    return ens(spark, sf).groupBy("init_time", "lead_hours", "valid_time", "latitude", "longitude").agg(whole(F.avg("temperature")).alias("temperature"), whole(F.stddev_samp("temperature")).alias("temperature_std"))


def clim(spark: SparkSession, sf: str) -> DataFrame:
    """dayofyear, latitude, longitude, temperature: zonal means of the day."""
    zonal = obs(spark, sf).groupBy(F.dayofyear("time").alias("dayofyear"), "latitude").agg(F.avg("temperature").alias("temperature"))
    return zonal.withColumn("longitude", F.explode(F.array(*map(F.lit, LONGITUDES))))


def column(spark: SparkSession, sf: str) -> DataFrame:
    """level, latitude, longitude, u, v, temperature, specific_humidity, geopotential."""
    t = table(spark, sf, "lineitem")
    level = _pick(LEVELS, F.col("l_linenumber") - 1).alias("level")
    rows = t.groupBy(level, _pick(COLUMN_LATITUDES, F.col("l_suppkey") % 6).alias("latitude"), _pick(COLUMN_LONGITUDES, F.col("l_partkey") % 8).alias("longitude")).agg(
        (F.avg("l_quantity") - 25).alias("u"), (F.avg("l_discount") * 200 - 10).alias("v"), (F.avg("l_quantity") + 250).alias("temperature"), (F.avg("l_tax") / 10).alias("specific_humidity"), F.avg("l_extendedprice").alias("__p"),
    )
    return rows.withColumn("geopotential", (1000 - F.col("level")) * 100 + F.col("__p") / 100).drop("__p")


def series(spark: SparkSession, sf: str) -> DataFrame:
    """time, latitude, precip: a daily series with gaps."""
    t = table(spark, sf, "orders")
    rows = t.groupBy(_day("o_orderdate").alias("time"), _pick([-45.0, 45.0], F.col("o_orderkey") % 2).alias("latitude"))
    return rows.agg((F.greatest(F.avg("o_totalprice") - 200000, F.lit(0.0)) / 1.013e8).alias("precip"))


def wave(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, latitude, longitude, x: a zonal line of 64 values per vector."""
    t = table(spark, sf, "embeddings")
    rows = t.select("vec_id", ((F.col("vec_id") % 3) * 30).cast("double").alias("latitude"), F.posexplode("embedding").alias("i", "x"))
    return rows.select("vec_id", "latitude", (F.col("i") * 5.625).alias("longitude"), F.col("x").cast("double").alias("x"))


def _axis(name: str, column_: str, values: list) -> str:
    kind = "INTEGER" if isinstance(values[0], int) else "DOUBLE"
    return f"{name} AS (SELECT unnest({values})::{kind} AS {column_})"


def _sql_pick(values: list, i: str) -> str:
    return f"({values})[CAST({i} AS INTEGER) + 1]::{'INTEGER' if isinstance(values[0], int) else 'DOUBLE'}"


_WEIGHTS = """{name} AS (SELECT latitude, (sin(hi) - sin(lo)) / avg(sin(hi) - sin(lo)) OVER () AS w FROM (
  SELECT latitude, coalesce(radians(latitude + lag(latitude) OVER (ORDER BY latitude)) / 2, -pi() / 2) AS lo, coalesce(radians(latitude + lead(latitude) OVER (ORDER BY latitude)) / 2, pi() / 2) AS hi FROM {axis}))"""

#: Common table expressions by name, in order of dependence.
CTE: dict[str, str] = {
    "lats": _axis("lats", "latitude", LATITUDES),
    "lons": _axis("lons", "longitude", LONGITUDES),
    "latw": _WEIGHTS.format(name="latw", axis="lats"),
    "ev": f"ev AS (SELECT CAST(ts AS DATE) AS time, {_sql_pick(LATITUDES, 'user_id % 4')} AS latitude, {_sql_pick(LONGITUDES, 'event_id % 3')} AS longitude, dense_rank() OVER (ORDER BY event_type) - 1 AS member, value FROM events)",
    "obs": "obs AS (SELECT time, latitude, longitude, avg(value) AS temperature FROM (SELECT DISTINCT time FROM ev) CROSS JOIN lats CROSS JOIN lons LEFT JOIN ev USING (time, latitude, longitude) GROUP BY ALL)",
    "ens": """ens AS (SELECT init_time, member, lead_hours, init_time + (lead_hours // 24)::INTEGER AS valid_time, latitude, longitude, avg(value) AS temperature
  FROM (SELECT DISTINCT time AS init_time FROM ev) CROSS JOIN (SELECT DISTINCT member FROM ev) CROSS JOIN lats CROSS JOIN lons CROSS JOIN (SELECT unnest([0, 24, 48])::BIGINT AS lead_hours)
  LEFT JOIN (SELECT time AS init_time, latitude, longitude, member, value FROM ev) USING (init_time, latitude, longitude, member) GROUP BY ALL)""",
    "det": """det AS (SELECT init_time, lead_hours, valid_time, latitude, longitude, CASE WHEN count(temperature) = count(*) THEN avg(temperature) END AS temperature,
  CASE WHEN count(temperature) = count(*) THEN stddev_samp(temperature) END AS temperature_std FROM ens GROUP BY ALL)""",
    "clim": "clim AS (SELECT dayofyear, latitude, longitude, temperature FROM (SELECT dayofyear(time) AS dayofyear, latitude, avg(temperature) AS temperature FROM obs GROUP BY ALL) CROSS JOIN lons)",
    "pairs": "pairs AS (SELECT d.*, o.temperature AS temperature_t, c.temperature AS temperature_c FROM det d JOIN obs o ON d.valid_time = o.time AND d.latitude = o.latitude AND d.longitude = o.longitude JOIN clim c ON dayofyear(d.valid_time) = c.dayofyear AND d.latitude = c.latitude AND d.longitude = c.longitude)",
    "epairs": "epairs AS (SELECT e.*, o.temperature AS temperature_t FROM ens e JOIN obs o ON e.valid_time = o.time AND e.latitude = o.latitude AND e.longitude = o.longitude)",
    "ranked": "ranked AS (SELECT *, row_number() OVER (PARTITION BY init_time, lead_hours, latitude, longitude ORDER BY temperature ASC NULLS LAST, member) AS rank FROM epairs)",
    "cells": """cells AS (SELECT init_time, lead_hours, latitude, longitude, any_value(temperature_t) AS truth, count(*) AS n,
  CASE WHEN count(temperature) = count(*) THEN avg(temperature) END AS mean, CASE WHEN count(temperature) = count(*) THEN var_samp(temperature) END AS var,
  CASE WHEN count(abs(temperature_t - temperature)) = count(*) THEN avg(abs(temperature_t - temperature)) END AS crps_skill,
  CASE WHEN count(temperature) = count(*) THEN 2 * avg((2 * rank - 6) * temperature) / 4 END AS crps_spread FROM ranked GROUP BY init_time, lead_hours, latitude, longitude)""",
    "col": f"""col AS (SELECT {_sql_pick(LEVELS, 'l_linenumber - 1')} AS level, {_sql_pick(COLUMN_LATITUDES, 'l_suppkey % 6')} AS latitude, {_sql_pick(COLUMN_LONGITUDES, 'l_partkey % 8')} AS longitude,
  avg(l_quantity) - 25 AS u, avg(l_discount) * 200 - 10 AS v, avg(l_quantity) + 250 AS temperature, avg(l_tax) / 10 AS specific_humidity, (1000 - {_sql_pick(LEVELS, 'l_linenumber - 1')}) * 100 + avg(l_extendedprice) / 100 AS geopotential
  FROM lineitem GROUP BY l_linenumber, l_suppkey % 6, l_partkey % 8)""",
    "clats": _axis("clats", "latitude", COLUMN_LATITUDES),
    "clatw": _WEIGHTS.format(name="clatw", axis="clats"),
    "ser": f"ser AS (SELECT CAST(o_orderdate AS DATE) AS time, {_sql_pick([-45.0, 45.0], 'o_orderkey % 2')} AS latitude, greatest(avg(o_totalprice) - 200000, 0) / 1.013e8 AS precip FROM orders GROUP BY 1, 2)",
    "wav": "wav AS (SELECT vec_id, ((vec_id % 3) * 30)::DOUBLE AS latitude, i - 1 AS j, (i - 1) * 5.625::DOUBLE AS longitude, embedding[i]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))",
}
_NEEDS = {
    "latw": ["lats"], "obs": ["ev", "lats", "lons"], "ens": ["ev", "lats", "lons"], "det": ["ens"], "clim": ["obs", "lons"], "pairs": ["det", "obs", "clim"], "epairs": ["ens", "obs"], "ranked": ["epairs"], "cells": ["ranked"],
    "clatw": ["clats"],
}


def with_ctes(names: list[str], *more: str) -> str:
    """WITH clause that defines the named cubes, what they need, and further expressions."""
    wanted: list[str] = []

    def add(n: str) -> None:
        for d in _NEEDS.get(n, ()):
            add(d)
        if n not in wanted:
            wanted.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join([*(CTE[n] for n in CTE if n in wanted), *more]) + "\n"
