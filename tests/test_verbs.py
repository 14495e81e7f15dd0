"""Verbs from files to files, and the driver contract."""

import json
import struct
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from skillcube.operators import select
from skillcube.plans import verbs
from skillcube.sources import zarr
from skillcube.sources.io import read_cube


@pytest.fixture
def cube(spark, tmp_path):
    t = datetime(2019, 1, 1)
    rows = [(t + timedelta(days=d), level, lat, lon, float(d + lat / 60), float(level + lon)) for d in range(30) for level in (500, 850) for lat in (-60.0, 0.0, 60.0) for lon in (0.0, 90.0, 180.0, 270.0)]
    spark.createDataFrame(rows, "time timestamp_ntz, level int, latitude double, longitude double, u_component_of_wind double, v_component_of_wind double").write.parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


def test_every_verb(spark, cube, tmp_path):
    run = lambda verb, **o: verbs.run(spark, verb, cube, f"{tmp_path}/{verb}", **o)
    assert run("slice", keep="u_component_of_wind", sel="level_list=500", isel="time_start=0,time_stop=10,time_step=5").count() == 2 * 12
    assert run("averages", over="time,latitude").count() == 8
    assert run("quantiles", over="time", q="0.5", suffix="_q").where("latitude = 0").first().u_component_of_wind_q == 14.5
    assert run("moments").count() == 2
    assert run("resample", period_hours=72, mean="ALL").count() == 10 * 24
    assert run("weekly").where("u_component_of_wind is not null").count() == 24 * 24
    assert run("regrid", latitudes=3, longitudes=4, poles=True, method="nearest").count() == 30 * 24
    clim = run("climatology", first_year=2019, last_year=2019, statistics="mean,std", window=3)
    assert clim.count() == 30 * 24 and {"u_component_of_wind", "u_component_of_wind_std"} <= set(clim.columns)
    assert run("derive", names="wind_speed,eddy_kinetic_energy").where("wind_speed is null").count() == 0
    assert run("spectrum").count() == 2 * 3 * 3
    sample = run("sample", start="2020-01-10", stop="2020-01-11", lead_hours=24, first_year=2019, last_year=2019, window=3, members=2, replace=True)
    assert sample.count() == 2 * 2 * 2 * 24
    out = verbs.run(spark, "expand", f"{tmp_path}/climatology", start="2020-01-01", stop="2020-01-03")
    assert out.count() == 3 * 24
    with pytest.raises(TypeError):
        run("averages", wrong=1)


def test_valid_time_verb(spark, tmp_path):
    t = datetime(2000, 1, 1)
    spark.createDataFrame([(t + timedelta(hours=12 * i), 6 * k, float(k)) for i in range(2) for k in range(3)], "init_time timestamp_ntz, lead_hours long, x double").write.parquet(f"{tmp_path}/f")
    assert verbs.run(spark, "valid-time", f"{tmp_path}/f").count() == 3 * 2
    assert verbs.run(spark, "valid-time", f"{tmp_path}/f", mode="valid_and_init").count() == 6


def test_contract(spark, sf):
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and "mae_by_region" in names
    assert __spark_entry__.entry(spark).count() > 0


RAIN, DAY = "total_precipitation", "total_precipitation_24hr"


def hourly(spark, days=3):
    """Hours of three days at one place: t is the hour's number, a value is missing, rain is 1 in the hour that ends at midnight."""
    t = datetime(2020, 1, 1)
    rows = [(t + timedelta(hours=h), 0.0, float(h) if h != 30 else None, 1.0 if h % 24 == 0 else 0.25) for h in range(24 * days)]
    return spark.createDataFrame(rows, f"time timestamp_ntz, latitude double, t double, {RAIN} double")


def test_resample_daily(spark, tmp_path):
    hourly(spark).write.parquet(f"{tmp_path}/in")
    run = lambda **o: verbs.run(spark, "resample-daily", f"{tmp_path}/in", **o).orderBy("time")
    out = run(statistics="mean,min,max", add_statistic_suffix=True)
    assert set(out.columns) == {"time", "latitude", "t", "t_min", "t_max", DAY}
    rows = out.collect()
    assert [r.time.day for r in rows] == [1, 2, 3] and [r.t_min for r in rows] == [0, 24, 48] and [r.t_max for r in rows] == [23, 47, 71]
    assert rows[1].t == pytest.approx((sum(range(24, 48)) - 30) / 23)
    # an amount is of the hour before its label: midnight's belongs to the day that ends, and the first one to no day here
    assert [r[DAY] for r in rows] == [pytest.approx(23 * 0.25 + 1)] * 2 + [pytest.approx(23 * 0.25)]
    assert run(start_year="2021").count() == 0 and run(period="2d").count() == 2
    for wrong in ({"statistics": "mean,max"}, {"statistics": "sum"}, {"period": "1w"}, {"method": "roll"}, {"period": "1w", "method": "roll"}):
        with pytest.raises(ValueError):
            run(**wrong)


def test_rolled_weeks(spark, cube, tmp_path):
    out = verbs.run(spark, "resample-daily", cube, period="1w", method="roll", statistics="max,min", add_statistic_suffix=True)
    first = out.where("latitude = 0 AND level = 500 AND longitude = 0 AND u_component_of_wind_max IS NOT NULL").orderBy("time").first()
    assert first.time == datetime(2019, 1, 1) and (first.u_component_of_wind_min, first.u_component_of_wind_max) == (0.0, 6.0)


def test_static_variables_go_by_dimension(spark, tmp_path):
    """Through a store, where the file says so, and through Parquet, where the column does."""
    times = zarr_cube = hourly(spark).withColumn("orography", F.col("latitude") + 1)
    zarr.write_zarr(times.drop("orography"), f"{tmp_path}/a.zarr", ["time", "latitude"])
    about = json.loads(Path(tmp_path, "a.zarr/.zmetadata").read_text())
    about["metadata"]["orography/.zarray"] = about["metadata"]["t/.zarray"] | {"shape": [1], "chunks": [1], "compressor": None}
    about["metadata"]["orography/.zattrs"] = {"_ARRAY_DIMENSIONS": ["latitude"]}
    Path(tmp_path, "a.zarr/orography").mkdir()
    Path(tmp_path, "a.zarr/orography/0").write_bytes(struct.pack("<d", 1.0))
    Path(tmp_path, "a.zarr/.zmetadata").write_text(json.dumps(about))
    select.described(zarr_cube, {"orography": ["latitude"]}).write.parquet(f"{tmp_path}/p")
    for path in (f"{tmp_path}/a.zarr", f"{tmp_path}/p"):
        cube = read_cube(spark, path)
        assert cube.agg(F.sum("orography")).first()[0] == 72 and not select.varies_along(cube, "orography", "time") and select.varies_along(cube, "t", "time")
        out = verbs.run(spark, "resample-daily", path)
        assert set(out.columns) == {"time", "latitude", "t", DAY} and out.count() == 3


def test_rechunk_verb_and_chunk_flags(spark, tmp_path):
    assert verbs.parse_chunks("time=31,level=1,latitude=-1") == {"time": 31, "level": 1} and verbs.parse_chunks("") == {}
    for wrong in ("time", "time=0", "time=-2", "time=x", "time=1,time=2", "=3"):
        with pytest.raises(ValueError):
            verbs.parse_chunks(wrong)
    hourly(spark).write.parquet(f"{tmp_path}/in")
    verbs.run(spark, "resample", f"{tmp_path}/in", f"{tmp_path}/out.zarr", "time=1", period_hours=24, mean="t")
    assert zarr.Cube(f"{tmp_path}/out.zarr").arrays["t"].chunks == (1, 1)
    verbs.main(["rechunk", "--input", f"{tmp_path}/out.zarr", "--output", f"{tmp_path}/new.zarr", "--chunks", "time=2"])
    assert zarr.Cube(f"{tmp_path}/new.zarr").arrays["t"].chunks == (2, 1)
    assert sorted(map(str, read_cube(spark, f"{tmp_path}/new.zarr").collect())) == sorted(map(str, read_cube(spark, f"{tmp_path}/out.zarr").collect()))
