"""Selections, derived variables, windows, climatologies, regridding, sampling, evaluation, streams."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillcube.operators import align, climatology, derived, reduce, regrid, sampler, select, windows
from skillcube.operators.regions import named
from skillcube.plans import evaluate as ev
from skillcube.sources import io, mock
from skillcube.streaming import verification


def days(spark, values, start="2020-01-01"):
    t = datetime.fromisoformat(start)
    return spark.createDataFrame([(t + timedelta(days=i), 0.0, v) for i, v in enumerate(values)], "time timestamp_ntz, latitude double, x double")


def test_selections(spark):
    df = days(spark, [float(i) for i in range(10)])
    got = lambda d: [r.x for r in d.orderBy("time").collect()]
    assert got(select.label_range(df, "time", "2020-01-03", "2020-01-05")) == [2, 3, 4]
    assert got(select.positions(df, "time", -3)) == [7, 8, 9] and got(select.positions(df, "time", 1, 8, 3)) == [1, 4, 7]
    assert got(select.thin(df, "time", 4)) == [0, 4, 8] and got(select.drop_positions(df, "time", [0, 9])) == [1, 2, 3, 4, 5, 6, 7, 8]
    with pytest.raises(select.MissingLabel):
        select.labels(df, "latitude", [0.0, 1.0])
    with pytest.raises(ValueError):
        select.parse_flags("level_list=1++2")
    assert select.parse_flags("level_list=500+850,time_start=2020") == {"level": {"list": [500, 850]}, "time": {"start": 2020}}
    assert select.nearest_label(df, "x", 3.004, 0.01).count() == 1
    with pytest.raises(select.MissingLabel):
        select.nearest_label(df, "x", 3.5, 0.01)
    assert select.uniform_step(df, "time") == timedelta(days=1)
    assert select.snap(df, "latitude", [0.0005]).first().latitude == 0.0005
    with pytest.raises(ValueError):
        select.snap(df, "latitude", [0.5])
    with pytest.raises(ValueError):
        select.check_not_empty(df.where("false"))
    with pytest.raises(ValueError):
        select.variables(df, ["time"], ["x"], ["x"])
    assert select.check_increasing([3, 2, 1]) == [1, 2, 3]


def test_decode_levels(spark):
    df = spark.createDataFrame([(0.0, 1.0, 2.0, 9.0)], "latitude double, z_500 double, z_850 double, t2m double")
    assert sorted((r.level, r.z, r.t2m) for r in select.decode_levels(df, ["latitude"]).collect()) == [(500, 1.0, 9.0), (850, 2.0, 9.0)]


def test_rolling_equals_resample_at_common_labels(spark):
    df = days(spark, [None, *map(float, range(1, 10))])
    rolled = {r.time: r.x for r in windows.rolling_labelled(df, "x", ["latitude"], 72, 24).collect()}
    boxed = {r.time: r.x for r in windows.resample(df, {"x": "mean"}, ["latitude"], 72, skipna=False).collect()}
    assert len(boxed) == 4 and all(rolled[t] == v for t, v in boxed.items() if t in rolled and t < datetime(2020, 1, 8))
    assert boxed[datetime(2020, 1, 1)] is None and boxed[datetime(2020, 1, 4)] == 4.0
    right = [r.time for r in windows.resample(df, {"x": "mean"}, ["latitude"], 72, "right").orderBy("time").collect()]
    assert right[0] == datetime(2020, 1, 4)


def test_resample_fills_gaps(spark):
    df = days(spark, [1.0, 2.0, 3.0]).where("x <> 2")
    assert [r.x for r in windows.resample(df, {"x": "sum"}, ["latitude"], 24).orderBy("time").collect()] == [1.0, None, 3.0]


def test_daily_precipitation(spark):
    t = datetime(2020, 1, 1)
    df = spark.createDataFrame([(t + timedelta(hours=h), 1.0) for h in range(1, 49)], "time timestamp_ntz, total_precipitation double")
    assert [r.total_precipitation_24hr for r in windows.daily_precipitation(df, []).orderBy("time").collect()] == [24.0, 24.0]


def test_valid_time_index(spark):
    t = datetime(2000, 1, 1)
    rows = [(t + timedelta(hours=12 * i), 6 * k, float(5 * i + k + 1)) for i in range(4) for k in range(5)]
    df = spark.createDataFrame(rows, "init_time timestamp_ntz, lead_hours long, foo double")
    out = align.index_on_valid_time(df, ["init_time", "lead_hours"], 12, ["foo"])
    table = {(r.time, r.lead_hours): r.foo for r in out.collect()}
    want = [[1, None, None], [6, 3, None], [11, 8, 5], [16, 13, 10], [None, 18, 15], [None, None, 20]]
    assert [[table[t + timedelta(hours=12 * i), h] for h in (0, 12, 24)] for i in range(6)] == want


def test_strict_truth(spark):
    t = datetime(2020, 1, 1)
    f = spark.createDataFrame([(t, t + timedelta(days=1), 0.0, 1.0)], "init_time timestamp_ntz, valid_time timestamp_ntz, latitude double, x double")
    with pytest.raises(select.MissingLabel):
        align.with_truth(f, days(spark, [1.0]), ["latitude"], strict=True)
    assert align.with_truth(f, days(spark, [1.0, 4.0]), ["latitude"], strict=True).first().x_t == 4.0


def test_relative_humidity(spark):
    df = spark.createDataFrame([(240.0, 0.00033, 500)], "temperature double, specific_humidity double, level int")
    svp = 6.112 * math.exp(17.67 * (240 - 273.15) / (240 - 29.65))
    assert df.select(derived.relative_humidity()).first()[0] == pytest.approx((0.00033 / (1 - 0.00033)) / (0.622 * svp / (500 - svp)))


def test_gradient_is_numpy(spark):
    x, f = [0.0, 1.0, 3.0, 4.0, 7.0], [1.0, 4.0, 2.0, 8.0, 3.0]
    from pyspark.sql import Window

    from skillcube.functions.numeric import gradient

    df = spark.createDataFrame(list(zip(x, f, strict=True)), "x double, f double")
    got = [r.g for r in df.select("x", gradient(F.col("f"), F.col("x"), Window.orderBy("x")).alias("g")).orderBy("x").collect()]
    assert got == pytest.approx(np.gradient(np.array(f), np.array(x)).tolist())


def test_spectrum_is_fft(spark):
    x = np.random.default_rng(0).normal(size=16)
    df = spark.createDataFrame([(45.0, i * 22.5, float(v)) for i, v in enumerate(x)], "latitude double, longitude double, x double")
    got = [r.energy for r in derived.zonal_energy_spectrum(df, "x", ["latitude"], 16).orderBy("wavenumber").collect()]
    power = np.abs(np.fft.rfft(x, norm="forward")) ** 2 * np.where(np.arange(9) == 0, 1, 2)
    assert got == pytest.approx((power * math.cos(math.radians(45)) * 2 * math.pi * derived.EARTH_RADIUS).tolist())


def test_precipitation_rules(spark):
    df = spark.createDataFrame([(h, v) for h, v in zip((0, 6, 12, 18), (0.0, 2.0, 1.0, 5.0), strict=True)], "lead_hours long, tp double")
    out = derived.precipitation_accumulation(df, "tp", ["lead_hours"], 6).orderBy("lead_hours").collect()
    assert [r.tp_6hr for r in out] == [None, 2.0, 0.0, 4.0]
    with pytest.raises(ValueError):
        derived.precipitation_accumulation(df, "tp", ["lead_hours"], 9)
    with pytest.raises(KeyError):
        derived.REGISTRY["wind_speed"](df, ["lead_hours"])
    assert derived.base_variables(["wind_speed", "tp"]) == [derived.U, derived.V, "tp"] and len(derived.REGISTRY) == 22


def test_registry_computes_every_name(spark):
    names = {n for d in derived.REGISTRY.values() for n in d.needs if n != "level"}
    rows = [(24 * k // 4, level, lat, lon, *(float(i + level / 100 + lat + lon / 10 + k) / 400 for i in range(len(names)))) for k in range(5) for level in (300, 500, 850) for lat in (-45.0, -15.0, 15.0) for lon in (0.0, 120.0, 240.0)]
    df = spark.createDataFrame(rows, f"lead_hours long, level int, latitude double, longitude double, {', '.join(f'`{n}` double' for n in sorted(names))}")
    for name, d in derived.REGISTRY.items():
        out = d(df.drop(name), ["lead_hours", "level", "latitude", "longitude"])
        assert name in out.columns and out.where(F.col(name).isNotNull()).count() > 0, name


def test_fast_climatology_equals_explicit_without_leap_years(spark):
    df = days(spark, [float(i + 1) for i in range(365)], "2022-01-01")
    a = {r.dayofyear: r.x for r in climatology.explicit(df, "x", ["latitude"], ["mean"], 61).collect() if 40 <= r.dayofyear <= 320}
    b = {r.dayofyear: r.x for r in climatology.fast(df, "x", ["latitude"], "mean", 61).collect()}
    assert len(a) == 281 and all(b[d] == pytest.approx(v) for d, v in a.items())


def test_weighted_quantiles_with_equal_weights(spark):
    values = [3.0, 1.0, 4.0, 1.5, 9.0]
    df = spark.createDataFrame([(0, v, 2.0) for v in values] + [(0, None, 1.0), (0, 99.0, 0.0)], "k int, x double, w double")
    got = {r.quantile: r.x for r in climatology.weighted_quantiles(df, "x", "w", ["k"], [0.0, 0.3, 0.5, 1.0]).collect()}
    assert all(v == pytest.approx(np.quantile(values, q)) for q, v in got.items())


def test_seeps_climatology(spark):
    df = days(spark, [i / 1000 for i in range(5)] * 73, "2022-01-01")
    out = climatology.seeps(df, "x", ["latitude"], window=1).collect()
    assert len(out) == 366 and {r.x_seeps_dry_fraction for r in out} == {0.0, 1.0}


def field(spark, source, f):
    return spark.createDataFrame([(float(a), float(b), float(f(a, b))) for a in source.latitudes for b in source.longitudes], "latitude double, longitude double, x double")


def test_conservative_keeps_the_mean(spark):
    source, target = regrid.Grid.regular(19, 36), regrid.Grid.regular(7, 12)
    out = regrid.conservative(field(spark, source, lambda a, b: math.sin(math.radians(a)) + math.cos(math.radians(b))), ["x"], [], source, target)

    def mean(df, grid):
        edges = np.sin(np.radians(regrid.bounds(grid.latitudes, True)))
        w = dict(zip(grid.latitudes, np.diff(edges), strict=True))
        rows = df.collect()
        return sum(w[r.latitude] * r.x for r in rows) / sum(w[r.latitude] for r in rows)

    assert mean(out, target) == pytest.approx(mean(field(spark, source, lambda a, b: math.sin(math.radians(a)) + math.cos(math.radians(b))), source), abs=1e-9)
    gap = field(spark, source, lambda a, b: 1.0).withColumn("x", F.when(F.col("longitude") != 0, F.col("x")))
    assert all(r.x == pytest.approx(1.0) for r in regrid.conservative(gap, ["x"], [], source, target).collect())
    with pytest.raises(ValueError):
        regrid.conservative_longitudes(source, regrid.Grid((0.0,), (0.0, 180.0)))


def test_bilinear_and_nearest(spark):
    source = regrid.Grid((-60.0, 0.0, 60.0), (0.0, 90.0, 180.0, 270.0), True, True)
    df = field(spark, source, lambda a, b: a)
    target = regrid.Grid((-90.0, -30.0, 30.0), (315.0,), True, True)
    assert [r.x for r in regrid.bilinear(df, ["x"], [], source, target).orderBy("latitude").collect()] == pytest.approx([-60, -30, 30])
    open_ = regrid.Grid(source.latitudes, source.longitudes, True, False)
    assert [r.x for r in regrid.bilinear(df, ["x"], [], open_, target).orderBy("latitude").collect()] == [None, pytest.approx(-30), pytest.approx(30)]
    near = regrid.nearest(field(spark, source, lambda a, b: b), ["x"], [], source, regrid.Grid((1.0,), (100.0, 359.0)))
    assert [r.x for r in near.orderBy("longitude").collect()] == [90.0, 0.0]
    assert regrid.Grid.regular(5, 8).covers_globe() and not regrid.Grid((0.0, 10.0), (0.0, 10.0)).covers_globe()


def test_sampler(spark):
    s = sampler.Sampler(2000, 2004, window=15, members=20, seed=1)
    times = [datetime(2010, 1, 3, 6), datetime(2010, 12, 30, 6)]
    got = s.source_times(times)
    assert all(2000 <= x.year <= 2004 and x.hour == 6 for xs in got for x in xs)
    assert sampler.Sampler(2000, 2001, window=15, members=2).offsets().tolist() == list(range(-7, 8))
    assert sampler.Sampler(2000, 2001, window=4, members=2).offsets().tolist() == [-2, -1, 0, 1]
    every = sampler.Sampler(2000, 2001, window=3, members=-1, replace=False)
    assert len(every.source_times(times)[0]) == 6 and len(set(every.source_times(times)[0])) == 6
    out = sampler.Sampler(2000, 2004, window=1, members=30, leave_out_years=1, seed=2).source_times([datetime(2002, 6, 1)])
    assert {x.year for x in out[0]} <= {2000, 2001, 2004}
    with pytest.raises(ValueError):
        sampler.Sampler(2000, 2001, window=0)
    held = sampler.Sampler(2000, 2000, window=9, members=3, hold_days=2, seed=4).source_times([datetime(2010, 6, d) for d in (10, 11, 12, 13)])
    assert [(b - a).days for a, b in zip(held[0], held[1], strict=True)] == [1, 1, 1]
    obs = days(spark, [1.0, 2.0], "2000-06-01")
    with pytest.raises(select.MissingLabel):
        sampler.sampled_forecast(obs, sampler.Sampler(1990, 1990, window=1, members=1), [datetime(2010, 6, 1)], [0]).collect()


def test_mock_cubes(spark):
    f = mock.forecast(spark, lead_stop=48, members=2, degrees=30.0, start="2020-01-01", stop="2020-01-03", levels=(500, 850))
    assert f["3d"].count() == 2 * 7 * 12 * 2 * 3 * 2 and f["2d"].count() == 2 * 7 * 12 * 3 * 2
    c = mock.hourly_climatology(spark, 12, degrees=90.0)
    assert c["2d"].count() == 3 * 4 * 2 * 366
    gaps = mock.insert_gaps(mock.random_like(f["2d"], ["2m_temperature"], 3), ["2m_temperature"], 0.5, 1)
    assert 0 < gaps.where("`2m_temperature` is null").count() < gaps.count()


def test_quantiles_and_moments(spark):
    df = spark.createDataFrame([(0, float(i), float(i)) for i in range(5)] + [(1, 0.0, None), (1, 1.0, 2.0)], "k int, latitude double, x double")
    q = {(r.k, r.quantile): r.x for r in reduce.quantiles(df, ["x"], ["latitude"], ["k", "latitude"], [0.25, 0.5]).collect()}
    assert q == {(0, 0.25): 1.0, (0, 0.5): 2.0, (1, 0.25): None, (1, 0.5): None}
    with pytest.raises(ValueError):
        reduce.quantiles(df, ["x"], ["latitude"], ["k"], [1.5])


def test_evaluate_from_files(spark, tmp_path):
    t = datetime(2020, 1, 1)
    cells = [(a, b) for a in (-60.0, 0.0, 60.0) for b in (0.0, 120.0, 240.0)]
    truth = [(t + timedelta(days=d), a, b, float(d + a / 60)) for d in range(8) for a, b in cells]
    fc = [(t + timedelta(days=d), 24 * k, a, b, float(d + k + a / 60 + k)) for d in range(4) for k in range(3) for a, b in cells]
    clim = [(d, a, b, 0.0) for d in range(1, 20) for a, b in cells]
    for name, rows, schema in (("truth", truth, "time timestamp_ntz, latitude double, longitude double, z double"), ("fc", fc, "time timestamp_ntz, lead_hours long, latitude double, longitude double, z double"), ("clim", clim, "dayofyear int, latitude double, longitude double, z double")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    data = ev.Data(ev.Selection(("z",)), f"{tmp_path}/fc", f"{tmp_path}/truth", f"{tmp_path}/clim")
    configs = {"det": ev.Eval(("mse", "bias", "acc"), tuple(named("global", "tropics"))), "pers": ev.Eval(("bias",), None, use_persistence=True), "clim": ev.Eval(("bias",), None, use_climatology=True), "spatial": ev.Eval(("spatial_bias",))}
    out = ev.evaluate(spark, data, configs, f"{tmp_path}/out")
    det = {(r.metric, r.region, r.lead_hours): r.z for r in out["det"].collect()}
    assert det["mse", "global", 48] == pytest.approx(4.0) and det["bias", "tropics", 24] == pytest.approx(1.0) and det["acc", "global", 0] == pytest.approx(1.0)
    assert {r.lead_hours: r.z for r in out["pers"].collect()} == pytest.approx({0: 0.0, 24: -1.0, 48: -2.0})
    assert out["spatial"].count() == 27 and spark.read.parquet(f"{tmp_path}/out/det").count() == out["det"].count()
    assert len(ev.named_configs()) == 12
    rmse = ev.with_rmse(out["det"], ["z"]).where("metric = 'rmse' and region = 'global' and lead_hours = 48").first()
    assert rmse.z == pytest.approx(2.0)
    with pytest.raises(ValueError):
        io.write_result(out["det"], str(tmp_path), "x", fmt="grib")  # zarr, which this refused before, is a format now


def test_ensemble_configs(spark):
    rows = [(0, 24, a, 0.0, m, float(m), 1.0) for a in (-45.0, 45.0) for m in range(3)]
    df = spark.createDataFrame(rows, "init_time int, lead_hours long, latitude double, longitude double, member int, x double, x_t double")
    out = ev.evaluate_frame(df, ev.Eval(("crps", "energy_score", "ensemble_mean_mse", "ensemble_stddev", "spatial_crps"), tuple(named("global"))), ["x"])
    got = {r.metric: r.x for r in out.where("region = 'global'").collect()}
    assert got["crps"] == pytest.approx(2 / 3 - (4 / 3) / 2) and got["ensemble_mean_mse"] == 0 and got["energy_spread"] == 1 and got["ensemble_stddev_sqrt_before_time_avg"] == 1


def test_stream_verification(spark, tmp_path):
    t = datetime(2020, 1, 1)
    spark.createDataFrame([(t + timedelta(hours=h), 0.0, 1.0 + h) for h in range(4)], "valid_time timestamp, latitude double, x double").write.parquet(f"{tmp_path}/f")
    spark.createDataFrame([(t + timedelta(hours=h), 0.0, 1.0) for h in range(4)], "time timestamp, latitude double, x double").write.parquet(f"{tmp_path}/o")
    f = spark.readStream.schema("valid_time timestamp, latitude double, x double").parquet(f"{tmp_path}/f")
    o = spark.readStream.schema("time timestamp, latitude double, x double").parquet(f"{tmp_path}/o")
    q = verification.paired(f, o, ["latitude"]).writeStream.format("memory").queryName("pairs_out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.x - r.x_o for r in spark.table("pairs_out").collect()) == [0.0, 1.0, 2.0, 3.0]
    static = verification.rolling_scores(verification.paired(spark.read.parquet(f"{tmp_path}/f"), spark.read.parquet(f"{tmp_path}/o"), ["latitude"]), "x", ["latitude"]).first()
    assert static.mse == pytest.approx(3.5) and static.n == 4


def _ring_frame(spark, seed=0):
    """Three years (one of them leap) of two cells, four times a day, with gaps and missing values."""
    r = random.Random(seed)
    rows = []
    for k in range(1096):
        for lat in (0.0, 30.0):
            for hour in (0, 6, 12, 18):
                if r.random() < 0.85:
                    rows.append((datetime(2019, 1, 1) + timedelta(days=k, hours=hour), lat, None if r.random() < 0.05 else max(0.0, round(r.gauss(0.0003, 0.001), 6))))
    return spark.createDataFrame(rows, "time timestamp_ntz, latitude double, x double")


@pytest.mark.parametrize("hourly", [False, True])
def test_climatologies_by_line_equal_those_by_rows(spark, hourly):
    """No row is multiplied before the shuffle; the results are those of a row for each day and window."""
    df, keys = _ring_frame(spark), ["dayofyear", *(["hour"] if hourly else []), "latitude"]
    spread = climatology._spread(climatology.by_year_and_day(df, "x", ["latitude"], hourly), 61)
    rows = lambda d: {tuple(r[k] for k in (*keys, *(["quantile"] if "quantile" in d.columns else []))): tuple(r[c] for c in sorted(d.columns) if c[0] == "x") for r in d.collect()}
    want = rows(climatology.weighted_quantiles(spread, "x", "ww", keys, [0.1, 0.5, 0.99]).withColumnRenamed("x", "x_quantile"))
    got = rows(climatology.quantile(df, "x", ["latitude"], [0.1, 0.5, 0.99], hourly=hourly))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    mean = F.sum(F.col("x") * F.col("ww")) / F.sum(F.when(F.col("x").isNotNull(), F.col("ww")))
    want = rows(spread.groupBy(*keys).agg(mean.alias("x")))
    got = rows(climatology.explicit(df, "x", ["latitude"], ("mean",), hourly=hourly))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    dry = climatology.seeps(df, "x", ["latitude"], hourly=hourly)
    wet = rows(climatology.weighted_quantiles(spread.where("x >= 0.00025"), "x", "ww", keys, [2 / 3]).drop("quantile"))
    got = rows(dry)
    assert len(got) == 366 * 2 * (4 if hourly else 1) and all(got[k][1] == pytest.approx(wet[k][0], abs=1e-12) for k in wet)
    assert all(0 <= v[0] <= 1 for v in got.values())


def test_climatology_plans_do_not_multiply_rows(spark):
    for df in (climatology.quantile(_ring_frame(spark), "x", ["latitude"], [0.5]), climatology.seeps(_ring_frame(spark), "x", ["latitude"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Window" not in plan and plan.count("Exchange ") == 2


def test_a_window_beyond_the_ring_raises(spark):
    with pytest.raises(ValueError):
        climatology.quantile(_ring_frame(spark), "x", ["latitude"], [0.5], window=367)


@pytest.mark.parametrize(("by", "grid", "remainder", "skipna"), [(["level"], 40, 100, True), ([], 1000, 1000, False)])
def test_selected_quantiles_are_exact(spark, by, grid, remainder, skipna):
    """Heavy ties at both ends and inside, all values alike, few values, none, and missing labels; every round has to draw brackets in."""
    r = random.Random(9)
    rows = [(1, r.choice([0.0, 0.0, 0.0, 5.0, r.expovariate(1e-3), -r.random()])) for _ in range(3000)] + [(2, 7.0)] * 500 + [(3, float(k % 4)) for k in range(400)] + [(4, 1.0), (4, None), (5, None)]
    rows += [(None, math.exp(r.gauss(0, 40))) for _ in range(2000)] + [(6, float(k)) for k in range(2)]
    df = spark.createDataFrame(rows if by else [r for r in rows if r[1] is not None], "level int, x double").repartition(4)
    q = [0.0, 0.001, 0.25, 0.5002, 0.9, 0.999, 1.0]
    want = {(r.quantile, *(r[b] for b in by)): r.x_q for r in reduce.quantiles(df, ["x"], [] if by else ["level"], ["level"], q, skipna, "_q").collect()}
    out = reduce.selected_quantiles(df, ["x"], by, q, skipna, "_q", remainder, grid, 16 * grid)
    got = {(r.quantile, *(r[b] for b in by)): r.x_q for r in out.collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None and v is None) or got[k] == pytest.approx(v, rel=1e-12, abs=0) for k, v in want.items())


def test_long_keys_are_selected(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") % 2).cast("int").alias("level"), F.sin("id").alias("x"))
    whole = sorted(map(tuple, reduce.quantiles(df, ["x"], [], ["level"], [0.1, 0.5]).collect()))
    asked = []
    monkeypatch.setattr(reduce, "selected_quantiles", lambda *a, was=reduce.selected_quantiles: (asked.append(1), was(*a))[1])
    assert sorted(map(tuple, reduce.quantiles(df, ["x"], [], ["level"], [0.1, 0.5], gathered=1000).collect())) == whole and asked


def _drawn(spark, s, n=40, hours=24, start=datetime(1998, 12, 20)):
    times = spark.createDataFrame([(start + timedelta(hours=hours * k),) for k in range(n)], "time timestamp_ntz")
    return {(r.time, r.member): r.source_time for r in sampler.drawn(times, s).collect()}


def test_draws_in_spark_keep_the_window_and_the_years(spark):
    """Window, years and edges are those of the sampler on the driver; all of the window and all years occur."""
    got = _drawn(spark, sampler.Sampler(1995, 2000, window=9, members=30, leave_out_years=1, edge=sampler.NO_EDGE), hours=30)
    seen = set()
    for (t, _), source in got.items():
        offsets = [(source - datetime(y, 1, 1, t.hour)).days + 1 - t.timetuple().tm_yday for y in range(1995, 2001)]
        year = next(y for y, o in zip(range(1995, 2001), offsets, strict=True) if abs(o) <= 4)
        assert source.hour == t.hour and not t.year <= year <= t.year + 1
        seen.add((year, next(o for o in offsets if abs(o) <= 4)))
    assert {o for _, o in seen} == set(range(-4, 5)) and {y for y, _ in seen} >= {1995, 1996, 1997, 1998}
    assert got == _drawn(spark, sampler.Sampler(1995, 2000, window=9, members=30, leave_out_years=1, edge=sampler.NO_EDGE), hours=30)
    assert got != _drawn(spark, sampler.Sampler(1995, 2000, window=9, members=30, leave_out_years=1, edge=sampler.NO_EDGE, seed=1), hours=30)


@pytest.mark.parametrize("edge", [sampler.WRAP_YEAR, sampler.REFLECT_RANGE, sampler.NO_EDGE])
def test_draws_without_replacement_are_combinations(spark, edge):
    """All combinations are those that the sampler on the driver has, in its order; some of them are different ones."""
    every = sampler.Sampler(1997, 1999, window=5, replace=False, edge=edge)
    times = [datetime(1998, 12, 20) + timedelta(days=k) for k in range(20)]
    want = {(t, m): s for t, ss in zip(times, every.source_times(times), strict=True) for m, s in enumerate(ss)}
    assert _drawn(spark, every, 20) == want
    some = _drawn(spark, sampler.Sampler(1997, 1999, window=5, members=8, replace=False, edge=edge), 20)
    by_time = {}
    for (t, m), s in some.items():
        by_time.setdefault(t, {})[m] = s
    for t, picks in by_time.items():
        pool = [want[t, m] for m in range(15)]
        assert set(picks) == set(range(8)) and all(list(picks.values()).count(x) <= pool.count(x) for x in picks.values())
    assert len({tuple(p.values()) for p in by_time.values()}) > 10


def test_draws_that_are_held_and_that_fail(spark):
    got = _drawn(spark, sampler.Sampler(1990, 1990, window=31, members=3, hold_days=5, edge=sampler.NO_EDGE), 15, start=datetime(1991, 3, 1))
    for m in range(3):
        offsets = [got[t, m].timetuple().tm_yday - t.timetuple().tm_yday for t, k in sorted(got) if k == m]
        assert [len(set(offsets[k : k + 5])) for k in (0, 5, 10)] == [1, 1, 1] and len(set(offsets)) > 1
    for s in (sampler.Sampler(1998, 1998, window=3, members=2, leave_out_years=2), sampler.Sampler(1998, 1998, window=3, members=2, replace=False, leave_out_years=2), sampler.Sampler(1998, 1998, window=3, members=4, replace=False)):
        with pytest.raises(Exception, match="(?i)no years|too few"):
            _drawn(spark, s)
