"""The evaluation planner from files: several variables, land, SEEPS, Gaussian spreads, thresholds."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skillcube.operators.select import MissingLabel
from skillcube.operators.regions import Region, named
from skillcube.plans import evaluate as ev
from skillcube.plans.shared import Shared

T = datetime(2020, 1, 1)
CELLS = [(a, b) for a in (-60.0, 0.0, 60.0) for b in (0.0, 120.0, 240.0)]
RAIN = "total_precipitation_24hr"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("cubes")
    space = "latitude double, longitude double"
    truth = [(T + timedelta(days=d), a, b, float(d), 10.0 * d, 0.001 * (d % 3), b / 240) for d in range(20) for a, b in CELLS]
    fc = [(T + timedelta(days=d), 24 * k, a, b, d + k + 1.0, 10.0 * (d + k) + a / 60, 0.002, 1.0, 2.0) for d in range(4) for k in range(2) for a, b in CELLS]
    ens = [(T + timedelta(days=d), 24 * k, m, a, b, d + k + float(m), 10.0 * (d + k) + 3 * m) for d in range(4) for k in range(2) for m in range(3) for a, b in CELLS]
    clim = [(n, q, a, b, n / 2, 5.0 * n, 1.0, 2.0, n + (1.0 if q > 0.5 else -1.0), 10.0 * n, 0.0015, 0.4) for n in range(1, 30) for q in (0.1, 0.9) for a, b in CELLS]
    spark.createDataFrame(truth, f"time timestamp_ntz, {space}, x double, y double, {RAIN} double, land_sea_mask double").write.parquet(f"{root}/truth")
    spark.createDataFrame(fc, f"time timestamp_ntz, lead_hours long, {space}, x double, y double, {RAIN} double, x_std double, y_std double").write.parquet(f"{root}/fc")
    spark.createDataFrame(ens, f"time timestamp_ntz, lead_hours long, member int, {space}, x double, y double").write.parquet(f"{root}/ens")
    spark.createDataFrame(clim, f"dayofyear int, quantile double, {space}, x double, y double, x_std double, y_std double, x_quantile double, y_quantile double, {RAIN}_seeps_threshold double, {RAIN}_seeps_dry_fraction double").write.parquet(f"{root}/clim")
    return lambda forecast, variables=("x", "y"): ev.Data(ev.Selection(variables), f"{root}/{forecast}", f"{root}/truth", f"{root}/clim")


def run(spark, data, config):
    return ev.evaluate(spark, data, {"c": config})["c"]


def test_land_region(spark, data):
    rows = run(spark, data("fc"), ev.Eval(("bias",), tuple(named("global", "global_land"))))
    got = {(r.region, r.lead_hours): (r.x, r.y) for r in rows.collect()}
    assert got["global_land", 24] == pytest.approx((1.0, 0.0)) and got["global", 0] == pytest.approx((1.0, 0.0))


def test_every_variable_has_its_own_thresholds(spark, data):
    config = ev.Eval(("brier", "rps", "spatial_brier", "spatial_rps"), None, thresholds=(0.1, 0.9))
    both = run(spark, data("ens"), config)
    one = {v: run(spark, data("ens", (v,)), config) for v in ("x", "y")}
    for v, df in one.items():
        key = lambda r: (r.metric, r.lead_hours, r.quantile, r.latitude, r.longitude)
        assert {key(r): r[v] for r in both.collect()} == {key(r): r[v] for r in df.collect()}
    assert both.where("metric = 'spatial_brier'").count() == 2 * 2 * 9


def test_gaussian_forecasts(spark, data):
    got = {r.metric: r for r in run(spark, data("fc"), ev.Eval(("gaussian_variance", "gaussian_crps"), None)).where("lead_hours = 0").collect()}
    assert got["gaussian_variance"].x == 1 and got["gaussian_variance"].y == 4 and got["gaussian_crps"].x == pytest.approx(0.602441, abs=1e-5)
    rows = run(spark, data("fc"), ev.Eval(("gaussian_brier", "gaussian_rps"), None, thresholds=(0.1, 0.9), threshold_kind="gaussian_quantile"))
    assert rows.where("metric = 'gaussian_brier'").count() == 4 and rows.where("x is null or y is null").count() == 0
    with pytest.raises(ValueError):
        run(spark, data("fc"), ev.Eval(("gaussian_brier",), None, thresholds=(0.1,), threshold_kind="other"))


def test_seeps(spark, data):
    rows = run(spark, data("fc", ("x",)), ev.Eval(("mse", "seeps_24hr", "spatial_seeps_24hr"), None)).collect()
    whole = {r.lead_hours: r[RAIN] for r in rows if r.metric == "seeps_24hr"}
    # a heavy forecast: truth dry, light (0.001) and heavy in turn, p1 = 0.4
    dry, light = (1 / 0.4 + 3 / 2.4) / 2, 3 / 2.4 / 2
    assert whole[0] == pytest.approx((dry + light + 0 + dry) / 4) and sum(r.metric == "spatial_seeps_24hr" for r in rows) == 18


def test_rank_histogram(spark, data):
    rows = run(spark, data("ens"), ev.Eval(("rank_histogram",), None))
    assert rows.count() == 2 * 9 * 4 and {r.bin: r.x for r in rows.where("lead_hours = 0 and latitude = 0 and longitude = 0").collect()} == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.0}


def test_wind_vectors(spark, data, tmp_path):
    d = data("fc")
    names = {"x": "u_component_of_wind", "y": "v_component_of_wind"}
    for k in ("forecast", "truth"):
        spark.read.parquet(getattr(d, k)).withColumnsRenamed(names).write.parquet(f"{tmp_path}/{k}")
    wind = ev.Data(ev.Selection(tuple(names.values())), f"{tmp_path}/forecast", f"{tmp_path}/truth")
    row = run(spark, wind, ev.Eval(("mse",), None)).where("lead_hours = 0").first()
    assert row.wind_vector == pytest.approx(row.u_component_of_wind + row.v_component_of_wind)


def test_unknown_metrics_raise(spark, data):
    for config, forecast in ((ev.Eval(("mse", "nonsense")), "fc"), (ev.Eval(("crps", "mse")), "ens"), (ev.Eval(("spatial_acc",)), "fc")):
        with pytest.raises(ValueError, match="unknown metrics"):
            run(spark, data(forecast), config)


def test_regions_that_overlap(spark):
    a, b = named("tropics")[0], Region("east", ((-90, 90, 0, 180),))
    both = a.combined(b)
    df = spark.createDataFrame([(0.0, 90.0), (0.0, 200.0), (50.0, 90.0)], "latitude double, longitude double")
    assert [r[0] for r in df.select(both.weight(F.col("latitude"), F.col("longitude"))).collect()] == [1.0, 0.0, 0.0]
    assert a.combined(named("global_land")[0]).masks() == {"land_sea_mask"}


def test_the_truth_is_cut_before_the_join(spark, data):
    frame = ev.prepare(spark, data("fc"), ev.Eval(("mse",)))[0]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(time), GreaterThanOrEqual(time" in plan


def scans(df, path):
    """Scans of a path's variables in a plan, and its exchanges."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(f"{path}]" in line and "x#" in line for line in plan.splitlines() if "FileScan" in line), plan.count("Exchange ")


def test_five_metrics_of_two_variables_scan_once(spark, data):
    for forecast, metrics in (("fc", ("mse", "mae", "bias", "rmse", "acc")), ("ens", ("crps", "crps_spread", "ensemble_mean_mse", "ensemble_variance", "ensemble_mean_rmse"))):
        out = run(spark, data(forecast), ev.Eval(metrics, tuple(named("global", "tropics"))))
        assert scans(out, f"/{forecast}")[0] == 1 and scans(out, "/truth")[0] == 1


def test_energy_scores_and_histograms_share_cells(spark, data):
    """Energy scores, spreads, local scores and rank histograms of two variables: cells are made once, and no plan scans a cube again."""
    shared = Shared(spark)
    config = ev.Eval(("energy_score", "ensemble_mean_rmse", "spatial_crps", "rank_histogram"))
    out = ev.evaluate(spark, data("ens"), {"c": config}, shared=shared)["c"]
    assert shared.users() == [4] and scans(out, "/ens")[0] == scans(out, "/truth")[0] == 0
    assert scans(out, "/ens")[1] <= 12  # of energy scores 3, spreads 2, local scores 1, histograms 1, the result's rows 1, and adaptive copies
    one = {m: run(spark, data("ens"), ev.Eval((m,))) for m in config.metrics}
    key = lambda r: (r.metric, r.lead_hours, r.latitude, r.longitude, r.bin)
    got = {key(r): (r.x, r.y) for r in out.collect()}
    for m, df in one.items():
        have = {(r.metric, r.lead_hours, getattr(r, "latitude", None), getattr(r, "longitude", None), getattr(r, "bin", None)): (r.x, r.y) for r in df.collect()}
        assert have and all(got[k] == pytest.approx(v) for k, v in have.items())
    shared.close()


def test_configurations_share_a_frame(spark, data, tmp_path):
    shared = Shared(spark)
    configs = {"a": ev.Eval(("mse",)), "b": ev.Eval(("mae",), temporal_mean=False), "c": ev.Eval(("acc",))}
    out = ev.evaluate(spark, data("fc"), configs, shared=shared)
    assert shared.users() == [2] and scans(out["a"], "/fc")[0] == 0 and scans(out["c"], "/fc")[0] == 1
    alone = run(spark, data("fc"), configs["b"])
    assert sorted(map(str, alone.collect())) == sorted(map(str, out["b"].collect()))
    shared.close()
    written = ev.evaluate(spark, data("fc"), configs, str(tmp_path))
    assert sorted(map(str, alone.collect())) == sorted(map(str, written["b"].collect()))


def test_shared_frames_count_their_users(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/t")
    one, other = (spark.read.parquet(f"{tmp_path}/t").select((F.col("id") + 1).alias("n")) for _ in range(2))
    different = spark.read.parquet(f"{tmp_path}/t").select((F.col("id") + 2).alias("n"))
    with Shared(spark) as shared:
        for df in (one, other, different):
            shared.want(df)
        assert shared.get(different) is different
        a, b = shared.get(one), shared.get(other.withColumnRenamed("n", "m").withColumnRenamed("m", "n"))
        assert shared.users() == [2] and a.inputFiles() == b.inputFiles() != one.inputFiles() and sorted(r.n for r in b.collect()) == [1, 2, 3, 4, 5]
        shared.release(one)
        assert a.count() == 5
        shared.release(other)
        assert shared.users() == []
    with pytest.raises(Exception, match="(?i)not.*exist"):
        spark.read.parquet(a.inputFiles()[0])


def without(spark, data, tmp_path, what, condition, forecast="fc"):
    """The data without some rows of one of its cubes."""
    d = data(forecast)
    spark.read.parquet(getattr(d, what)).where(condition).write.parquet(f"{tmp_path}/{what}")
    return replace(d, **{what: f"{tmp_path}/{what}"})


@pytest.mark.parametrize(
    ("what", "condition", "config"),
    [
        ("truth", "time <> TIMESTAMP_NTZ'2020-01-03'", ev.Eval(("mse",))),
        ("truth", "time <> TIMESTAMP_NTZ'2020-01-02'", ev.Eval(("mse",), use_persistence=True)),
        ("climatology", "dayofyear <> 2", ev.Eval(("acc",))),
        ("climatology", "dayofyear <> 2", ev.Eval(("mse",), use_climatology=True)),
        ("climatology", "latitude <> 0", ev.Eval(("seeps_24hr",))),
        ("truth", "time > TIMESTAMP_NTZ'2020-01-01' OR longitude = 120", ev.Eval(("mse",), tuple(named("global_land")))),
    ],
)
def test_what_is_missing_raises(spark, data, tmp_path, what, condition, config):
    """A time, a day of the climatology, a cell of the dry fraction or of the mask: nothing is averaged over less without a word."""
    holed = without(spark, data, tmp_path, what, condition)
    with pytest.raises(MissingLabel):
        run(spark, holed, config)
    assert run(spark, replace(holed, on_missing="skip"), config).count() > 0
    with pytest.raises(ValueError, match="on_missing"):
        run(spark, replace(holed, on_missing="other"), config)


def test_a_mask_without_a_value_raises(spark, data, tmp_path):
    d = data("fc")
    spark.read.parquet(d.truth).withColumn("land_sea_mask", F.when(F.col("latitude") != 0, F.col("land_sea_mask"))).write.parquet(f"{tmp_path}/truth")
    with pytest.raises(MissingLabel, match="land mask"):
        run(spark, replace(d, truth=f"{tmp_path}/truth"), ev.Eval(("bias",), tuple(named("global_land"))))
    with pytest.raises(MissingLabel, match="no land mask"):
        spark.read.parquet(d.truth).drop("land_sea_mask").write.parquet(f"{tmp_path}/bare")
        run(spark, replace(d, truth=f"{tmp_path}/bare"), ev.Eval(("bias",), tuple(named("global_land"))))


def test_a_land_region_stays_where_the_truth_begins_later(spark, data, tmp_path):
    late = replace(without(spark, data, tmp_path, "truth", "time > TIMESTAMP_NTZ'2020-01-01'"), on_missing="skip")
    rows = run(spark, late, ev.Eval(("bias",), tuple(named("global", "global_land")))).collect()
    assert {r.region for r in rows} == {"global", "global_land"} and all(r.x == pytest.approx(1.0) for r in rows)


def test_persistence_by_valid_time_reaches_back(spark, data, tmp_path):
    """By valid time the first initial times lie before the forecast's first time."""
    d = data("fc")
    early = spark.read.parquet(d.truth).where("time = TIMESTAMP_NTZ'2020-01-01'").withColumns({"time": F.lit(T - timedelta(days=1)).cast("timestamp_ntz"), "x": F.lit(-1.0)})
    spark.read.parquet(d.truth).unionByName(early).write.parquet(f"{tmp_path}/truth")
    rows = run(spark, replace(d, truth=f"{tmp_path}/truth", by_init=False), ev.Eval(("bias",), use_persistence=True, temporal_mean=False)).collect()
    assert {(r.time.day, r.lead_hours): r.x for r in rows} == {(1 + t, 24 * k): -float(k) for t in range(4) for k in range(2)}
