"""Closed forms, known constants and brute force for scores."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skillcube.functions.numeric import fdiv, flog, nan_to_null, norm_cdf
from skillcube.functions.weights import latitude_weights, window_weights, with_latitude_weights
from skillcube.operators import scores
from skillcube.operators.regions import Region, extra_tropical, named, with_regions


def one(df, column):
    return df.select(column).first()[0]


def test_ieee_arithmetic(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 2.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(fdiv(F.col("a"), F.col("b"))).collect()] == [math.inf, -math.inf, None, 0.5, None]
    assert [r[0] for r in rows.select(flog(F.col("b"))).collect()][:1] == [-math.inf]
    assert spark.range(1).select(nan_to_null(F.lit(float("nan")))).first()[0] is None


def test_norm_cdf(spark):
    xs = [-40.0, -8.0, -1.5, 0.0, 0.3, 2.0, 7.5, 39.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", norm_cdf(F.col("x")).alias("p"))
    for x, p in df.collect():
        assert abs(p - math.erfc(-x / math.sqrt(2)) / 2) < 1e-14


def test_latitude_weights():
    s = math.sqrt(3)
    want = [3 * w for w in (1 - s / 2, (s - 1) / 2, 0.5, 0.5, (s - 1) / 2, 1 - s / 2)]
    assert latitude_weights([-75, -45, -15, 15, 45, 75]) == pytest.approx(want)
    with pytest.raises(ValueError):
        latitude_weights([10, 0, -10])


def test_window_weights():
    w = window_weights(61)
    assert w[0] == w[-1] == 0 and w.mean() == pytest.approx(1) and (w > 0).sum() == 59
    with pytest.raises(ValueError):
        window_weights(60)


def grid(spark, rows, schema):
    return with_latitude_weights(spark.createDataFrame(rows, schema))


def test_wind_vector_rmse(spark):
    rows = [(level, lat, 0, f[0], f[1], t[0], t[1]) for lat in (-45.0, 45.0) for level, f, t in ((1, (0.0, 0.0), (0.0, 0.0)), (2, (3.0, -4.0), (-3.0, 4.0)), (3, (None, 1.0), (None, 1.0)))]
    df = grid(spark, rows, "level int, latitude double, time int, u double, v double, u_t double, v_t double")
    out = scores.evaluate_scores(df, [scores.wind_vector_rmse_sqrt_before_time_avg("u", "v", "wind")], ["level"], "time")
    assert [r.rmse for r in out.orderBy("level").collect()] == [0.0, 10.0, None]


@pytest.mark.parametrize("odd", [None, math.inf])
def test_region_keeps_invalid_cells_out(spark, odd):
    rows = [(lat, 0.0, 0, t + 1 if t is not None else 1.0, t) for lat, t in ((-45.0, 0.0), (0.0, odd), (45.0, 0.0))]
    rows = [(a, b, c, 1.0, t) for a, b, c, _, t in rows]
    df = grid(spark, rows, "latitude double, longitude double, time int, x double, x_t double")
    all_ = scores.evaluate_scores(df, [scores.mse("x")], [], "time").first().mse
    assert all_ is None or math.isinf(all_) or math.isnan(all_)
    outside = scores.evaluate_scores(with_regions(df, [extra_tropical()]), [scores.mse("x")], ["region"], "time").first()
    assert outside.mse == pytest.approx(1.0)


def test_land_region_and_overlapping_boxes(spark):
    rows = [(lat, 0.0, 0, 1.0 if lat <= 0 else 0.0, 0.0, 1.0 if lat >= 1 else 0.0) for lat in (-60.0, -20.0, 20.0, 60.0)]
    df = grid(spark, rows, "latitude double, longitude double, time int, x double, x_t double, land_sea_mask double")
    assert scores.evaluate_scores(with_regions(df, named("global_land")), [scores.mse("x")], ["region"], "time").first().mse == 0
    twice = Region("twice", ((-90, 0, 0, 360), (-90, 0, 0, 360), (0, 90, 0, 360)))
    assert [r.w for r in with_regions(df.withColumn("w", F.lit(1.0)), [twice]).orderBy("latitude").select("w").collect()] == [2.0, 2.0, 1.0, 1.0]


def test_gaussian_constants(spark):
    df = grid(spark, [(lat, 0, 1.0, 1.0, 1.02) for lat in (-45.0, 45.0)], "latitude double, time int, x double, x_std double, x_t double")
    assert scores.evaluate_scores(df, [scores.gaussian_crps("x")], [], "time").first().gaussian_crps == pytest.approx(0.23385455, abs=1e-7)
    assert scores.evaluate_scores(df, [scores.gaussian_variance("x")], [], "time").first().gaussian_variance == 1
    rows = [(lat, 0, 1.02, 1.02, 1.0, 1.0, 1.0) for lat in (-45.0, 45.0)]
    df = scores.with_gaussian_threshold(grid(spark, rows, "latitude double, time int, x double, x_std double, x_t double, x_c double, x_std_c double"), "x", [0.8])
    out = scores.evaluate_scores(df, [scores.gaussian_brier("x"), scores.gaussian_ignorance("x")], ["quantile"], "time").first()
    assert out.gaussian_brier == pytest.approx(0.0442103, abs=1e-6) and out.gaussian_ignorance == pytest.approx(0.2360546, abs=1e-6)


def ensemble(spark, members, truth):
    rows = [(0, lat, 0.0, m, x, truth) for lat in (-45.0, 45.0) for m, x in enumerate(members)]
    return spark.createDataFrame(rows, "time int, latitude double, longitude double, member int, x double, x_t double")


def test_crps_is_brute_force(spark):
    r = random.Random(5)
    members, truth = [r.gauss(0, 1) for _ in range(7)], 0.4
    cells = scores.ensemble_cells(ensemble(spark, members, truth), "x", ["time", "latitude", "longitude"])
    row = cells.first()
    spread = sum(abs(a - b) for a in members for b in members) / (7 * 6)
    assert row.crps_skill == pytest.approx(sum(abs(truth - x) for x in members) / 7) and row.crps_spread == pytest.approx(spread)


def test_ensemble_of_one(spark):
    cells = scores.ensemble_cells(ensemble(spark, [2.0], 0.5), "x", ["time", "latitude", "longitude"])
    out = scores.evaluate_scores(with_latitude_weights(cells), [scores.crps(), scores.ensemble_variance(), scores.debiased_ensemble_mean_mse()], [], "time").first()
    assert out.crps == pytest.approx(1.5) and out.ensemble_variance == 0 and out.debiased_ensemble_mean_mse is None


def test_missing_member(spark):
    df = ensemble(spark, [1.0, None, 3.0], 2.0)
    strict = scores.ensemble_cells(df, "x", ["time", "latitude", "longitude"]).first()
    loose = scores.ensemble_cells(df, "x", ["time", "latitude", "longitude"], skipna=True).first()
    assert strict["mean"] is None and strict.crps_skill is None and loose["mean"] == 2.0 and loose.crps_skill == 1.0 and loose.n == 3


def test_energy_score_of_one_member(spark):
    out = scores.energy_score(with_latitude_weights(ensemble(spark, [2.0], 0.5)), "x", [], "time").first()
    assert out.energy_spread == 0 and out.energy_score == pytest.approx(1.5)


def test_rank_histogram(spark):
    rows = [(c, m, float(m), c + 0.5) for c in range(4) for m in range(5)]
    h = scores.rank_histogram(spark.createDataFrame(rows, "c int, member int, x double, x_t double"), "x", ["c"], [], 5)
    assert [r.frequency for r in h.orderBy("bin").collect()] == [0, 0.25, 0.25, 0.25, 0.25, 0]
    with pytest.raises(ValueError):
        scores.rank_histogram(h, "x", ["c"], [], 5, num_bins=4)
    tied = spark.createDataFrame([(c, m, 1.0, 1.0) for c in range(3000) for m in range(3)], "c int, member int, x double, x_t double")
    out = scores.rank_histogram(tied, "x", ["c"], [], 3, break_ties_randomly=True).collect()
    assert all(abs(r.frequency - 0.25) < 0.05 for r in out)


def test_binary_scores(spark):
    df = ensemble(spark, [1.0, 2.0, 3.0, 4.0], 3.5).withColumns({"quantile": F.lit(0.5), "threshold": F.lit(2.5)})
    cells = scores.exceedance_cells(df, "x", ["time", "latitude", "longitude", "quantile"])
    out = scores.evaluate_scores(with_latitude_weights(cells), [scores.brier(), scores.ignorance(), scores.debiased_brier()], [], "time").first()
    assert out.brier == 0.25 and out.ignorance == pytest.approx(math.log(2)) and out.debiased_brier == pytest.approx(0.25 - (1 / 3) / 4)
    never = scores.exceedance_cells(df.withColumn("threshold", F.lit(3.4)).where("x < 3.4"), "x", ["time", "latitude", "longitude", "quantile"])
    assert math.isinf(scores.evaluate_scores(with_latitude_weights(never), [scores.ignorance()], [], "time").first().ignorance)


def test_seeps(spark):
    rows = [(0.0, 0.001, 0.4, 0.002), (0.001, 0.0, 0.4, 0.002), (0.00025, 0.0, 0.4, 0.002), (None, 0.0, 0.4, 0.002), (0.0, 0.001, 0.05, 0.002)]
    df = spark.createDataFrame(rows, "p double, p_t double, p1 double, h double")
    got = [r[0] for r in df.select(scores.seeps_points("p", "h", "p1")).collect()]
    assert got[0] == pytest.approx(0.5 / 0.6) and got[1] == pytest.approx(1.25) and got[2] == 0 and got[3] is None and got[4] is None
