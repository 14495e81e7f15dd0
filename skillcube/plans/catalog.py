"""Queries over the test tables, one per operator, each with SQL of the same meaning where SQL can say it.

Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.functions.numeric import norm_cdf_sql, norm_ppf
from skillcube.functions.weights import window_weights, with_latitude_weights
from skillcube.operators import align, climatology, derived, nearest, reduce, regrid, sampler, scores, select, ufunc, windows
from skillcube.operators.regions import BOXES, Region, named, with_regions
from skillcube.plans import evaluate as ev
from skillcube.sources import cubes, io, layout, mock, zarr
from skillcube.sources.cubes import with_ctes
from skillcube.streaming import running

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SPACE = ["latitude", "longitude"]
CELL = ["init_time", "lead_hours", *SPACE]
REGIONS = ["global", "tropics", "extra-tropics", "ausnz"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """df with its (named) double columns rounded; minus zero becomes zero."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in names})


def r6(x: str, name: str) -> str:
    return f"round(({x})::DOUBLE, 6) + 0.0::DOUBLE AS {name}"


def boxes_sql() -> str:
    rows = ", ".join(f"('{n}', {s}::DOUBLE, {t}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)" for n in REGIONS for s, t, a, b in BOXES[n])
    return f"boxes(region, south, north, west, east) AS (VALUES {rows})"


def strict_sql(agg: str, x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN {agg} END"


def mean_sql(x: str, w: str = "w") -> str:
    return strict_sql(f"sum({w} * ({x})) / sum({w})", x)


def score_sql(points: dict[str, str], values: dict[str, str], frame: str = "pairs", cte: Sequence[str] = ("pairs",), extra: Sequence[str] = (), regions: bool = True, skipna: bool = False, time: str = "init_time", by: Sequence[str] = ("lead_hours",), over_time: bool = True) -> str:
    """Spatial means of points per region and time, values of them, and means over time."""
    keys = [*(["region"] if regions else []), *by]
    area = (lambda x: f"sum(w * ({x})) / sum(CASE WHEN ({x}) IS NOT NULL THEN w END)") if skipna else mean_sql
    join = " JOIN boxes ON f.latitude BETWEEN south AND north AND f.longitude BETWEEN west AND east" if regions else ""
    pts = f"pts AS (SELECT {', '.join([*keys, time])}, w, {', '.join(f'{p} AS {k}' for k, p in points.items())} FROM {frame} f JOIN latw ON f.latitude = latw.latitude{join})"
    per = f"per AS (SELECT {', '.join([*keys, time])}, {', '.join(f'{area(k)} AS {k}' for k in points)} FROM pts GROUP BY ALL)"
    vals = f"vals AS (SELECT {', '.join([*keys, time])}, {', '.join(f'{v} AS {k}' for k, v in values.items())} FROM per)"
    last = ", ".join(r6(f"avg({k})" if skipna else strict_sql(f"avg({k})", k), k) for k in values)
    end = f"SELECT {', '.join(keys)}, {last} FROM vals GROUP BY ALL" if over_time else f"SELECT {', '.join([*keys, f'CAST({time} AS VARCHAR) AS {time}'])}, {', '.join(r6(k, k) for k in values)} FROM vals"
    return with_ctes([*cte, "latw"], *extra, *([boxes_sql()] if regions else []), pts, per, vals) + end


# ---- frames


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic forecast, truth at valid time, and climatology."""
    with_truth = align.with_truth(cubes.det(spark, sf), cubes.obs(spark, sf), SPACE)
    return align.with_climatology(with_truth, cubes.clim(spark, sf), SPACE)


def ensemble_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return align.with_truth(cubes.ens(spark, sf), cubes.obs(spark, sf), SPACE)


def weighted(df: DataFrame, regions: Sequence[str] = REGIONS) -> DataFrame:
    return with_regions(with_latitude_weights(df, cubes.LATITUDES), named(*regions))


def scored(df: DataFrame, ss: list[scores.Score], regions: Sequence[str] = REGIONS, skipna: bool = False) -> DataFrame:
    out = scores.evaluate_scores(weighted(df, regions), ss, ["region", "lead_hours"], "init_time", skipna)
    return rounded(out)


def ensemble_cells(spark: SparkSession, sf: str) -> DataFrame:
    return scores.ensemble_cells(ensemble_pairs(spark, sf), "temperature", CELL)


def _simple(name: str, make, points: dict[str, str], values: dict[str, str]) -> None:
    query(name, score_sql(points, values))(lambda spark, sf: scored(pairs(spark, sf), [make("temperature")]))


_E = "temperature - temperature_t"
_simple("mse_global", scores.mse, {"mse": f"({_E}) ** 2"}, {"mse": "mse"})
_simple("mae_by_region", scores.mae, {"mae": f"abs({_E})"}, {"mae": "mae"})
_simple("bias_by_lead", scores.bias, {"bias": _E}, {"bias": "bias"})
_simple("rmse_sqrt_before_time", scores.rmse_sqrt_before_time_avg, {"se": f"({_E}) ** 2"}, {"rmse": "sqrt(se)"})
_F, _T = "(temperature - temperature_c)", "(temperature_t - temperature_c)"
_simple("acc_daily", scores.acc, {"ft": f"{_F} * {_T}", "ff": f"{_F} * {_F}", "tt": f"{_T} * {_T}"}, {"acc": "CASE WHEN sqrt(ff * tt) <> 0 THEN ft / sqrt(ff * tt) END"})


@query("mse_skipna", score_sql({"mse": f"({_E}) ** 2"}, {"mse": "mse"}, skipna=True))
def _mse_skipna(spark, sf):
    return scored(pairs(spark, sf), [scores.mse("temperature")], skipna=True)


@query("fused_scores", score_sql({"mse": f"({_E}) ** 2", "mae": f"abs({_E})", "bias": _E}, {"mse": "mse", "rmse": "sqrt(mse)", "mae": "mae", "bias": "bias"}))
def _fused(spark, sf):
    t = "temperature"
    return scored(pairs(spark, sf), [scores.mse(t), scores.rmse_sqrt_before_time_avg(t), scores.mae(t), scores.bias(t)])


@query("deterministic_temporal", score_sql({"mse": f"({_E}) ** 2"}, {"mse": "mse"}, over_time=False))
def _temporal(spark, sf):
    out = scores.evaluate_scores(weighted(pairs(spark, sf)), [scores.mse("temperature")], ["region", "lead_hours"], "init_time", over_time=False)
    return rounded(out.withColumn("init_time", F.to_date("init_time").cast("string")))


@query("spatial_mse", with_ctes(["pairs"]) + f"SELECT lead_hours, latitude, longitude, {r6(strict_sql(f'avg(({_E}) ** 2)', _E), 'mse')}, {r6(strict_sql(f'avg(abs({_E}))', _E), 'mae')}, {r6(strict_sql(f'avg({_E})', _E), 'bias')} FROM pairs GROUP BY ALL")
def _spatial_mse(spark, sf):
    e = F.col("temperature") - F.col("temperature_t")
    return rounded(scores.spatial(pairs(spark, sf), {"mse": e * e, "mae": F.abs(e), "bias": e}, ["lead_hours", *SPACE]), "mse", "mae", "bias")


_WIND = "wp AS (SELECT f.level, f.latitude, f.longitude, f.u, f.v, t.u AS u_t, t.v AS v_t FROM col f JOIN col t ON t.level = CASE f.level WHEN 1000 THEN 850 WHEN 850 THEN 700 WHEN 700 THEN 500 WHEN 500 THEN 300 WHEN 300 THEN 200 WHEN 200 THEN 100 ELSE 1000 END AND f.latitude = t.latitude AND f.longitude = t.longitude)"


def wind_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Winds of one level against those of the next."""
    c = cubes.column(spark, sf).select("level", *SPACE, "u", "v")
    levels = cubes.LEVELS
    following = F.element_at(F.array(*(F.lit(x) for x in levels)), F.pmod(F.array_position(F.array(*(F.lit(x) for x in levels)), F.col("level")).cast("int") - 2, F.lit(7)) + 1)
    t = c.withColumn("level", following.cast("int")).withColumnsRenamed({"u": "u_t", "v": "v_t"})
    return c.join(t, ["level", *SPACE])


@query("wind_vector_mse", with_ctes(["col", "clatw"], _WIND) + f"SELECT level, {r6('sum(w * ((u - u_t) ** 2 + (v - v_t) ** 2)) / sum(w)', 'vmse')}, {r6('sqrt(sum(w * ((u - u_t) ** 2 + (v - v_t) ** 2)) / sum(w))', 'vrmse')} FROM wp JOIN clatw USING (latitude) GROUP BY ALL")
def _wind(spark, sf):
    rows = with_latitude_weights(wind_pairs(spark, sf), cubes.COLUMN_LATITUDES).withColumn("time", F.lit(0))
    a, b = scores.wind_vector_mse("u", "v", "wind"), scores.wind_vector_rmse_sqrt_before_time_avg("u", "v", "wind")
    a.meta["column"], b.meta["column"] = "vmse", "vrmse"
    return rounded(scores.evaluate_scores(rows, [a, b], ["level"], "time"), "vmse", "vrmse")


@query("persistence_mse", score_sql({"mse": "(temperature - temperature_t) ** 2"}, {"mse": "mse"}, frame="pers", cte=("det", "obs"), extra=["pers AS (SELECT d.init_time, d.lead_hours, d.latitude, d.longitude, a.temperature, b.temperature AS temperature_t FROM det d JOIN obs a ON d.init_time = a.time AND d.latitude = a.latitude AND d.longitude = a.longitude JOIN obs b ON d.valid_time = b.time AND d.latitude = b.latitude AND d.longitude = b.longitude)"]))
def _persistence(spark, sf):
    obs = cubes.obs(spark, sf)
    cells = cubes.det(spark, sf).drop("temperature", "temperature_std")
    return scored(align.with_truth(align.persistence_forecast(cells, obs, SPACE), obs, SPACE), [scores.mse("temperature")])


@query("analysis_truth_mse", score_sql({"mse": "(temperature - temperature_t) ** 2"}, {"mse": "mse"}, frame="ana", cte=("det",), extra=["ana AS (SELECT d.init_time, d.lead_hours, d.latitude, d.longitude, d.temperature, a.temperature AS temperature_t FROM det d JOIN det a ON a.lead_hours = 0 AND a.init_time = d.valid_time AND d.latitude = a.latitude AND d.longitude = a.longitude)"]))
def _analysis(spark, sf):
    d = align.match_analysis_steps(cubes.det(spark, sf), 24)
    return scored(align.with_truth(d, align.analysis_truth(d, ["temperature"], SPACE), SPACE), [scores.mse("temperature")])


@query("climatology_forecast_mse", score_sql({"mse": "(temperature_c - temperature_t) ** 2"}, {"mse": "mse"}))
def _climatology_forecast(spark, sf):
    cells = align.climatology_forecast(cubes.det(spark, sf), cubes.clim(spark, sf), ["temperature"], SPACE)
    return scored(align.with_truth(cells, cubes.obs(spark, sf), SPACE), [scores.mse("temperature")])


_DRY = "0.00025"
_SEEPS = """sc AS (SELECT dayofyear(time) AS d, latitude, quantile_cont(precip, 0.66) FILTER (precip >= 0.00025) AS h, avg(CASE WHEN precip < 0.00025 THEN 1.0 ELSE 0.0 END) AS dry FROM ser GROUP BY ALL),
sp AS (SELECT latitude, avg(dry) AS p FROM sc GROUP BY ALL),
sf AS (SELECT t.time, t.latitude, lag(t.precip) OVER (PARTITION BY t.latitude ORDER BY t.time) AS f, t.precip AS t, h, p FROM ser t JOIN sc ON dayofyear(t.time) = sc.d AND t.latitude = sc.latitude JOIN sp ON t.latitude = sp.latitude),
k AS (SELECT *, f < 0.00025 AS fd, f > 0.00025 AND f < h AS fl, f >= h AS fh, t < 0.00025 AS td, t > 0.00025 AND t < h AS tl, t >= h AS th FROM sf),
s AS (SELECT latitude, CASE WHEN p > 0.1 AND p < 0.85 THEN 0.5 * (fd::INT * tl::INT / (1 - p) + fd::INT * th::INT * 4 / (1 - p) + fl::INT * td::INT / p + fl::INT * th::INT * 3 / (1 - p) + fh::INT * td::INT * (1 / p + 3 / (2 + p)) + fh::INT * tl::INT * 3 / (2 + p)) END AS seeps FROM k WHERE f IS NOT NULL)
"""


@query("seeps", with_ctes(["ser"], _SEEPS) + f"SELECT latitude, {r6('avg(seeps)', 'seeps')} FROM s GROUP BY ALL")
def _seeps(spark, sf):
    from pyspark.sql import Window

    ser = cubes.series(spark, sf)
    day = ser.withColumn("dayofyear", F.dayofyear("time"))
    clim = day.groupBy("dayofyear", "latitude").agg(F.percentile(F.when(F.col("precip") >= 0.00025, F.col("precip")), F.lit(0.66)).alias("h"), F.avg((F.col("precip") < 0.00025).cast("double")).alias("precip_seeps_dry_fraction"))
    p1 = climatology.mean_dry_fraction(clim, "precip", ["latitude"])
    line = Window.partitionBy("latitude").orderBy("time")
    rows = day.withColumnsRenamed({"precip": "precip_t"}).withColumn("precip", F.lag("precip_t").over(line)).join(clim.select("dayofyear", "latitude", "h"), ["dayofyear", "latitude"]).join(p1, "latitude").where("precip is not null")
    out = rows.withColumn("seeps", scores.seeps_points("precip", "h", "p1")).groupBy("latitude").agg(F.avg("seeps").alias("seeps"))
    return rounded(out, "seeps")


# ---- ensembles


def _ensemble(name: str, make, points: dict[str, str], values: dict[str, str]) -> None:
    query(name, score_sql(points, values, frame="cells", cte=("cells",)))(lambda spark, sf: scored(ensemble_cells(spark, sf), [make()]))


_ensemble("crps", scores.crps, {"x": "crps_skill - crps_spread / 2"}, {"crps": "x"})
_ensemble("crps_skill", scores.crps_skill, {"x": "crps_skill"}, {"crps_skill": "x"})
_ensemble("crps_spread", scores.crps_spread, {"x": "crps_spread"}, {"crps_spread": "x"})
_ensemble("ens_mean_mse", scores.ensemble_mean_mse, {"x": "(truth - mean) ** 2"}, {"ensemble_mean_mse": "x"})
_ensemble("ens_mean_rmse", scores.ensemble_mean_rmse_sqrt_before_time_avg, {"x": "(truth - mean) ** 2"}, {"ensemble_mean_rmse": "sqrt(x)"})
_ensemble("ens_mean_mse_debiased", scores.debiased_ensemble_mean_mse, {"x": "(truth - mean) ** 2 - var / n"}, {"debiased_ensemble_mean_mse": "x"})
_ensemble("ens_variance", scores.ensemble_variance, {"x": "var"}, {"ensemble_variance": "x"})
_ensemble("ens_stddev", scores.ensemble_stddev_sqrt_before_time_avg, {"x": "var"}, {"ensemble_stddev": "sqrt(x)"})


@query("spatial_crps", with_ctes(["cells"]) + f"SELECT lead_hours, latitude, longitude, {r6(strict_sql('avg(crps_skill - crps_spread / 2)', 'crps_skill - crps_spread / 2'), 'crps')}, {r6(strict_sql('avg(var)', 'var'), 'variance')} FROM cells GROUP BY ALL")
def _spatial_crps(spark, sf):
    points = {"crps": F.col("crps_skill") - F.col("crps_spread") / 2, "variance": scores.zero_variance_of_one()}
    return rounded(scores.spatial(ensemble_cells(spark, sf), points, ["lead_hours", *SPACE]), "crps", "variance")


_ENERGY = """nx AS (SELECT *, lead(temperature) OVER (PARTITION BY init_time, lead_hours, latitude, longitude ORDER BY member) AS nxt FROM epairs),
sk AS (SELECT lead_hours, init_time, member, CASE WHEN count(temperature - temperature_t) = count(*) THEN sum(w * (temperature - temperature_t) ** 2) / sum(w) END AS a FROM nx JOIN latw USING (latitude) GROUP BY ALL),
sr AS (SELECT lead_hours, init_time, member, CASE WHEN count(temperature - nxt) = count(*) THEN sum(w * (temperature - nxt) ** 2) / sum(w) END AS b FROM nx JOIN latw USING (latitude) WHERE member < 4 GROUP BY ALL),
s1 AS (SELECT lead_hours, init_time, CASE WHEN count(a) = count(*) THEN avg(sqrt(a)) END AS skill FROM sk GROUP BY ALL), s2 AS (SELECT lead_hours, init_time, coalesce(CASE WHEN count(b) = count(*) THEN avg(sqrt(b)) END, 0) AS spread FROM sr GROUP BY ALL)
"""


@query("energy_score", with_ctes(["epairs", "latw"], _ENERGY) + f"SELECT lead_hours, {r6(strict_sql('avg(skill - spread / 2)', 'skill'), 'energy_score')}, {r6(strict_sql('avg(skill)', 'skill'), 'energy_skill')}, {r6(strict_sql('avg(spread)', 'spread'), 'energy_spread')} FROM s1 JOIN s2 USING (lead_hours, init_time) GROUP BY ALL")
def _energy(spark, sf):
    return rounded(scores.energy_score(with_latitude_weights(ensemble_pairs(spark, sf), cubes.LATITUDES), "temperature", ["lead_hours"], "init_time"))


_HIST = """rk AS (SELECT init_time, lead_hours, latitude, longitude, sum(CASE WHEN temperature IS NOT NULL AND (temperature_t IS NULL OR temperature < temperature_t) THEN 1 ELSE 0 END) AS rank FROM epairs GROUP BY ALL),
cn AS (SELECT lead_hours, rank::INTEGER AS bin, count(*) AS k FROM rk GROUP BY ALL),
hh AS (SELECT lead_hours, bin, coalesce(k, 0)::DOUBLE / sum(coalesce(k, 0)) OVER (PARTITION BY lead_hours) AS frequency FROM (SELECT DISTINCT lead_hours FROM rk) CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5])::INTEGER AS bin) LEFT JOIN cn USING (lead_hours, bin))"""


@query("rank_histogram", with_ctes(["epairs"], _HIST) + f"SELECT lead_hours, bin, {r6('frequency', 'frequency')} FROM hh")
def _histogram(spark, sf):
    return rounded(scores.rank_histogram(ensemble_pairs(spark, sf), "temperature", CELL, ["lead_hours"], 5), "frequency")


@query("central_reliability", with_ctes(["epairs"], _HIST, "st AS (SELECT lead_hours, floor(abs(bin - 2.5) + 0.5)::INTEGER AS step, sum(frequency) AS p, count(*) AS k FROM hh GROUP BY ALL)") + f"SELECT lead_hours, {r6('sum(k) OVER o / 6', 'desired_prob')}, {r6('sum(p) OVER o', 'probability')} FROM st WINDOW o AS (PARTITION BY lead_hours ORDER BY step)")
def _reliability(spark, sf):
    h = scores.rank_histogram(ensemble_pairs(spark, sf), "temperature", CELL, ["lead_hours"], 5)
    return rounded(scores.central_reliability(h, ["lead_hours"], 6), "desired_prob", "probability")


# ---- Gaussian forecasts and thresholds

_Z = "((temperature - temperature_t) / nullif(temperature_std, 0))"
_simple("gaussian_crps", scores.gaussian_crps, {"x": f"temperature_std * ({_Z} * (2 * {norm_cdf_sql(_Z)} - 1) + 2 * exp(-{_Z} * {_Z} / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))"}, {"gaussian_crps": "x"})
_simple("gaussian_variance", scores.gaussian_variance, {"x": "temperature_std ** 2"}, {"gaussian_variance": "x"})

Q = (0.2, 0.8)
#: Thresholds: quantiles of a day's observations over longitudes, per latitude.
_THRESHOLDS = "th AS (SELECT dayofyear, latitude, quantile, CASE quantile WHEN 0.2 THEN q[1] ELSE q[2] END AS threshold FROM (SELECT dayofyear(time) AS dayofyear, latitude, quantile_cont(temperature, [0.2, 0.8]) AS q FROM obs GROUP BY ALL) CROSS JOIN (SELECT unnest([0.2, 0.8])::DOUBLE AS quantile))"


def threshold_climatology(spark: SparkSession, sf: str) -> DataFrame:
    o = cubes.obs(spark, sf).withColumn("dayofyear", F.dayofyear("time"))
    per = reduce.quantiles(o.select("dayofyear", *SPACE, "temperature"), ["temperature"], ["longitude"], ["dayofyear", *SPACE], Q, skipna=True, suffix="_quantile")
    return per.withColumn("longitude", F.explode(F.array(*map(F.lit, cubes.LONGITUDES))))


def _with_threshold(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return scores.with_quantile_threshold(df, threshold_climatology(spark, sf), "temperature", SPACE, Q, "valid_time")


_GT = f"gt AS (SELECT p.*, quantile, threshold, {norm_cdf_sql('((threshold - temperature) / nullif(temperature_std, 0))')} AS below FROM pairs p JOIN th ON dayofyear(p.valid_time) = th.dayofyear AND p.latitude = th.latitude)"


def _gaussian_binary(name: str, make, point: str, column: str) -> None:
    sql = score_sql({"x": point}, {column: "x"}, frame="gt", cte=("pairs",), extra=[_THRESHOLDS, _GT], by=("lead_hours", "quantile"))

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = weighted(_with_threshold(pairs(spark, sf), spark, sf))
        return rounded(scores.evaluate_scores(rows, [make("temperature")], ["region", "lead_hours", "quantile"], "init_time"), column)

    query(name, sql)(run)


_gaussian_binary("gaussian_brier", scores.gaussian_brier, "((1 - below) - (temperature_t > threshold)::INT) ** 2", "gaussian_brier")
_gaussian_binary("gaussian_ignorance", scores.gaussian_ignorance, "CASE WHEN below IS NULL THEN NULL WHEN temperature_t > threshold THEN CASE WHEN 1 - below > 0 THEN -ln(1 - below) ELSE 'inf'::DOUBLE END ELSE CASE WHEN below > 0 THEN -ln(below) ELSE 'inf'::DOUBLE END END", "gaussian_ignorance")


@query("gaussian_rps", score_sql({"x": "(below - (temperature_t < threshold)::INT) ** 2"}, {"y": "x"}, frame="gt", cte=("pairs",), extra=[_THRESHOLDS, _GT], by=("lead_hours", "quantile"), over_time=False).replace("SELECT region, lead_hours, quantile, CAST(init_time AS VARCHAR) AS init_time, " + r6("y", "y") + " FROM vals", "SELECT region, lead_hours, " + r6("avg(s)", "gaussian_rps") + " FROM (SELECT region, lead_hours, init_time, sum(coalesce(y, 0)) AS s FROM vals GROUP BY ALL) GROUP BY ALL"))
def _gaussian_rps(spark, sf):
    rows = weighted(_with_threshold(pairs(spark, sf), spark, sf))
    by = ["region", "lead_hours", "init_time"]
    per = reduce.spatial_mean(rows, {"gaussian_rps": scores.gaussian_rps_points("temperature")}, [*by, "quantile"])
    return rounded(reduce.time_mean(scores.sum_over_quantiles(per, "gaussian_rps", by), ["gaussian_rps"], by[:2]), "gaussian_rps")


@query("gaussian_threshold", with_ctes(["clim", "obs"], "sd AS (SELECT dayofyear(time) AS dayofyear, latitude, stddev_samp(temperature) AS sd FROM obs GROUP BY ALL)") + f"SELECT dayofyear, latitude, longitude, quantile, {r6(f'temperature + CASE quantile WHEN 0.2 THEN {norm_ppf(0.2)!r} ELSE {norm_ppf(0.8)!r} END * sd', 'threshold')} FROM clim JOIN sd USING (dayofyear, latitude) CROSS JOIN (SELECT unnest([0.2, 0.8])::DOUBLE AS quantile)")
def _gaussian_threshold(spark, sf):
    sd = cubes.obs(spark, sf).groupBy(F.dayofyear("time").alias("dayofyear"), "latitude").agg(F.stddev_samp("temperature").alias("temperature_std_c"))
    rows = cubes.clim(spark, sf).withColumnRenamed("temperature", "temperature_c").join(sd, ["dayofyear", "latitude"])
    return rounded(scores.with_gaussian_threshold(rows, "temperature", Q).select("dayofyear", *SPACE, "quantile", "threshold"), "threshold")


_EX = """ex AS (SELECT e.init_time, e.lead_hours, e.latitude, e.longitude, quantile, count(*) AS n, CASE WHEN count(temperature) = count(*) THEN avg((temperature > threshold)::INT) END AS p,
  CASE WHEN count(temperature) = count(*) THEN var_samp((temperature > threshold)::INT) END AS p_var, avg(coalesce((temperature > threshold)::INT, 0)) AS p_some, avg(coalesce((temperature < threshold)::INT, 0)) AS below_some,
  any_value((temperature_t > threshold)::INT) AS above, any_value(coalesce((temperature_t < threshold)::INT, 0)) AS truth_below FROM epairs e JOIN th ON dayofyear(e.valid_time) = th.dayofyear AND e.latitude = th.latitude GROUP BY ALL)"""


def exceedances(spark: SparkSession, sf: str) -> DataFrame:
    return scores.exceedance_cells(_with_threshold(ensemble_pairs(spark, sf), spark, sf), "temperature", [*CELL, "quantile"])


def _binary(name: str, make, point: str, column: str) -> None:
    sql = score_sql({"x": point}, {column: "x"}, frame="ex", cte=("epairs",), extra=[_THRESHOLDS, _EX], by=("lead_hours", "quantile"))

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(scores.evaluate_scores(weighted(exceedances(spark, sf)), [make()], ["region", "lead_hours", "quantile"], "init_time"), column)

    query(name, sql)(run)


_binary("brier", scores.brier, "(p - above) ** 2", "brier")
_binary("brier_debiased", scores.debiased_brier, "(p - above) ** 2 - p_var / n", "debiased_brier")
_binary("ignorance", scores.ignorance, "CASE WHEN above = 1 THEN CASE WHEN p_some > 0 THEN -ln(p_some) ELSE 'inf'::DOUBLE END WHEN above = 0 THEN CASE WHEN p_some < 1 THEN -ln(1 - p_some) ELSE 'inf'::DOUBLE END END", "ignorance")


@query("spatial_brier", with_ctes(["epairs"], _THRESHOLDS, _EX) + f"SELECT lead_hours, latitude, longitude, quantile, {r6(strict_sql('avg((p - above) ** 2)', 'p - above'), 'brier')}, {r6(strict_sql('avg((p - above) ** 2 - p_var / n)', 'p - above'), 'debiased_brier')} FROM ex GROUP BY ALL")
def _spatial_brier(spark, sf):
    b = (F.col("p") - F.col("above")) ** 2
    return rounded(scores.spatial(exceedances(spark, sf), {"brier": b, "debiased_brier": b - F.col("p_var") / F.col("n")}, ["lead_hours", *SPACE, "quantile"]), "brier", "debiased_brier")


@query("rps", score_sql({"x": "(below_some - truth_below) ** 2"}, {"y": "x"}, frame="ex", cte=("epairs",), extra=[_THRESHOLDS, _EX], by=("lead_hours", "quantile"), over_time=False).replace("SELECT region, lead_hours, quantile, CAST(init_time AS VARCHAR) AS init_time, " + r6("y", "y") + " FROM vals", "SELECT region, lead_hours, " + r6("avg(s)", "rps") + " FROM (SELECT region, lead_hours, init_time, sum(coalesce(y, 0)) AS s FROM vals GROUP BY ALL) GROUP BY ALL"))
def _rps(spark, sf):
    by = ["region", "lead_hours", "init_time"]
    per = reduce.spatial_mean(weighted(exceedances(spark, sf)), {"rps": scores.rps_points()}, [*by, "quantile"])
    return rounded(reduce.time_mean(scores.sum_over_quantiles(per, "rps", by), ["rps"], by[:2]), "rps")


# ---- derived variables

COLUMN_CELL = ["level", *SPACE]
_M = derived.M_PER_DEGREE


def _gradient_sql(f: str, x: str, window: str) -> str:
    fm, fp, xm, xp = f"lag({f}) OVER {window}", f"lead({f}) OVER {window}", f"lag({x}) OVER {window}", f"lead({x}) OVER {window}"
    inner = f"(({x} - {xm}) ** 2 * {fp} + (({xp} - {x}) ** 2 - ({x} - {xm}) ** 2) * {f} - ({xp} - {x}) ** 2 * {fm}) / (({x} - {xm}) * ({xp} - {x}) * ({xp} - {xm}))"
    return f"CASE WHEN {xm} IS NULL THEN ({fp} - {f}) / ({xp} - {x}) WHEN {xp} IS NULL THEN ({f} - {fm}) / ({x} - {xm}) ELSE {inner} END"


_WX, _WY, _WL = "(PARTITION BY level, latitude ORDER BY longitude)", "(PARTITION BY level, longitude ORDER BY latitude)", "(PARTITION BY latitude, longitude ORDER BY level)"
_DX = lambda f: f"({_gradient_sql(f, 'longitude', _WX)}) / cos(radians(latitude)) / {_M!r}"
_DY = lambda f: f"({_gradient_sql(f, 'latitude', _WY)}) / {_M!r}"
_GRADS = f"gr AS (SELECT *, {_DX('u')} AS ux, {_DX('v')} AS vx, {_DY('u')} AS uy, {_DY('v')} AS vy, {_DX('geopotential')} AS px, {_DY('geopotential')} AS py, 2 * {derived.OMEGA!r} * sin(radians(latitude)) AS f FROM col)"


def _derived(name: str, sql_value: str, compute, scale: float = 1.0, ctes: Sequence[str] = (_GRADS,), frame: str = "gr", keys: Sequence[str] = ("level", "latitude", "longitude"), column: str | None = None) -> None:
    column = column or name
    sql = with_ctes(["col"], *ctes) + f"SELECT {', '.join(keys)}, {r6(f'({sql_value}) * {scale!r}', column)} FROM {frame}"
    query(name, sql)(lambda spark, sf: rounded(compute(cubes.column(spark, sf)).select(*keys, (F.col(column) * scale).alias(column)), column))


_derived("wind_speed", "sqrt(u * u + v * v)", lambda d: d.withColumn("wind_speed", derived.wind_speed()))
_derived("divergence", "ux + vy", lambda d: d.withColumn("divergence", derived.divergence(COLUMN_CELL)), 1e6)
_derived("vorticity", "vx - uy", lambda d: d.withColumn("vorticity", derived.vorticity(COLUMN_CELL)), 1e6)
_derived("vertical_velocity", "w", lambda d: derived.vertical_velocity(d, COLUMN_CELL), 1.0, (_GRADS, f"st AS (SELECT level, latitude, longitude, coalesce((-(ux + vy) + lag(-(ux + vy)) OVER {_WL}) / 2 * (level - lag(level) OVER {_WL}) * 100, 0) AS s FROM gr)", f"vv AS (SELECT level, latitude, longitude, sum(s) OVER {_WL} AS w FROM st)"), "vv")
_PANEL = lambda f: f"({f} + lead({f}) OVER {_WL}) / 2 * (lead(level) OVER {_WL} - level)"
_derived("eddy_ke", "e", lambda d: derived.eddy_kinetic_energy(d, COLUMN_CELL).withColumnRenamed("eddy_kinetic_energy", "eddy_ke"), 1.0, ("zm AS (SELECT level, latitude, longitude, ((u - avg(u) OVER z) ** 2 + (v - avg(v) OVER z) ** 2) / 2 AS k FROM col WINDOW z AS (PARTITION BY level, latitude))", f"pn AS (SELECT latitude, longitude, {_PANEL('k')} AS a FROM zm)", "ek AS (SELECT latitude, longitude, sum(a) AS e FROM pn GROUP BY ALL)"), "ek", SPACE)
_derived("geostrophic_speed", "sqrt((py / f) ** 2 + (px / f) ** 2)", lambda d: derived.geostrophic_speed(d, COLUMN_CELL, "geostrophic_speed"))
_derived("ageostrophic_speed", "sqrt((u + py / f) ** 2 + (v - px / f) ** 2)", lambda d: derived.ageostrophic(d, COLUMN_CELL))
_derived("lapse_rate", "t / nullif(z, 0)", lambda d: d.withColumn("lapse_rate", derived.lapse_rate(COLUMN_CELL)), 1.0, (f"lr AS (SELECT level, latitude, longitude, {_gradient_sql('temperature', 'level', _WL)} AS t, ({_gradient_sql('geopotential', 'level', _WL)}) / 9.81 AS z FROM col)",), "lr")
_derived("total_column", "a / 9.81", lambda d: derived.total_column(d, COLUMN_CELL, name="total_column"), 1.0, (f"pn AS (SELECT latitude, longitude, {_PANEL('specific_humidity')} AS p FROM col)", "tc AS (SELECT latitude, longitude, sum(p) AS a FROM pn GROUP BY ALL)"), "tc", SPACE)
_derived("ivt", "sqrt(a * a + b * b) / 9.81", lambda d: derived.integrated_water_transport(d, COLUMN_CELL).withColumnRenamed("integrated_vapor_transport", "ivt"), 1.0, (f"pn AS (SELECT latitude, longitude, {_PANEL('(specific_humidity * u)')} AS p, {_PANEL('(specific_humidity * v)')} AS q FROM col WHERE level BETWEEN 300 AND 1000)", "tc AS (SELECT latitude, longitude, sum(p) AS a, sum(q) AS b FROM pn GROUP BY ALL)"), "tc", SPACE)
_SVP = "(6.112 * exp(17.67 * (temperature - 273.15) / (temperature - 29.65)))"
_derived("relative_humidity", f"(specific_humidity / (1 - specific_humidity)) / (0.622 * {_SVP} / (level - {_SVP}))", lambda d: d.withColumn("relative_humidity", derived.relative_humidity()), 1.0, (), "col")

_ACC = "tp AS (SELECT level, latitude, (dense_rank() OVER (ORDER BY longitude) - 1) * 6 AS lead_hours, sum(u + 25) OVER (PARTITION BY level, latitude ORDER BY longitude) AS tp FROM col), dd AS (SELECT *, tp - lag(tp) OVER o AS d FROM tp WINDOW o AS (PARTITION BY level, latitude ORDER BY lead_hours)), a12 AS (SELECT level, latitude, lead_hours, CASE WHEN count(d) OVER o = 2 THEN greatest(sum(d) OVER o, 0) END AS a FROM dd WINDOW o AS (PARTITION BY level, latitude ORDER BY lead_hours ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))"


def running_total(spark: SparkSession, sf: str) -> DataFrame:
    """level, latitude, lead_hours, tp: a growing total along six-hourly lead times."""
    from pyspark.sql import Window

    c = cubes.column(spark, sf)
    total = F.sum(F.col("u") + 25).over(Window.partitionBy("level", "latitude").orderBy("longitude"))
    return c.select("level", "latitude", (F.col("longitude") / 45 * 6).cast("long").alias("lead_hours"), total.alias("tp"))


@query("precip_accum", with_ctes(["col"], _ACC) + f"SELECT level, latitude, lead_hours::BIGINT AS lead_hours, {r6('a', 'tp_12hr')} FROM a12")
def _precip_accum(spark, sf):
    out = derived.precipitation_accumulation(running_total(spark, sf), "tp", ["level", "latitude", "lead_hours"], 12)
    return rounded(out.select("level", "latitude", "lead_hours", "tp_12hr"), "tp_12hr")


@query("precip_accum_agg", with_ctes(["col"], _ACC) + f"SELECT level, latitude, lead_hours::BIGINT AS lead_hours, {r6('CASE WHEN count(a) OVER o = 2 THEN sum(a) OVER o END', 'tp_long')} FROM a12 WINDOW o AS (PARTITION BY level, latitude ORDER BY lead_hours ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)")
def _precip_agg(spark, sf):
    short = derived.precipitation_accumulation(running_total(spark, sf), "tp", ["level", "latitude", "lead_hours"], 12)
    out = derived.aggregate_accumulation(short, "tp_12hr", ["level", "latitude", "lead_hours"], 2, "tp_long")
    return rounded(out.select("level", "latitude", "lead_hours", "tp_long"), "tp_long")


_CIRCLE = f"(cos(radians(latitude)) * {2 * 3.141592653589793 * derived.EARTH_RADIUS!r})"
_SPECTRUM = f"""sp AS (SELECT vec_id, latitude, k AS wavenumber, CASE WHEN k = 0 THEN 1 ELSE 2 END * (sum(x * cos(2 * pi() * ((j * k) % 64) / 64)) ** 2 + sum(x * sin(2 * pi() * ((j * k) % 64) / 64)) ** 2) / 4096 * {_CIRCLE} AS energy
  FROM wav CROSS JOIN (SELECT unnest(range(0, 33))::INTEGER AS k) GROUP BY vec_id, latitude, k)"""


@query("zonal_spectrum", with_ctes(["wav"], _SPECTRUM) + f"SELECT latitude, wavenumber, {r6('avg(energy) / 1e6', 'energy')} FROM sp GROUP BY ALL")
def _spectrum(spark, sf):
    s = derived.zonal_energy_spectrum(cubes.wave(spark, sf), "x", ["vec_id", "latitude"], 64)
    return rounded(s.groupBy("latitude", "wavenumber").agg((F.avg("energy") / 1e6).alias("energy")), "energy")


_FREQUENCIES = [1e-7, 3.3e-7, 6e-7]


@query("spectrum_interp", with_ctes(["wav"], _SPECTRUM, f"mn AS (SELECT latitude, wavenumber, wavenumber / {_CIRCLE} AS f, avg(energy) AS e FROM sp GROUP BY ALL)", "nx AS (SELECT *, lead(f) OVER o AS f1, lead(e) OVER o AS e1 FROM mn WINDOW o AS (PARTITION BY latitude ORDER BY wavenumber))") + f"SELECT latitude, {r6('c * 1e6', 'frequency')}, {r6('(e + (e1 - e) * (c - f) / (f1 - f)) / 1e6', 'energy')} FROM nx JOIN (SELECT unnest({_FREQUENCIES})::DOUBLE AS c) ON c >= f AND c < f1")
def _spectrum_interp(spark, sf):
    s = derived.zonal_energy_spectrum(cubes.wave(spark, sf), "x", ["vec_id", "latitude"], 64)
    mean = s.groupBy("latitude", "wavenumber").agg(F.avg("energy").alias("energy"), F.first("frequency").alias("frequency"))
    out = derived.interpolate_spectrum(mean, ["latitude"], _FREQUENCIES)
    return rounded(out.select("latitude", (F.col("common_frequency") * 1e6).alias("frequency"), (F.col("energy") / 1e6).alias("energy")), "frequency", "energy")


# ---- regridding

SOURCE = regrid.Grid(tuple(cubes.COLUMN_LATITUDES), tuple(cubes.COLUMN_LONGITUDES), True, True)
TARGET = regrid.Grid((-60.0, 0.0, 60.0), (10.0, 100.0, 200.0, 300.0), True, True)


def _values_sql(name: str, rows: list[tuple], columns: str) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(f'{float(x)!r}::DOUBLE' for x in r) + ')' for r in rows)})"


_NEAREST = """gp AS (SELECT DISTINCT latitude, longitude FROM col), nn AS (SELECT a.latitude AS lat, b.longitude AS lon, g.latitude, g.longitude, row_number() OVER (PARTITION BY a.latitude, b.longitude ORDER BY round(sin(radians(g.latitude - a.latitude) / 2) ** 2 + cos(radians(a.latitude)) * cos(radians(g.latitude)) * sin(radians(g.longitude - b.longitude) / 2) ** 2, 12), g.latitude, g.longitude) AS i
  FROM (SELECT unnest([-60.0, 0.0, 60.0])::DOUBLE AS latitude) a CROSS JOIN (SELECT unnest([10.0, 100.0, 200.0, 300.0])::DOUBLE AS longitude) b CROSS JOIN gp g)"""


@query("regrid_nearest", with_ctes(["col"], _NEAREST) + f"SELECT level, lat AS latitude, lon AS longitude, {r6('temperature', 'temperature')} FROM nn JOIN col USING (latitude, longitude) WHERE i = 1")
def _regrid_nearest(spark, sf):
    return rounded(regrid.nearest(cubes.column(spark, sf), ["temperature"], ["level"], SOURCE, TARGET), "temperature")


_BI_LAT, _BI_LON = regrid.linear_weights(SOURCE.latitudes, TARGET.latitudes, None, True), regrid.linear_weights(SOURCE.longitudes, TARGET.longitudes, 360.0, False)
_CO_LAT, _CO_LON = regrid.conservative_latitudes(SOURCE, TARGET), regrid.conservative_longitudes(SOURCE, TARGET)


@query("regrid_bilinear", with_ctes(["col"], _values_sql("a", _BI_LAT, "lat, latitude, wa"), _values_sql("o", _BI_LON, "lon, longitude, wo")) + f"SELECT level, lat AS latitude, lon AS longitude, {r6('sum(wa * wo * temperature)', 'temperature')} FROM col JOIN a USING (latitude) JOIN o USING (longitude) GROUP BY ALL")
def _regrid_bilinear(spark, sf):
    return rounded(regrid.bilinear(cubes.column(spark, sf), ["temperature"], ["level"], SOURCE, TARGET), "temperature")


@query("regrid_conservative", with_ctes(["col"], _values_sql("a", _CO_LAT, "lat, latitude, wa"), _values_sql("o", _CO_LON, "lon, longitude, wo")) + f"SELECT level, lat AS latitude, lon AS longitude, {r6('sum(wa * wo * temperature) / sum(CASE WHEN temperature IS NOT NULL THEN wa * wo END)', 'temperature')} FROM col JOIN a USING (latitude) JOIN o USING (longitude) GROUP BY ALL")
def _regrid_conservative(spark, sf):
    return rounded(regrid.conservative(cubes.column(spark, sf), ["temperature"], ["level"], SOURCE, TARGET), "temperature")


# ---- climatologies

WINDOW = 61
_W = window_weights(WINDOW)
_WW = "ww AS (SELECT i - 31 AS o, w FROM (SELECT unnest(range(1, 62)) AS i, unnest([" + ", ".join(f"{x!r}" for x in _W.tolist()) + "])::DOUBLE AS w))"
_RING = """pd AS (SELECT year(time) AS y, dayofyear(time) AS d, latitude, avg(precip) AS x FROM ser GROUP BY ALL),
ln AS (SELECT y, latitude, max(CASE WHEN d = 365 THEN x END) AS fill FROM pd GROUP BY ALL),
rg AS (SELECT ln.y, dd.d, ln.latitude, coalesce(pd.x, ln.fill) AS x FROM ln CROSS JOIN (SELECT unnest(range(1, 367))::BIGINT AS d) dd LEFT JOIN pd ON pd.y = ln.y AND pd.d = dd.d AND pd.latitude = ln.latitude),
sp AS (SELECT (d - o - 1 + 366 * 2) % 366 + 1 AS dayofyear, latitude, x, w FROM rg CROSS JOIN ww)"""
_SCALE = "1e4"


def _scaled(df: DataFrame, *columns: str) -> DataFrame:
    return rounded(df.withColumns({c: F.col(c) * 1e4 for c in columns}).withColumn("dayofyear", F.col("dayofyear").cast("int")), *columns)


@query("clim_explicit_mean", with_ctes(["ser"], _WW, _RING) + f"SELECT dayofyear::INTEGER AS dayofyear, latitude, {r6('1e4 * sum(w * x) / sum(w)', 'precip')} FROM sp WHERE w > 0 AND x IS NOT NULL GROUP BY ALL")
def _explicit_mean(spark, sf):
    return _scaled(climatology.explicit(cubes.series(spark, sf), "precip", ["latitude"], ["mean"], WINDOW), "precip")


@query("clim_explicit_std", with_ctes(["ser"], _WW, _RING, "mu AS (SELECT *, sum(w * x) OVER c / sum(w) OVER c AS m FROM sp WHERE w > 0 AND x IS NOT NULL WINDOW c AS (PARTITION BY dayofyear, latitude))") + f"SELECT dayofyear::INTEGER AS dayofyear, latitude, {r6('1e4 * sqrt(sum(w * (x - m) ** 2) / sum(w))', 'precip_std')} FROM mu GROUP BY ALL")
def _explicit_std(spark, sf):
    return _scaled(climatology.explicit(cubes.series(spark, sf), "precip", ["latitude"], ["std"], WINDOW), "precip_std")


def _fast_sql(agg: str, name: str) -> str:
    return with_ctes(["ser"], _WW, f"pd AS (SELECT dayofyear(time) AS d, latitude, {agg}(precip) AS x FROM ser GROUP BY ALL)", "dy AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM pd))", "sm AS (SELECT (p + o + n) % n AS p, latitude, avg(x * w) AS x FROM pd JOIN dy USING (d) CROSS JOIN ww GROUP BY ALL)") + f"SELECT d::INTEGER AS dayofyear, latitude, {r6('1e4 * x', name)} FROM sm JOIN dy USING (p)"


@query("clim_fast_mean", _fast_sql("avg", "precip"))
def _fast_mean(spark, sf):
    return _scaled(climatology.fast(cubes.series(spark, sf), "precip", ["latitude"], "mean", WINDOW), "precip")


@query("clim_fast_std", _fast_sql("stddev_pop", "precip_std"))
def _fast_std(spark, sf):
    return _scaled(climatology.fast(cubes.series(spark, sf), "precip", ["latitude"], "std", WINDOW), "precip_std")


_WQ = """wq AS (SELECT *, sum(w) OVER c ** 2 / sum(w * w) OVER c AS n, sum(w) OVER (PARTITION BY dayofyear, latitude ORDER BY x, w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(w) OVER c AS hi, w / sum(w) OVER c AS part FROM {source} WINDOW c AS (PARTITION BY dayofyear, latitude)),
wv AS (SELECT dayofyear, latitude, q, x, (n - 1) * q + 1 AS h, n, hi, greatest(hi - part, 0) AS lo FROM wq CROSS JOIN (SELECT unnest([{q}])::DOUBLE AS q)),
wr AS (SELECT dayofyear, latitude, q, sum(x * ((greatest((h - 1) / n, least(h / n, hi)) * n - h + 1) - (greatest((h - 1) / n, least(h / n, lo)) * n - h + 1))) AS v FROM wv GROUP BY ALL)"""


@query("clim_quantile", with_ctes(["ser"], _WW, _RING, "sx AS (SELECT * FROM sp WHERE w > 0 AND x IS NOT NULL)", _WQ.format(source="sx", q="0.1, 0.5, 0.9")) + f"SELECT dayofyear::INTEGER AS dayofyear, latitude, q AS quantile, {r6('1e4 * v', 'precip_quantile')} FROM wr")
def _clim_quantile(spark, sf):
    return _scaled(climatology.quantile(cubes.series(spark, sf), "precip", ["latitude"], [0.1, 0.5, 0.9], WINDOW), "precip_quantile")


@query("clim_seeps", with_ctes(["ser"], _WW, _RING, "sx AS (SELECT * FROM sp WHERE w > 0 AND x >= 0.00025)", _WQ.format(source="sx", q=repr(2 / 3)), "dr AS (SELECT dayofyear, latitude, avg(CASE WHEN x < 0.00025 THEN 1.0 ELSE 0.0 END) AS dry FROM sp GROUP BY ALL)") + f"SELECT dayofyear::INTEGER AS dayofyear, latitude, {r6('1e4 * v', 'precip_seeps_threshold')}, {r6('dry', 'precip_seeps_dry_fraction')} FROM dr LEFT JOIN wr USING (dayofyear, latitude)")
def _clim_seeps(spark, sf):
    out = climatology.seeps(cubes.series(spark, sf), "precip", ["latitude"], window=WINDOW)
    return rounded(_scaled(out, "precip_seeps_threshold"), "precip_seeps_dry_fraction")


@query("clim_expand", with_ctes(["clim", "obs"]) + f"SELECT CAST(time AS VARCHAR) AS time, c.latitude, c.longitude, {r6('c.temperature', 'temperature')} FROM (SELECT DISTINCT time FROM obs) t JOIN clim c ON dayofyear(t.time) = c.dayofyear")
def _clim_expand(spark, sf):
    times = cubes.obs(spark, sf).select("time").distinct()
    out = climatology.expand(cubes.clim(spark, sf), times)
    return rounded(out.select(F.to_date("time").cast("string").alias("time"), *SPACE, "temperature"), "temperature")


@query("prob_climatology", with_ctes(["ser"]) + f"SELECT CAST(t.time AS VARCHAR) AS time, s.latitude, (year(s.time) - 1995)::INTEGER AS number, {r6('1e4 * s.precip', 'precip')} FROM (SELECT DISTINCT time, latitude FROM ser) t JOIN ser s ON dayofyear(t.time) = dayofyear(s.time) AND t.latitude = s.latitude")
def _prob_climatology(spark, sf):
    ser = cubes.series(spark, sf)
    out = align.probabilistic_climatology_forecast(ser.select("time", "latitude").distinct(), align.stack_years(ser, 1995), ["latitude"], "time")
    return rounded(out.select(F.to_date("time").cast("string").alias("time"), "latitude", F.col("number").cast("int").alias("number"), (F.col("precip") * 1e4).alias("precip")), "precip")


_SAMPLER = sampler.Sampler(1996, 1999, window=7, members=4, edge=sampler.WRAP_YEAR, seed=3)
_SAMPLE_TIMES = [datetime(2000, 1, 1) + timedelta(days=d) for d in range(366)]
_DAILY = """dl AS (SELECT t.time, a.latitude, coalesce(ser.precip, 0) AS precip FROM (SELECT unnest(generate_series((SELECT min(time) FROM ser)::TIMESTAMP, (SELECT max(time) FROM ser)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS time) t
  CROSS JOIN (SELECT unnest([-45.0, 45.0])::DOUBLE AS latitude) a LEFT JOIN ser ON ser.time = t.time AND ser.latitude = a.latitude)"""
_FROM_SOURCES = f"SELECT CAST(m.time AS VARCHAR) AS time, m.member::INTEGER AS member, latitude, {r6('1e4 * precip', 'precip')} FROM mp m JOIN dl ON m.source = dl.time"


def without_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """The daily series with 0 on days without orders."""
    ser = cubes.series(spark, sf)
    days = ser.agg(F.min("time").alias("a"), F.max("time").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("time"))
    return days.withColumn("latitude", F.explode(F.array(F.lit(-45.0), F.lit(45.0)))).join(ser, ["time", "latitude"], "left").fillna(0.0, ["precip"])


def _sampled_rows(spark: SparkSession, sf: str, by: sampler.Sampler) -> DataFrame:
    out = sampler.sampled_forecast(without_gaps(spark, sf), by, _SAMPLE_TIMES, [0])
    return rounded(out.select(F.to_date("time").cast("string").alias("time"), "member", "latitude", (F.col("precip") * 1e4).alias("precip")), "precip")


def _sampler_sql() -> str:
    rows = [(t, m, s) for t, ss in zip(_SAMPLE_TIMES, _SAMPLER.source_times(_SAMPLE_TIMES), strict=True) for m, s in enumerate(ss)]
    values = ", ".join(f"(DATE '{t:%Y-%m-%d}', {m}, DATE '{s:%Y-%m-%d}')" for t, m, s in rows)
    return with_ctes(["ser"], f"mp(time, member, source) AS (VALUES {values})", _DAILY) + _FROM_SOURCES


@query("sampled_climatology", _sampler_sql())
def _sampled(spark, sf):
    return _sampled_rows(spark, sf, _SAMPLER)


_COMBINATIONS = """mp AS (SELECT t.time, (y - 1996) * 7 + o + 3 AS member, (make_date(y, 1, 1) + ((dayofyear(t.time) + o - 1 + dayofyear(make_date(y, 12, 31))) % dayofyear(make_date(y, 12, 31)))::INTEGER) AS source
  FROM (SELECT unnest(generate_series(TIMESTAMP '2000-01-01', TIMESTAMP '2000-12-31', INTERVAL 1 DAY))::DATE AS time) t CROSS JOIN (SELECT unnest(range(1996, 2000)) AS y) CROSS JOIN (SELECT unnest(range(-3, 4)) AS o))"""


@query("sampled_combinations", with_ctes(["ser"], _COMBINATIONS, _DAILY) + _FROM_SOURCES)
def _combinations(spark, sf):
    """Every pair of a year and a day of the window as a member."""
    return _sampled_rows(spark, sf, sampler.Sampler(1996, 1999, window=7, replace=False, edge=sampler.WRAP_YEAR))


def _counter_sql(rows: str, seed: int, counters: Sequence[str], name: str) -> str:
    """rows with a column `name`, the sampler's counter: four rounds, each a query of its own."""
    start = f"SELECT *, ({seed * 1000003}::BIGINT + " + " + ".join(f"(({c})::BIGINT % 2147483647) * {w}" for w, c in zip((7919, 104729, 15485863), counters, strict=True)) + f") % 2147483647 AS {name} FROM ({rows})"
    for _ in range(4):
        start = f"SELECT * REPLACE (({name} * {name} % 2147483647 + {name} * 48271 + 12345) % 2147483647 AS {name}) FROM ({start})"
    return start


_TIMES = "SELECT time, (epoch(time::TIMESTAMP) // 3600)::BIGINT AS h FROM (SELECT DISTINCT time FROM ser)"
_SOURCE = "(make_date(y, 1, 1) + ((dayofyear(time) + o - 1 + dayofyear(make_date(y, 12, 31))) % dayofyear(make_date(y, 12, 31)))::INTEGER)"
# of 1996 to 1999 without a time's own year and the next
_LEFT = "list_filter([1996, 1997, 1998, 1999], lambda v: v < year(time) OR v > year(time) + 1)"
_DRAWN = _counter_sql(_counter_sql(f"SELECT *, unnest(range(0, 5)) AS member FROM ({_TIMES})", 11, ["h", "member", "1"], "a"), 11, ["h", "member", "2"], "b")
_MIXED = _counter_sql(f"SELECT *, unnest(range(0, 7 * len({_LEFT}))) AS c FROM ({_TIMES})", 11, ["h", "c", "3"], "a")


@query("sampled_counters", with_ctes(["ser"], f"mp AS (SELECT time, member, {_SOURCE} AS source FROM (SELECT time, member, {_LEFT}[a % len({_LEFT}) + 1] AS y, b % 7 - 3 AS o FROM ({_DRAWN})))", _DAILY) + _FROM_SOURCES)
def _counters(spark, sf):
    """Five members with replacement for every time of the series, drawn in Spark; SQL restates the draw."""
    return _drawn_rows(spark, sf, sampler.Sampler(1996, 1999, window=7, members=5, leave_out_years=1, seed=11))


@query("sampled_order", with_ctes(["ser"], f"mp AS (SELECT time, member, {_SOURCE} AS source FROM (SELECT time, row_number() OVER (PARTITION BY time ORDER BY a, c) - 1 AS member, {_LEFT}[c // 7 + 1] AS y, c % 7 - 3 AS o FROM ({_MIXED})) WHERE member < 5)", _DAILY) + _FROM_SOURCES)
def _sampled_order(spark, sf):
    """Five of a time's combinations without replacement."""
    return _drawn_rows(spark, sf, sampler.Sampler(1996, 1999, window=7, members=5, replace=False, leave_out_years=1, seed=11))


def _drawn_rows(spark: SparkSession, sf: str, by: sampler.Sampler) -> DataFrame:
    out = sampler.drawn_forecast(without_gaps(spark, sf), by, cubes.series(spark, sf).select("time"), [0])
    return rounded(out.select(F.to_date("time").cast("string").alias("time"), "member", "latitude", (F.col("precip") * 1e4).alias("precip")), "precip")


# ---- scattered points

_HASHED = "((event_id * 7919 % 100003) / 100003.0 * 180 - 90) AS latitude, ((event_id * 104729 % 99991) / 99991.0 * 360) AS longitude"
_PART = "((p_partkey * 48271 % 65537) / 65537.0 * 180 - 90) AS latitude, ((p_partkey * 69621 % 65521) / 65521.0 * 360) AS longitude"
_XYZ = "cos(radians(latitude)) * cos(radians(longitude)) AS x, cos(radians(latitude)) * sin(radians(longitude)) AS y, sin(radians(latitude)) AS z"


@query(
    "nearest_station",
    f"""WITH e AS (SELECT event_id, {_XYZ} FROM (SELECT event_id, {_HASHED} FROM events)), p AS (SELECT p_partkey, latitude, longitude, {_XYZ} FROM (SELECT p_partkey, {_PART} FROM part)),
d AS (SELECT event_id, p_partkey, latitude, longitude, sqrt((e.x - p.x) ** 2 + (e.y - p.y) ** 2 + (e.z - p.z) ** 2) AS c FROM e CROSS JOIN p),
m AS (SELECT event_id, arg_min(p_partkey, (round(c, 9), latitude, longitude)) AS station, min(c) AS c FROM d GROUP BY event_id)
SELECT event_id, station, round(2 * 6371 * asin(c / 2), 3) AS km FROM m""",
)
def _nearest_station(spark, sf):
    """The nearest of as many stations as there are parts for every event."""
    events = cubes.table(spark, sf, "events").select("event_id", *(F.expr(x) for x in _HASHED.replace("/ 100003.0", "/ 100003D").replace("/ 99991.0", "/ 99991D").split(", ")))
    stations = cubes.table(spark, sf, "part").select("p_partkey", *(F.expr(x) for x in _PART.replace("/ 65537.0", "/ 65537D").replace("/ 65521.0", "/ 65521D").split(", ")))
    out = nearest.nearest(events, stations)
    return out.select("event_id", F.col("p_partkey_near").alias("station"), F.round(F.col("distance") / 1000, 3).alias("km"))


# ---- averages, quantiles, resampling, selection


@query("averages_weighted", with_ctes(["obs", "latw"]) + f"SELECT longitude, {r6(strict_sql('avg(temperature * w)', 'temperature'), 'temperature')} FROM obs JOIN latw USING (latitude) GROUP BY ALL")
def _averages(spark, sf):
    return rounded(reduce.averages(cubes.obs(spark, sf), ["temperature"], ["time", "latitude"], ["time", *SPACE]), "temperature")


@query("ensemble_mean", with_ctes(["ens"]) + f"SELECT CAST(init_time AS VARCHAR) AS init_time, lead_hours, latitude, longitude, {r6('avg(temperature)', 'temperature')} FROM ens GROUP BY ALL")
def _ensemble_mean(spark, sf):
    out = reduce.ensemble_mean(cubes.ens(spark, sf), ["temperature"], ["init_time", "lead_hours", "member", *SPACE], skipna=True)
    return rounded(out.withColumn("init_time", F.to_date("init_time").cast("string")), "temperature")


@query("quantiles", with_ctes(["obs"]) + f"SELECT latitude, quantile, {r6('CASE quantile WHEN 0.2 THEN q[1] WHEN 0.5 THEN q[2] ELSE q[3] END', 'temperature_quantile')} FROM (SELECT latitude, quantile_cont(temperature, [0.2, 0.5, 0.8]) AS q FROM obs GROUP BY ALL) CROSS JOIN (SELECT unnest([0.2, 0.5, 0.8])::DOUBLE AS quantile)")
def _quantiles(spark, sf):
    out = reduce.quantiles(cubes.obs(spark, sf), ["temperature"], ["time", "longitude"], ["time", *SPACE], [0.2, 0.5, 0.8], skipna=True, suffix="_quantile")
    return rounded(out, "temperature_quantile")


@query("moments", with_ctes(["ens"], "pt AS (SELECT lead_hours, init_time, avg((temperature IS NOT NULL)::INT) AS a, avg(temperature) AS b, avg(temperature * temperature) AS c FROM ens GROUP BY ALL)") + f"SELECT lead_hours, {r6('avg(a)', 'temperature_zeroth')}, {r6('avg(b)', 'temperature_first')}, {r6('avg(c)', 'temperature_second')} FROM pt GROUP BY ALL")
def _moments(spark, sf):
    return rounded(reduce.moments(cubes.ens(spark, sf), "temperature", ["lead_hours"], "init_time"))


def _resample_sql(side: str) -> str:
    bucket = "floor(n / 3)" if side == "left" else "ceil(n / 3)"
    last = "floor(mx / 3)" if side == "left" else "ceil(mx / 3)"
    first = 0 if side == "left" else 1
    return with_ctes(["ser"], "mm AS (SELECT min(time) AS t0, max(time) - min(time) AS mx FROM ser)", f"bk AS (SELECT latitude, ({bucket})::BIGINT AS b, avg(precip) AS x, max(precip) AS y FROM (SELECT latitude, precip, (time - t0)::DOUBLE AS n FROM ser CROSS JOIN mm) GROUP BY ALL)", f"gd AS (SELECT latitude, b FROM (SELECT DISTINCT latitude FROM bk WHERE b >= {first}) CROSS JOIN (SELECT unnest(range({first}, ({last})::BIGINT + 1)) AS b FROM mm))") + f"SELECT latitude, CAST(t0 + (b * 3)::INTEGER AS VARCHAR) AS time, {r6('1e4 * x', 'precip')} FROM gd LEFT JOIN bk USING (latitude, b) CROSS JOIN mm"


def _resampled(side: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = windows.resample(cubes.series(spark, sf), {"precip": "mean"}, ["latitude"], 72, side)
        return rounded(out.select("latitude", F.to_date("time").cast("string").alias("time"), (F.col("precip") * 1e4).alias("precip")), "precip")

    return run


query("resample_left", _resample_sql("left"))(_resampled("left"))
query("resample_right", _resample_sql("right"))(_resampled("right"))


def _rolling_sql(side: str, how: str = "avg", k: int = 3) -> str:
    shift = 1 - k if side == "left" else 1
    w = f"(PARTITION BY latitude, longitude ORDER BY time ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return with_ctes(["obs"]) + f"SELECT latitude, longitude, CAST(time + ({shift}) AS VARCHAR) AS time, {r6(f'CASE WHEN count(temperature) OVER {w} = {k} THEN {how}(temperature) OVER {w} END', 'temperature')} FROM obs"


def _rolled(side: str, weekly: bool = False):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        o = cubes.obs(spark, sf)
        out = windows.weekly(o, "temperature", SPACE) if weekly else windows.rolling_labelled(o, "temperature", SPACE, 72, 24, "mean", side)
        return rounded(out.select(*SPACE, F.to_date("time").cast("string").alias("time"), "temperature"), "temperature")

    return run


query("rolling_left", _rolling_sql("left"))(_rolled("left"))
query("rolling_right", _rolling_sql("right"))(_rolled("right"))
query("resample_daily_weekly_roll", _rolling_sql("left", k=7))(_rolled("left", True))

_VALID = "vt AS (SELECT valid_time AS time, lead_hours, latitude, longitude, temperature::FLOAT AS x FROM det), gd AS (SELECT time, lead_hours, latitude, longitude FROM (SELECT DISTINCT time FROM vt) CROSS JOIN (SELECT DISTINCT lead_hours FROM vt) CROSS JOIN (SELECT DISTINCT latitude, longitude FROM vt))"


@query("valid_time_delta", with_ctes(["det"], _VALID) + "SELECT CAST(time AS VARCHAR) AS time, lead_hours, latitude, longitude, round(x::DOUBLE, 3) + 0.0::DOUBLE AS temperature FROM gd LEFT JOIN vt USING (time, lead_hours, latitude, longitude)")
def _valid_delta(spark, sf):
    out = align.index_on_valid_time(cubes.det(spark, sf), CELL, 24, ["temperature"])
    return out.select(F.to_date("time").cast("string").alias("time"), "lead_hours", *SPACE, (F.round(F.col("temperature").cast("double"), 3) + 0.0).alias("temperature"))


@query("valid_time_init", with_ctes(["det"]) + f"SELECT CAST(init_time AS VARCHAR) AS init_time, CAST(valid_time AS VARCHAR) AS time, latitude, longitude, {r6('temperature', 'temperature')} FROM det")
def _valid_init(spark, sf):
    out = align.valid_and_init(cubes.det(spark, sf))
    return rounded(out.select(F.to_date("init_time").cast("string").alias("init_time"), F.to_date("time").cast("string").alias("time"), *SPACE, "temperature"), "temperature")


@query("slice_isel_step", with_ctes(["obs"], "od AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM (SELECT DISTINCT time FROM obs))") + f"SELECT CAST(time AS VARCHAR) AS time, latitude, longitude, {r6('temperature', 'temperature')} FROM obs JOIN od USING (time) WHERE i >= 2 AND i < 20 AND (i - 2) % 4 = 0 AND latitude IN (-20, 20)")
def _slice(spark, sf):
    out = select.apply_flags(cubes.obs(spark, sf), isel="time_start=2,time_stop=20,time_step=4", sel="latitude_list=-20.0+20.0")
    return rounded(out.select(F.to_date("time").cast("string").alias("time"), *SPACE, "temperature"), "temperature")


@query("drop_labels", with_ctes(["obs"], "od AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM (SELECT DISTINCT time FROM obs))") + f"SELECT CAST(time AS VARCHAR) AS time, latitude, longitude, {r6('temperature', 'temperature')} FROM obs JOIN od USING (time) WHERE i NOT IN (0, 3) AND longitude NOT IN (120)")
def _drop(spark, sf):
    out = select.apply_flags(cubes.obs(spark, sf), drop_isel="time_list=0+3", drop_sel="longitude_list=120.0")
    return rounded(out.select(F.to_date("time").cast("string").alias("time"), *SPACE, "temperature"), "temperature")


@query("label_range", with_ctes(["ser"]) + f"SELECT CAST(time AS VARCHAR) AS time, latitude, {r6('1e4 * precip', 'precip')} FROM ser WHERE time BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'")
def _label_range(spark, sf):
    out = select.label_range(cubes.series(spark, sf), "time", "1997", "1998-06")
    return rounded(out.select(F.to_date("time").cast("string").alias("time"), "latitude", (F.col("precip") * 1e4).alias("precip")), "precip")


@query("level_suffix_decode", with_ctes(["col"]) + f"SELECT level, latitude, longitude, {r6('temperature', 'temperature')}, {r6('u', 'u')} FROM col WHERE level IN (500, 850)")
def _decode(spark, sf):
    c = cubes.column(spark, sf)
    pick = lambda v, level: F.max(F.when(F.col("level") == level, F.col(v))).alias(f"{v}_{level}")
    wide = c.groupBy(*SPACE).agg(*(pick(v, level) for v in ("temperature", "u") for level in (500, 850)))
    return rounded(select.decode_levels(wide, SPACE).select("level", *SPACE, "temperature", "u"), "temperature", "u")


@query("thin_time", with_ctes(["obs"], "od AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM (SELECT DISTINCT time FROM obs))") + f"SELECT CAST(time AS VARCHAR) AS time, latitude, longitude, {r6('temperature', 'temperature')} FROM obs JOIN od USING (time) WHERE i % 5 = 0")
def _thin(spark, sf):
    out = select.thin(cubes.obs(spark, sf), "time", 5)
    return rounded(out.select(F.to_date("time").cast("string").alias("time"), *SPACE, "temperature"), "temperature")


@query("hour_filter", f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS time, {r6('avg(value)', 'value')} FROM events WHERE hour(ts) = 6 GROUP BY 1")
def _hour(spark, sf):
    e = cubes.table(spark, sf, "events").select(F.col("ts").alias("time"), "value")
    return rounded(select.at_hour(e, 6).groupBy(F.to_date("time").cast("string").alias("time")).agg(F.avg("value").alias("value")), "value")


# ---- results

_RESULT = score_sql({"mse": f"({_E}) ** 2", "mae": f"abs({_E})"}, {"mse": "mse", "mae": "mae"})


def _results(spark: SparkSession, sf: str, climatology_: bool = False) -> DataFrame:
    frame = pairs(spark, sf)
    if climatology_:
        frame = frame.withColumn("temperature", F.col("temperature_c"))
    return ev.evaluate_frame(frame, ev.Eval(("mse", "mae"), tuple(named(*REGIONS))), ["temperature"], latitudes=cubes.LATITUDES)


@query("evaluate_deterministic", "WITH r AS (" + _RESULT + ") SELECT 'mse' AS metric, region, lead_hours, mse AS temperature FROM r UNION ALL SELECT 'mae', region, lead_hours, mae FROM r")
def _evaluate(spark, sf):
    return rounded(_results(spark, sf).select("metric", "region", "lead_hours", "temperature"), "temperature")


_TWO = score_sql({"a": f"({_E}) ** 2", "b": "(temperature_c - temperature_t) ** 2"}, {"a": "a", "b": "b"}).replace("round(", "(").replace(", 6) + 0.0::DOUBLE", ")")


@query("relative_skill", "WITH r AS (" + _TWO + f") SELECT region, lead_hours, 'mse' AS metric, {r6('CASE WHEN b <> 0 THEN (a - b) / b * 100 END', 'relative_percent')} FROM r WHERE lead_hours > 0")
def _relative(spark, sf):
    out = ev.relative_skill(_results(spark, sf), _results(spark, sf, True), "temperature", ["region", "lead_hours"]).where("metric = 'mse'")
    return rounded(out, "relative_percent")


_RATIO = score_sql({"v": "var", "m": "(truth - mean) ** 2"}, {"v": "v", "m": "m"}, frame="cells", cte=("cells",)).replace("round(", "(").replace(", 6) + 0.0::DOUBLE", ")")


@query("spread_skill_ratio", "WITH r AS (" + _RATIO + f") SELECT region, lead_hours, {r6('CASE WHEN m <> 0 THEN sqrt(v) / sqrt(m) END', 'spread_skill_ratio')} FROM r")
def _ratio(spark, sf):
    config = ev.Eval(("ensemble_variance", "ensemble_mean_mse"), tuple(named(*REGIONS)))
    results = ev.evaluate_frame(ensemble_pairs(spark, sf), config, ["temperature"], latitudes=cubes.LATITUDES)
    return rounded(ev.spread_skill_ratio(results, "temperature", ["region", "lead_hours"]), "spread_skill_ratio")


# ---- the predefined configurations, from files, with two variables, a wind vector and a land region

U, V = "u_component_of_wind", "v_component_of_wind"
_LAND = "tropics_land"
_BOXED = " JOIN boxes ON f.latitude BETWEEN south AND north AND f.longitude BETWEEN west AND east"


def config_files(spark: SparkSession, sf: str) -> dict[str, str]:
    """Forecast, ensemble, truth and climatology as Parquet cubes: u is the temperature of the test cubes, v is 2 u + latitude."""
    v = lambda x: 2 * F.col(x) + F.col("latitude")
    two = lambda df: df.withColumns({U: F.col("temperature"), V: v("temperature")})
    det = two(cubes.det(spark, sf)).withColumns({f"{U}_std": F.col("temperature_std"), f"{V}_std": 2 * F.col("temperature_std")})
    quantiles = threshold_climatology(spark, sf).withColumns({f"{U}_quantile": F.col("temperature_quantile"), f"{V}_quantile": v("temperature_quantile")})
    clim = two(cubes.clim(spark, sf)).unionByName(quantiles.drop("temperature_quantile"), allowMissingColumns=True)
    frames = {
        "det": det.withColumnRenamed("init_time", "time").drop("valid_time", "temperature", "temperature_std"),
        "ens": two(cubes.ens(spark, sf)).withColumnRenamed("init_time", "time").drop("valid_time", "temperature"),
        "truth": two(cubes.obs(spark, sf)).drop("temperature").withColumn("land_sea_mask", F.col("longitude") / 240),
        "clim": clim.drop("temperature"),
    }
    paths = {k: io.scratch(spark, f"cube-{k}") for k in frames}
    for k, df in frames.items():
        io.write_cube(df, paths[k])
        io.remove_at_exit(spark, paths[k])
    return paths


def _land_sql(sql: str) -> str:
    """A score's SQL with the land region, whose cells weigh longitude / 240."""
    sql = sql.replace("AS (VALUES ", f"AS (VALUES ('{_LAND}', -20::DOUBLE, 20::DOUBLE, 0::DOUBLE, 360::DOUBLE), ").replace(_BOXED, f"{_BOXED} AND (region <> '{_LAND}' OR f.longitude > 0)")
    return sql.replace("init_time, w, ", f"init_time, w * CASE WHEN region = '{_LAND}' THEN f.longitude / 240 ELSE 1 END AS w, ", 1)


def _metric_sql(metric: str, sql: str, keys: Sequence[str], value: str, factor: str | None = None, wind: bool = False) -> str:
    """Rows of one metric: the same SQL over u and over v. factor: of the wind vector's error to that of u."""
    other = sql.replace("avg(value) AS temperature", "2 * avg(value) + any_value(latitude) AS temperature")
    vector = f", {f'round(a.{value} * {factor}, 5)' if factor else 'NULL'}::DOUBLE AS wind_vector" if wind else ""
    return f"SELECT '{metric}' AS metric, {', '.join(keys)}, round(a.{value}, 5) AS {U}, round(b.{value}, 5) AS {V}{vector} FROM ({sql}) a JOIN ({other}) b USING ({', '.join(keys)})"


def _config(name: str, forecast: str, parts: list[str], keys: Sequence[str]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        paths = config_files(spark, sf)
        # the last lead times reach beyond the truth, as the SQL's joins have it
        data = ev.Data(ev.Selection((U, V)), paths[forecast], paths["truth"], paths["clim"], on_missing="skip")
        chosen = ev.named_configs((*REGIONS, _LAND), Q)[name]
        out = ev.evaluate(spark, data, {name: chosen})[name]
        if "init_time" in out.columns:
            out = out.withColumn("init_time", F.col("init_time").cast("date").cast("string"))
        values = [c for c in out.columns if c in (U, V, "wind_vector")]
        return out.select("metric", *keys, *(F.round(F.col(c).cast("double"), 5).alias(c) for c in values))

    query(f"config_{name}", " UNION ALL ".join(parts))(run)


def _whole(sql: str) -> str:
    """A score's SQL without rounding, so that both variables are rounded alike afterwards."""
    return sql.replace("round((", "((").replace(")::DOUBLE, 6) + 0.0::DOUBLE", ")::DOUBLE)")


_RK, _TK = ["region", "lead_hours"], ["region", "lead_hours", "init_time"]
_DET_SQL = {"mse": ({"x": f"({_E}) ** 2"}, "x"), "acc": ({"ft": f"{_F} * {_T}", "ff": f"{_F} * {_F}", "tt": f"{_T} * {_T}"}, "CASE WHEN sqrt(ff * tt) <> 0 THEN ft / sqrt(ff * tt) END"), "bias": ({"x": _E}, "x"), "mae": ({"x": f"abs({_E})"}, "x")}


def _det_parts(metrics: dict, keys: Sequence[str], frame: str = "pairs", **kw) -> list[str]:
    factor = {"mse": "5", "rmse_sqrt_before_time_avg": "sqrt(5.0)"}
    return [_metric_sql(m, _land_sql(_whole(score_sql(points, {"y": value}, frame=frame, **kw))), keys, "y", factor.get(m), True) for m, (points, value) in metrics.items()]


_config("deterministic", "det", _det_parts(_DET_SQL, _RK), _RK)
_config("deterministic_temporal", "det", _det_parts(_DET_SQL | {"rmse_sqrt_before_time_avg": ({"x": f"({_E}) ** 2"}, "sqrt(x)")}, _TK, over_time=False), _TK)
_AP = "apairs AS (SELECT d.*, o.temperature AS temperature_t, c.temperature AS temperature_c FROM det d JOIN det o ON o.lead_hours = 0 AND d.valid_time = o.init_time AND d.latitude = o.latitude AND d.longitude = o.longitude JOIN clim c ON dayofyear(d.valid_time) = c.dayofyear AND d.latitude = c.latitude AND d.longitude = c.longitude)"
_config("deterministic_vs_analysis", "det", _det_parts(_DET_SQL, _RK, "apairs", cte=("det", "clim"), extra=[_AP]), _RK)
_SK = ["lead_hours", *SPACE]
_cell_sql = lambda point, cte, keys=_SK, extra=(): with_ctes(list(cte), *extra) + f"SELECT {', '.join(keys)}, {strict_sql(f'avg({point})', f'({point})')} AS y FROM "
_config("deterministic_spatial", "det", [_metric_sql(f"spatial_{m}", _cell_sql(p, ["pairs"]) + "pairs GROUP BY ALL", _SK, "y") for m, p in (("bias", _E), ("mse", f"({_E}) ** 2"), ("mae", f"abs({_E})"))], _SK)
_ENS_SQL = {"crps": "crps_skill - crps_spread / 2", "crps_spread": "crps_spread", "crps_skill": "crps_skill", "ensemble_mean_mse": "(truth - mean) ** 2", "debiased_ensemble_mean_mse": "(truth - mean) ** 2 - var / n", "ensemble_variance": "var"}
_config("probabilistic", "ens", [_metric_sql(m, _land_sql(_whole(score_sql({"x": p}, {"y": "x"}, frame="cells", cte=("cells",)))), _RK, "y") for m, p in _ENS_SQL.items()], _RK)
_config("probabilistic_spatial", "ens", [_metric_sql(f"spatial_{m}", _cell_sql(p, ["cells"]) + "cells GROUP BY ALL", _SK, "y") for m, p in _ENS_SQL.items()], _SK)
_energy_part = lambda m, x: _metric_sql(m, with_ctes(["epairs", "latw"], _ENERGY) + f"SELECT lead_hours, {strict_sql(f'avg({x})', x)} AS y FROM s1 JOIN s2 USING (lead_hours, init_time) GROUP BY ALL", ["lead_hours"], "y")
_root_part = lambda m, p: _metric_sql(m, _whole(score_sql({"x": p}, {"y": "sqrt(x)"}, frame="cells", cte=("cells",), regions=False)), ["lead_hours"], "y")
_config("ensemble_forecast_vs_era_experimental_metrics", "ens", [_energy_part("energy_score", "skill - spread / 2"), _energy_part("energy_skill", "skill"), _energy_part("energy_spread", "spread"), _root_part("ensemble_mean_rmse_sqrt_before_time_avg", "(truth - mean) ** 2"), _root_part("ensemble_stddev_sqrt_before_time_avg", "var")], ["lead_hours"])
_BIN_SQL = {"brier": "(p - above) ** 2", "debiased_brier": "(p - above) ** 2 - p_var / n", "ignorance": "CASE WHEN above = 1 THEN CASE WHEN p_some > 0 THEN -ln(p_some) ELSE 'inf'::DOUBLE END WHEN above = 0 THEN CASE WHEN p_some < 1 THEN -ln(1 - p_some) ELSE 'inf'::DOUBLE END END"}
_QK = ["region", "lead_hours", "quantile"]
_over = lambda point, frame, cte, extra, keys: _land_sql(_whole(score_sql({"x": point}, {"y": "x"}, frame=frame, cte=cte, extra=extra, by=tuple(keys[1:]))))
_config("ensemble_binary", "ens", [_metric_sql(m, _over(p, "ex", ("epairs",), [_THRESHOLDS, _EX], _QK), _QK, "y") for m, p in _BIN_SQL.items()] + [
    _metric_sql("rps", _land_sql(_whole(score_sql({"x": "(below_some - truth_below) ** 2"}, {"y": "x"}, frame="ex", cte=("epairs",), extra=[_THRESHOLDS, _EX], by=("lead_hours", "quantile"), over_time=False))).replace("SELECT region, lead_hours, quantile, CAST(init_time", "SELECT region, lead_hours, NULL::DOUBLE AS quantile, avg(s) AS y FROM (SELECT region, lead_hours, init_time, sum(coalesce(y, 0)) AS s FROM (SELECT region, lead_hours, quantile, CAST(init_time") + ") GROUP BY ALL) GROUP BY ALL", ["region", "lead_hours"], "y").replace("'rps' AS metric, region, lead_hours,", "'rps' AS metric, region, lead_hours, NULL::DOUBLE AS quantile,")], _QK)
_SQK = [*_SK, "quantile"]
_config("ensemble_binary_spatial", "ens", [_metric_sql(f"spatial_{m}", _cell_sql(p, ["epairs"], _SQK, [_THRESHOLDS, _EX]) + "ex GROUP BY ALL", _SQK, "y") for m, p in _BIN_SQL.items()], _SQK)
_HK = [*_SK, "bin"]
_config("probabilistic_spatial_histograms", "ens", [_metric_sql("rank_histogram", with_ctes(["epairs"], _HIST.split(",\ncn AS")[0]) + "SELECT lead_hours, latitude, longitude, bin, avg((rank = bin)::INT) AS y FROM rk CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5])::INTEGER AS bin) GROUP BY ALL", _HK, "y")], _HK)
# the spread of v is twice that of u, so standardised errors agree
_config("gaussian_probabilistic", "det", [_metric_sql("gaussian_crps", _land_sql(_whole(score_sql({"x": f"temperature_std * ({_Z} * (2 * {norm_cdf_sql(_Z)} - 1) + 2 * exp(-{_Z} * {_Z} / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))"}, {"y": "x"}))), _RK, "y"), _metric_sql("gaussian_variance", _land_sql(_whole(score_sql({"x": "temperature_std ** 2"}, {"y": "x"}))), _RK, "y")], _RK)
_GB_SQL = {"gaussian_brier": "((1 - below) - (temperature_t > threshold)::INT) ** 2", "gaussian_ignorance": "CASE WHEN below IS NULL THEN NULL WHEN temperature_t > threshold THEN CASE WHEN 1 - below > 0 THEN -ln(1 - below) ELSE 'inf'::DOUBLE END ELSE CASE WHEN below > 0 THEN -ln(below) ELSE 'inf'::DOUBLE END END"}
_config("gaussian_binary", "det", [_metric_sql(m, _over(p, "gt", ("pairs",), [_THRESHOLDS, _GT], _QK), _QK, "y") for m, p in _GB_SQL.items()], _QK)


# ---- the same through Zarr stores

#: A day's cells in two chunks of latitude.
_CHUNKS = {"time": 16, "latitude": 2}


def store(spark: SparkSession, name: str, df: DataFrame, chunks: dict[str, int]) -> str:
    path = io.scratch(spark, name) + ".zarr"
    io.write_cube(df, path, chunks=chunks)
    io.remove_at_exit(spark, path)
    return path


@query("zarr_scan", with_ctes(["obs"]) + f"SELECT CAST(time AS VARCHAR) AS time, latitude, longitude, {r6('temperature', 'temperature')} FROM obs WHERE latitude > 0 AND longitude IN (0, 240) AND time >= (SELECT min(time) + 10 FROM obs)")
def _zarr_scan(spark, sf):
    cube = cubes.obs(spark, sf)
    path = store(spark, "obs", cube, _CHUNKS)
    first = cube.agg(F.min("time")).first()[0]
    out = io.read_cube(spark, path, ["temperature"]).where((F.col("latitude") > 0) & F.col("longitude").isin(0.0, 240.0) & (F.col("time") >= F.lit(first + timedelta(days=10))))
    return rounded(out.select(F.to_date("time").cast("string").alias("time"), *SPACE, "temperature"), "temperature")


@query("zarr_evaluate", ORACLE_SQL["config_deterministic_spatial"])
def _zarr_evaluate(spark, sf):
    """Forecast and truth are stores, and so is the result, which is read again."""
    paths = config_files(spark, sf)
    at = {k: store(spark, k, spark.read.parquet(paths[k]).drop("land_sea_mask", f"{U}_std", f"{V}_std"), _CHUNKS) for k in ("det", "truth")}
    data = ev.Data(ev.Selection((U, V)), at["det"], at["truth"], on_missing="skip")
    name, out = "deterministic_spatial", io.scratch(spark, "results")
    ev.evaluate(spark, data, {name: replace(ev.named_configs()[name], fmt="zarr")}, out)
    io.remove_at_exit(spark, out)
    return zarr.read_zarr(spark, f"{out}/{name}.zarr").select("metric", *_SK, *(F.round(F.nanvl(c, F.lit(None)), 5).alias(c) for c in (U, V)))


@query("zarr_rechunk", with_ctes(["obs"]) + f"SELECT CAST(time AS VARCHAR) AS time, latitude, longitude, {r6('temperature', 'temperature')} FROM obs WHERE latitude = 20 AND longitude > 100")
def _zarr_rechunk(spark, sf):
    """From chunks of some days to chunks of one series each."""
    days = store(spark, "obs", cubes.obs(spark, sf), _CHUNKS)
    series = io.scratch(spark, "series") + ".zarr"
    layout.rechunk(spark, days, series, {"latitude": 1, "longitude": 1})
    io.remove_at_exit(spark, series)
    out = io.read_cube(spark, series, ["temperature"]).where((F.col("latitude") == 20.0) & (F.col("longitude") > 100.0))
    return rounded(out.select(F.to_date("time").cast("string").alias("time"), *SPACE, "temperature"), "temperature")


@query("netcdf_result", ORACLE_SQL["spatial_mse"])
def _netcdf_result(spark, sf):
    """A result as a netCDF file, read again by ranges of its records."""
    result = QUERIES["spatial_mse"](spark, sf)
    path = io.scratch(spark, "result") + ".nc"
    io.write_cube(result, path)
    io.remove_at_exit(spark, path)
    out = io.read_cube(spark, path)
    return out.select(F.col("lead_hours").cast("long").alias("lead_hours"), *SPACE, "mse", "mae", "bias")


# ---- functions of arrays


def _smooth(x: np.ndarray) -> np.ndarray:
    return (np.roll(x, 1) + 2 * x + np.roll(x, -1)) / 4


_RING = "lag(temperature, 1, last) OVER r + 2 * temperature + lead(temperature, 1, first) OVER r"


@query("ufunc_smooth", with_ctes(["obs"], "ends AS (SELECT *, first_value(temperature) OVER w AS first, last_value(temperature) OVER w AS last FROM obs WINDOW w AS (PARTITION BY time, latitude ORDER BY longitude ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))") + f"SELECT CAST(time AS VARCHAR) AS time, latitude, longitude, {r6(f'({_RING}) / 4', 'smooth')} FROM ends WINDOW r AS (PARTITION BY time, latitude ORDER BY longitude)")
def _ufunc_smooth(spark, sf):
    """Each parallel smoothed around the globe by one call of numpy."""
    out = ufunc.apply_ufunc(cubes.obs(spark, sf), _smooth, "(longitude)->(longitude)", ["temperature"], ["smooth"], ["time", *SPACE])
    return rounded(out.select(F.to_date("time").cast("string").alias("time"), *SPACE, "smooth"), "smooth")


@query("ufunc_fit", with_ctes(["wav"]) + f"SELECT vec_id, 1::BIGINT AS degree, {r6('regr_slope(x, longitude)', 'c')} FROM wav GROUP BY vec_id UNION ALL SELECT vec_id, 0, {r6('regr_intercept(x, longitude)', 'c')} FROM wav GROUP BY vec_id")
def _ufunc_fit(spark, sf):
    """A straight line through every zonal line, by least squares."""
    waves = cubes.wave(spark, sf).drop("latitude")
    fit = lambda x, lon: np.polyfit(lon, x, 1)
    out = ufunc.apply_ufunc(waves.withColumn("lon", F.col("longitude")), fit, "(longitude),(longitude)->(degree)", ["x", "lon"], ["c"], ["vec_id", "longitude"], {"degree": [1, 0]})
    return rounded(out.select("vec_id", "degree", "c"), "c")


# ---- running scores


_REPORTS = """WITH reports AS (SELECT user_id % 16 AS site, date_trunc('hour', ts) AS t, CASE WHEN event_type IN ('click', 'view') THEN 'forecast' ELSE 'observed' END AS side, event_id, CAST(round(value / 0.01) AS BIGINT) AS u FROM events),
newest AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY site, t, side ORDER BY event_id DESC, u DESC) = 1),
pairs AS (SELECT f.site, CAST(CAST(f.t AS DATE) AS VARCHAR) AS day, f.u - o.u AS e FROM newest f JOIN newest o ON f.site = o.site AND f.t = o.t AND f.side = 'forecast' AND o.side = 'observed')
"""


@query("running_scores", _REPORTS + f"SELECT site, day, count(*) AS n, {r6('CAST(sum(e * e) AS DOUBLE) / count(*) * 0.0001', 'mse')}, {r6('CAST(sum(abs(e)) AS DOUBLE) / count(*) * 0.01', 'mae')}, {r6('CAST(sum(e) AS DOUBLE) / count(*) * 0.01', 'bias')} FROM pairs GROUP BY site, day")
def _running_scores(spark, sf):
    """All events arrive as reports in micro-batches, newest and outdated ones mixed; the SQL looks at the newest reports at once."""
    events = cubes.table(spark, sf, "events")
    side = F.when(F.col("event_type").isin("click", "view"), "forecast").otherwise("observed")
    reports = events.select((F.col("user_id") % 16).alias("site"), F.date_trunc("hour", "ts").cast(events.schema["ts"].dataType).alias("valid_time"), side.alias("side"), F.col("event_id").alias("version"), "value")
    changes = running.replay(spark, reports, "value", ["site"], 0.01)
    return rounded(running.scores(changes, ["site", F.to_date("valid_time").cast("string").alias("day")], 0.01), "mse", "mae", "bias")


@query("extra_tropical_mask", score_sql({"mse": f"({_E}) ** 2"}, {"mse": "mse"}).replace("SELECT region, lead_hours, round", "SELECT 'extra-tropics' AS region, lead_hours, round").replace("FROM vals GROUP BY ALL", "FROM vals WHERE region = 'extra-tropics' GROUP BY ALL"))
def _extra_tropics(spark, sf):
    rows = with_regions(with_latitude_weights(pairs(spark, sf), cubes.LATITUDES), [Region("extra-tropics", extra_tropics_from=20.0)])
    return rounded(scores.evaluate_scores(rows, [scores.mse("temperature")], ["region", "lead_hours"], "init_time"), "mse")


@query("mock_truth", "SELECT 3 * 7 * 12 * 5::BIGINT AS cells, 0.0::DOUBLE AS total")
def _mock(spark, sf):
    cube = mock.truth(spark, degrees=30.0, start="2020-01-01", stop="2020-01-06")["3d"]
    return cube.agg(F.count(F.lit(1)).alias("cells"), F.sum("geopotential").alias("total"))
