"""Evaluation of forecasts: configuration, one fused plan per configuration, and result tables.

A result has a row per metric, region, lead time and level, and a column per variable. All pointwise scores of a configuration over all regions are
one spatial aggregate followed by one temporal aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.functions.weights import axis, with_latitude_weights
from skillcube.operators import align, scores, select
from skillcube.operators.climatology import mean_dry_fraction
from skillcube.operators.derived import REGISTRY, base_variables
from skillcube.operators.reduce import spatial_mean, time_mean
from skillcube.operators.regions import Region, named, with_regions
from skillcube.plans.shared import Shared
from skillcube.sources.io import open_forecast, read_cube, write_result


@dataclass(frozen=True)
class Selection:
    variables: tuple[str, ...]
    time: tuple[str | None, str | None] = (None, None)
    levels: tuple[int, ...] | None = None
    latitude: tuple[float, float] | None = None
    longitude: tuple[float, float] | None = None

    def apply(self, df: DataFrame, time: str = "time") -> DataFrame:
        df = select.label_range(df, time, *self.time)
        if self.levels is not None and "level" in df.columns:
            df = df.where(F.col("level").isin(list(self.levels)))
        for dim, ends in (("latitude", self.latitude), ("longitude", self.longitude)):
            if ends is not None:
                df = select.label_range(df, dim, *ends)
        return df


@dataclass(frozen=True)
class Data:
    """land_mask: a cube with land_sea_mask; where it is unset the truth's own serves, as of its first time.

    on_missing: raise, where truth, climatology or land mask lack a label that the forecast needs; skip leaves those rows out, so that means are
    over what is there.
    """

    selection: Selection
    forecast: str
    truth: str
    climatology: str | None = None
    by_init: bool = True
    rename: dict[str, str] = field(default_factory=dict)
    level_suffixes: bool = False
    land_mask: str | None = None
    on_missing: str = "raise"


@dataclass(frozen=True)
class Seeps:
    """A precipitation variable that is scored by SEEPS, and its dry limit."""

    metric: str
    variable: str
    dry_mm: float


SEEPS = (Seeps("seeps_24hr", "total_precipitation_24hr", 0.25), Seeps("seeps_6hr", "total_precipitation_6hr", 0.1))


@dataclass(frozen=True)
class Eval:
    """metrics: names of scores, spatial_NAME for those per grid cell; derived: names in the registry of derived variables.

    thresholds: quantiles, from the climatology's quantiles or, with threshold_kind gaussian_quantile, from its mean and standard deviation.
    """

    metrics: tuple[str, ...]
    regions: tuple[Region, ...] | None = None
    derived: tuple[str, ...] = ()
    against_analysis: bool = False
    use_climatology: bool = False
    use_persistence: bool = False
    use_probabilistic_climatology: bool = False
    temporal_mean: bool = True
    skipna: bool = False
    thresholds: tuple[float, ...] = ()
    threshold_kind: str = "quantile"
    seeps: tuple[Seeps, ...] = SEEPS
    fmt: str = "parquet"


METRICS: dict[str, Callable[[str], scores.Score]] = {
    "mse": scores.mse, "rmse_sqrt_before_time_avg": scores.rmse_sqrt_before_time_avg, "mae": scores.mae, "bias": scores.bias, "acc": scores.acc,
    "gaussian_crps": scores.gaussian_crps, "gaussian_variance": scores.gaussian_variance,
}
#: Scores of ensemble cells (see scores.ensemble_cells_of), by what a variable's columns begin with.
ENSEMBLE: dict[str, Callable[[str], scores.Score]] = {
    "crps": scores.crps, "crps_skill": scores.crps_skill, "crps_spread": scores.crps_spread, "ensemble_mean_mse": scores.ensemble_mean_mse, "debiased_ensemble_mean_mse": scores.debiased_ensemble_mean_mse,
    "ensemble_mean_rmse_sqrt_before_time_avg": scores.ensemble_mean_rmse_sqrt_before_time_avg, "ensemble_variance": scores.ensemble_variance, "ensemble_stddev_sqrt_before_time_avg": scores.ensemble_stddev_sqrt_before_time_avg,
}
ENERGY = ("energy_score", "energy_skill", "energy_spread")
#: Scores of cells with a threshold (see scores.exceedance_cells_of).
BINARY: dict[str, Callable[[str], scores.Score]] = {"brier": scores.brier, "debiased_brier": scores.debiased_brier, "ignorance": scores.ignorance}
GAUSSIAN_BINARY: dict[str, Callable[[str, str], scores.Score]] = {"gaussian_brier": scores.gaussian_brier, "gaussian_ignorance": scores.gaussian_ignorance}
#: Other names under which scores are known.
ALIASES = {
    "rmse": "rmse_sqrt_before_time_avg", "ensemble_stddev": "ensemble_stddev_sqrt_before_time_avg", "ensemble_mean_rmse": "ensemble_mean_rmse_sqrt_before_time_avg", "brier_score": "brier",
    "debiased_brier_score": "debiased_brier", "ignorance_score": "ignorance", "energy_score_skill": "energy_skill", "energy_score_spread": "energy_spread",
}
#: Fixed names: components of wind vectors and the variable that holds a vector's error.
WIND_VECTORS = (
    ("u_component_of_wind", "v_component_of_wind", "wind_vector"), ("10m_u_component_of_wind", "10m_v_component_of_wind", "10m_wind_vector"),
    ("u_component_of_geostrophic_wind", "v_component_of_geostrophic_wind", "geostrophic_wind_vector"), ("u_component_of_ageostrophic_wind", "v_component_of_ageostrophic_wind", "ageostrophic_wind_vector"),
)
WIND_METRICS = {"mse": scores.wind_vector_mse, "rmse_sqrt_before_time_avg": scores.wind_vector_rmse_sqrt_before_time_avg}


def _names(config: Eval) -> list[str]:
    """The configuration's metrics under their own names."""
    spatial = lambda m: m.removeprefix("spatial_")
    return [("spatial_" if m.startswith("spatial_") else "") + ALIASES.get(spatial(m), spatial(m)) for m in config.metrics]


def _check_known(wanted: Sequence[str], config: Eval, ensemble: bool) -> None:
    one = lambda names: {n for n in names if not n.endswith("before_time_avg")}  # noqa: E731  of a score per cell there is no root
    if ensemble:
        known = {*ENSEMBLE, *ENERGY, *BINARY, "rps", "rank_histogram"} | {f"spatial_{n}" for n in (*one(ENSEMBLE), *BINARY, "rps")}
    else:
        seeps = {s.metric for s in config.seeps}
        known = {*METRICS, *GAUSSIAN_BINARY, "gaussian_rps", *seeps} | {f"spatial_{n}" for n in (*(one(METRICS) - {"acc"}), *GAUSSIAN_BINARY, *seeps)}
    if unknown := [m for m in wanted if m not in known]:
        raise ValueError(f"unknown metrics {unknown} of {'an ensemble' if ensemble else 'a deterministic or Gaussian forecast'}")


def _long(wide: DataFrame, keys: Sequence[str], names: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns named by (metric, variable) to rows per metric with a column per variable."""
    metrics = list(dict.fromkeys(m for m, _ in names.values()))
    variables = list(dict.fromkeys(v for _, v in names.values()))
    find = {mv: c for c, mv in names.items()}
    rows = [F.struct(F.lit(m).alias("metric"), *(F.col(find[m, v]).alias(v) if (m, v) in find else F.lit(None).cast("double").alias(v) for v in variables)) for m in metrics]
    return wide.withColumn("__m", F.explode(F.array(*rows))).select("__m.metric", *keys, *(f"__m.{v}" for v in variables))


def evaluate_frame(df: DataFrame, config: Eval, variables: Sequence[str], time: str = "init_time", latitudes: list[float] | None = None, member: str = "member", members: int | None = None, shared: Shared | None = None) -> DataFrame:
    """Scores of an aligned frame (see scores): all metrics of the configuration, in long form.

    What several scores are made of (the frame, ensemble cells, exceedances) is computed once and kept in shared.

    latitudes, members: the frame's axes where they are known; otherwise they are read from it. Thresholds are the columns threshold_v, or
    threshold for all variables.
    """
    space = ["latitude", "longitude"]
    keep = [c for c in ("lead_hours", "level") if c in df.columns]
    wanted = _names(config)
    ensemble = member in df.columns
    _check_known(wanted, config, ensemble)
    if latitudes is None:
        latitudes = axis(df, "latitude")
    plain, local = [m for m in wanted if not m.startswith("spatial_")], [m.removeprefix("spatial_") for m in wanted if m.startswith("spatial_")]
    regions = list(config.regions) if config.regions else None
    by_region = [*(["region"] if regions else []), *keep]
    parts: list[DataFrame] = []
    shared = shared or Shared(df.sparkSession)

    def once(frame: DataFrame, *users: bool) -> DataFrame:
        """The frame for as many users as are wanted."""
        if sum(map(bool, users)) < 2:
            return frame
        shared.want(frame, sum(map(bool, users)))
        return shared.get(frame)

    weighted = lambda frame: with_regions(with_latitude_weights(frame, latitudes), regions)
    if "quantile" in df.columns:
        df = df.withColumns({f"threshold_{v}": F.col("threshold") for v in variables if f"threshold_{v}" not in df.columns})

    def fused(frame: DataFrame, scorers: list[tuple[str, str, scores.Score]], extra: Sequence[str] = ()) -> None:
        if not scorers:
            return
        by, names = [*by_region, *extra], {}
        for i, (metric, v, s) in enumerate(scorers):
            s.meta["column"] = f"__r{i}"
            names[f"__r{i}"] = (metric, v)
        out = scores.evaluate_scores(weighted(frame), [s for _, _, s in scorers], by, time, config.skipna, config.temporal_mean)
        parts.append(_long(out, by if config.temporal_mean else [*by, time], names))

    def per_cell(frame: DataFrame, scorers: list[tuple[str, str, scores.Score]], extra: Sequence[str] = ()) -> None:
        if not scorers:
            return
        keys = [*keep, *space, *extra]
        names = {f"__p{i}": (f"spatial_{m}", v) for i, (m, v, _) in enumerate(scorers)}
        points = {f"__p{i}": next(iter(s.points.values())) for i, (_, _, s) in enumerate(scorers)}
        # scores that skip missing values by nature do so over time too
        groups = [{c: p for c, p in points.items() if (scorers[int(c[3:])][2].skipna or config.skipna) == loose} for loose in (False, True)]
        parts.extend(_long(scores.spatial(frame, g, keys, loose), keys, {c: names[c] for c in g}) for g, loose in zip(groups, (False, True), strict=True) if g)

    def summed(frame: DataFrame, metric: str, points: dict[str, Column]) -> None:
        """Spatial means summed over thresholds, then averaged over time."""
        names = {f"__q{i}": (metric, v) for i, v in enumerate(points)}
        means = spatial_mean(weighted(frame), dict(zip(names, points.values(), strict=True)), [*by_region, time, "quantile"], config.skipna)
        total = means.groupBy(*by_region, time).agg(*(F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in names))
        parts.append(_long(time_mean(total, list(names), by_region, config.skipna), by_region, names))

    if not ensemble:
        by_metric = {s.metric: s for s in config.seeps}
        seeps = lambda ms: [(m, by_metric[m].variable, scores.seeps(by_metric[m].variable, f"{by_metric[m].variable}_seeps_threshold", f"{by_metric[m].variable}_p1", dry_mm=by_metric[m].dry_mm)) for m in ms if m in by_metric]
        loose = [m for m in local if m in by_metric or config.skipna]
        df = once(df, any(m in METRICS or m in by_metric for m in plain), any(m in METRICS for m in local if m not in loose), loose, any(m in GAUSSIAN_BINARY for m in plain), any(m in GAUSSIAN_BINARY for m in local), "gaussian_rps" in plain)
        winds = [w for w in WIND_VECTORS if w[0] in variables and w[1] in variables]
        vectors = [(m, name, WIND_METRICS[m](u, v, name)) for m in plain if m in WIND_METRICS for u, v, name in winds]
        fused(df, [(m, v, METRICS[m](v)) for v in variables for m in plain if m in METRICS] + vectors + seeps(plain))
        per_cell(df, [(m, v, METRICS[m](v)) for v in variables for m in local if m in METRICS] + seeps(local))
        fused(df, [(m, v, GAUSSIAN_BINARY[m](v, f"threshold_{v}")) for v in variables for m in plain if m in GAUSSIAN_BINARY], ["quantile"])
        per_cell(df, [(m, v, GAUSSIAN_BINARY[m](v, f"threshold_{v}")) for v in variables for m in local if m in GAUSSIAN_BINARY], ["quantile"])
        if "gaussian_rps" in plain:
            summed(df, "gaussian_rps", {v: scores.gaussian_rps_points(v, f"threshold_{v}") for v in variables})
    else:
        cell = [time, *keep, *space]
        masks = sorted({m for r in regions or () for m in r.masks()})
        energy, ranks = [m for m in plain if m in ENERGY], "rank_histogram" in plain
        want = [k for k, yes in (("scores", any(m in ENSEMBLE for m in plain + local)), ("members", energy), ("ranks", ranks)) if yes]
        if want:
            cells = scores.ensemble_cells_of(df, variables, cell, member, config.skipna, masks, want)
            cells = once(cells, any(m in ENSEMBLE for m in plain), any(m in ENSEMBLE for m in local), energy, ranks)
        fused(cells, [(m, v, ENSEMBLE[m](f"{v}__")) for v in variables for m in plain if m in ENSEMBLE]) if "scores" in want else None
        per_cell(cells, [(m, v, ENSEMBLE[m](f"{v}__")) for v in variables for m in local if m in ENSEMBLE]) if "scores" in want else None
        if energy:
            out = scores.energy_scores(weighted(cells), variables, by_region, time, config.skipna)
            parts.append(_long(out, by_region, {f"{v}__{c}": (c, v) for v in variables for c in ENERGY if c in plain or "energy_score" in plain}))
        if ranks:
            keys = [*keep, *space]
            h = scores.rank_histograms(cells, variables, keys, members or df.select(member).distinct().count())
            parts.append(_long(h, [*keys, "bin"], {v: ("rank_histogram", v) for v in variables}))
        if any(m in BINARY or m == "rps" for m in plain + local):
            over = scores.exceedance_cells_of(df, variables, [*cell, "quantile"], masks)
            over = once(over, any(m in BINARY for m in plain), any(m in BINARY for m in local), "rps" in plain, "rps" in local)
            fused(over, [(m, v, BINARY[m](f"{v}__")) for v in variables for m in plain if m in BINARY], ["quantile"])
            per_cell(over, [(m, v, BINARY[m](f"{v}__")) for v in variables for m in local if m in BINARY], ["quantile"])
            if "rps" in plain:
                summed(over, "rps", {v: scores.rps_points(f"{v}__") for v in variables})
            if "rps" in local:
                keys, names = [*keep, *space], {f"__p{i}": ("spatial_rps", v) for i, v in enumerate(variables)}
                means = scores.spatial(over, {c: scores.rps_points(f"{v}__") for c, (_, v) in names.items()}, [*keys, "quantile"], config.skipna)
                parts.append(_long(means.groupBy(*keys).agg(*(F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in names)), keys, names))
    # one row per metric and key: variables that were scored apart come together again
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    known = {v for part in parts for v in part.columns} - {"metric", "region", "lead_hours", "level", "quantile", "bin", time, *space}
    keys = [c for c in merged.columns if c not in known]
    return merged.groupBy(*keys).agg(*(F.max(v).alias(v) for v in merged.columns if v in known))


def _axes(forecast: DataFrame, time: str, by_init: bool) -> dict:
    """The forecast's span of times, its latitudes and its number of members, in one pass over those columns alone."""
    lead = F.max("lead_hours") if "lead_hours" in forecast.columns else F.lit(0)
    member = F.count_distinct("member") if "member" in forecast.columns else F.lit(None)
    row = forecast.agg(F.min(time).alias("first"), F.max(time).alias("last"), lead.alias("lead"), F.collect_set("latitude").alias("latitudes"), member.alias("members")).first()
    reach = timedelta(hours=int(row["lead"] or 0))
    last = row["last"] + reach if by_init and row["last"] is not None else row["last"]
    return {"first": row["first"], "last": last, "reach": reach, "latitudes": sorted(row["latitudes"]), "members": row["members"]}


def _with_masks(spark: SparkSession, frame: DataFrame, data: Data, masks: list[str], strict: bool) -> DataFrame:
    """The frame with land masks. Of a mask with times the first time counts, which is not the forecast's."""
    space = ["latitude", "longitude"]
    try:
        source = read_cube(spark, data.land_mask or data.truth, masks)
        source.columns  # noqa: B018  a mask that is not there shows now
    except (AnalysisException, KeyError) as e:
        raise select.MissingLabel(f"no land mask {masks}") from e
    if "time" in source.columns:
        source = source.where(F.col("time") == F.lit(source.agg(F.min("time")).first()[0]))
    cells = source.groupBy(*space).agg(*(F.first(m, True).alias(m) for m in masks))
    if strict:
        align.guard(frame.select(*space).distinct(), cells.dropna(subset=masks).select(*space), f"land mask {masks}")
    return frame.join(cells, space, "left")


def prepare(spark: SparkSession, data: Data, config: Eval) -> tuple[DataFrame, list[str], str, dict]:
    """The aligned frame, its variables, the time dimension to average over, and the axes that are known (latitudes, members)."""
    if data.on_missing not in ("raise", "skip"):
        raise ValueError(f"on_missing {data.on_missing!r}")
    strict = data.on_missing == "raise"
    names = list(data.selection.variables) + list(config.derived)
    wanted = [m.removeprefix("spatial_") for m in _names(config)]
    rains = [s.variable for s in config.seeps if s.metric in wanted]
    names += [v for v in rains if v not in names]
    # what a derived variable is made of, and what is stored
    fields = list(dict.fromkeys([*(n for n in names if n not in config.derived), *base_variables(list(config.derived))]))
    gaussian = any(m.startswith("gaussian_") for m in wanted)
    spreads = [f"{v}_std" for v in names] if gaussian else []
    time = "init_time" if data.by_init else "time"
    at = "valid_time" if data.by_init else "time"
    space = ["latitude", "longitude"]
    forecast = data.selection.apply(open_forecast(spark, data.forecast, data.by_init, data.rename, data.level_suffixes, None if data.level_suffixes else [*fields, *spreads]), time)
    axes = _axes(forecast, time, data.by_init)
    if axes["first"] is None:
        raise ValueError("the forecast has no rows")
    # the truth is cut to the forecast's span, levels and box before anything is derived from it
    whole = read_cube(spark, data.truth, fields)
    truth = replace(data.selection, time=(None, None)).apply(whole)
    # a forecast by valid time begins earlier than its first time, where persistence looks
    earlier = axes["reach"] if config.use_persistence and not data.by_init else timedelta(0)
    truth = truth.where(F.col("time").between(F.lit(axes["first"] - earlier), F.lit(axes["last"])))
    joint = [*(["level"] if "level" in forecast.columns and "level" in truth.columns else []), *space]
    if config.against_analysis:
        truth = align.analysis_truth(forecast, fields, joint)
    cells = forecast.select(*[c for c in forecast.columns if c not in fields and c not in spreads])
    if config.use_persistence:
        forecast = align.persistence_forecast(cells, truth, joint, strict=strict)
    if config.use_climatology:
        forecast = align.climatology_forecast(forecast, read_cube(spark, data.climatology, dims=("hour", "dayofyear", *joint)), fields, joint, at, strict)
    if config.use_probabilistic_climatology:
        past = data.selection.apply(whole, "time") if not data.by_init else replace(data.selection, time=(None, None)).apply(whole)
        first = past.agg(F.min(F.year("time"))).first()[0]
        forecast = align.probabilistic_climatology_forecast(cells, align.stack_years(past, first), joint, at, strict).withColumnRenamed("number", "member")
        axes["members"] = None
    for d in config.derived:
        dims = [c for c in forecast.columns if c not in fields and c not in spreads]
        forecast, truth = REGISTRY[d](forecast, dims), REGISTRY[d](truth, ["time", *joint])
    dims = [c for c in forecast.columns if c not in fields and c not in names and c not in spreads]
    frame = align.with_truth(forecast.select(*dims, *names, *spreads), truth.select("time", *joint, *names), joint, data.by_init, strict=strict)
    if masks := {m for r in config.regions or () for m in r.masks()}:
        frame = _with_masks(spark, frame, data, sorted(masks), strict)
    climatology = read_cube(spark, data.climatology, dims=("hour", "dayofyear", "quantile", *joint)) if data.climatology else None
    climatology_keys = [c for c in ("hour", "dayofyear", *joint) if climatology is not None and c in climatology.columns]
    columns: dict[str, str] = {}  # of the climatology -> as they are called in the frame before the suffix
    if "acc" in wanted or config.thresholds and config.threshold_kind == "gaussian_quantile":
        columns |= {align.climatology_column(climatology.columns, v): v for v in names}
    if config.thresholds and config.threshold_kind == "gaussian_quantile":
        columns |= {f"{v}_std": f"{v}_std" for v in names}
    columns |= {f"{v}_seeps_threshold": f"{v}_seeps_threshold" for v in rains}
    if columns:
        one = climatology
        if "quantile" in climatology.columns:  # rows of quantiles stand beside or repeat the others
            one = climatology.groupBy(*climatology_keys).agg(*(F.first(c, True).alias(c) for c in columns))
        frame = align.with_climatology(frame, one.select(*climatology_keys, *(F.col(c).alias(v) for c, v in columns.items())), joint, at, strict=strict)
        frame = frame.withColumnsRenamed({f"{v}_seeps_threshold_c": f"{v}_seeps_threshold" for v in rains})
    for v in rains:
        dry = mean_dry_fraction(climatology, v, joint).withColumnRenamed("p1", f"{v}_p1")
        if strict:
            align.guard(frame.select(*joint).distinct(), dry.select(*joint), f"the dry fraction of {v}")
        frame = frame.join(dry, joint)
    if config.thresholds:
        if config.threshold_kind == "gaussian_quantile":
            frame = scores.with_gaussian_threshold(frame, names, config.thresholds)
        elif config.threshold_kind == "quantile":
            frame = scores.with_quantile_threshold(frame, climatology.where(F.col("quantile").isNotNull()), names, joint, config.thresholds, at)
        else:
            raise ValueError(f"threshold_kind {config.threshold_kind!r}")
    return frame, names, time, axes


def evaluate(spark: SparkSession, data: Data, configs: dict[str, Eval], output_dir: str | None = None, shared: Shared | None = None) -> dict[str, DataFrame]:
    """Result tables by configuration, written to output_dir if it is given.

    Configurations that need the same aligned frame share it. A result that was written as Parquet is read from there; if all are, and shared is
    not the caller's, what was shared is removed at once.
    """
    out, mine = {}, shared or Shared(spark)
    prepared = {name: prepare(spark, data, config) for name, config in configs.items()}
    for frame, *_ in prepared.values():
        mine.want(frame)
    for name, config in configs.items():
        frame, variables, time, axes = prepared[name]
        out[name] = evaluate_frame(mine.get(frame), config, variables, time, axes["latitudes"], members=axes["members"], shared=mine)
        if output_dir:
            path = write_result(out[name], output_dir, name, fmt=config.fmt)
            if config.fmt == "parquet":
                out[name] = spark.read.parquet(path)
    if output_dir and shared is None and all(c.fmt == "parquet" for c in configs.values()):
        mine.close()
    return out


def named_configs(regions: Sequence[str] = tuple(["global", "tropics", "extra-tropics", "europe"]), thresholds: tuple[float, ...] = (0.1, 0.9), seeps: bool = False, threshold_kind: str = "quantile") -> dict[str, Eval]:
    """The twelve predefined configurations."""
    r = tuple(named(*regions)) or None
    rain = tuple(s.metric for s in SEEPS) if seeps else ()
    deterministic = ("mse", "acc", "bias", "mae", *rain)
    ensemble = ("crps", "crps_spread", "crps_skill", "ensemble_mean_mse", "debiased_ensemble_mean_mse", "ensemble_variance")
    binary = ("brier", "debiased_brier", "ignorance")
    cut = {"thresholds": thresholds, "threshold_kind": threshold_kind}
    return {
        "deterministic": Eval(deterministic, r),
        "deterministic_spatial": Eval(tuple(f"spatial_{m}" for m in ("bias", "mse", "mae", *rain))),
        "deterministic_temporal": Eval((*deterministic, "rmse_sqrt_before_time_avg"), r, temporal_mean=False),
        "deterministic_vs_analysis": Eval(deterministic, r, against_analysis=True),
        "probabilistic": Eval(ensemble, r),
        "ensemble_binary": Eval((*binary, "rps"), r, **cut),
        "ensemble_forecast_vs_era_experimental_metrics": Eval((*ENERGY, "ensemble_mean_rmse", "ensemble_stddev")),
        "probabilistic_spatial": Eval(tuple(f"spatial_{m}" for m in ensemble)),
        "ensemble_binary_spatial": Eval(tuple(f"spatial_{m}" for m in binary), **cut),
        "probabilistic_spatial_histograms": Eval(("rank_histogram",)),
        "gaussian_probabilistic": Eval(("gaussian_crps", "gaussian_variance"), r),
        "gaussian_binary": Eval(("gaussian_brier", "gaussian_ignorance"), r, **cut),
    }


# ---- result tables


def with_rmse(results: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Rows metric = rmse beside those of mse."""
    rmse = results.where("metric = 'mse'").withColumns({"metric": F.lit("rmse")} | {v: F.sqrt(v) for v in variables})
    return results.unionByName(rmse)


def relative_skill(results: DataFrame, baseline: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Percent change against a baseline; for acc against the room up to 1. Lead times above 0."""
    both = results.join(baseline.select(*keys, "metric", F.col(value).alias("__b")), [*keys, "metric"]).where("lead_hours > 0")
    from skillcube.functions.numeric import fdiv

    gain = F.col(value) - F.col("__b")
    percent = F.when(F.col("metric") == "acc", fdiv(gain, 1 - F.col("__b"))).otherwise(fdiv(gain, F.col("__b"))) * 100
    return both.select(*keys, "metric", percent.alias("relative_percent"))


def spread_skill_ratio(results: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Root of ensemble variance over root of ensemble-mean error."""
    from skillcube.functions.numeric import fdiv

    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col(value)))
    return results.groupBy(*keys).agg(fdiv(F.sqrt(pick("ensemble_variance")), F.sqrt(pick("ensemble_mean_mse"))).alias("spread_skill_ratio"))


def with_perfect_start(results: DataFrame, variables: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows of perfect scores at lead time 0: 1 for acc, 0 for errors."""
    start = results.select("metric", *[k for k in keys if k != "lead_hours"]).distinct().where(F.col("metric").isin("acc", "rmse", "mse", "bias", "mae"))
    start = start.withColumns({"lead_hours": F.lit(0).cast("long")} | {v: F.when(F.col("metric") == "acc", 1.0).otherwise(0.0) for v in variables})
    return results.where("lead_hours > 0").unionByName(start, allowMissingColumns=True)
