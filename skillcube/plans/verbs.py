"""Data preparation verbs from files to files, and their command line: python -m skillcube VERB --input ... --output ... .

Every verb reads a cube, applies operators, and writes a cube. Lists are comma-separated; selections use the flags of operators.select.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.operators import align, climatology, derived, reduce, regrid, sampler, select, windows
from skillcube.plans import evaluate as ev
from skillcube.sources import layout
from skillcube.sources.io import read_cube, write_cube

DIMS = ("time", "init_time", "lead_hours", "member", "realization", "number", "hour", "dayofyear", "quantile", "level", "latitude", "longitude")


def split(df: DataFrame) -> tuple[list[str], list[str]]:
    """(dimensions, variables) of a cube."""
    return [c for c in df.columns if c in DIMS], [c for c in df.columns if c not in DIMS]


def _names(text: str | None) -> list[str]:
    return [x for x in (text or "").split(",") if x]


def moving(df: DataFrame, time: str = "time") -> DataFrame:
    """The cube without variables that have no time."""
    return select.drop_static(df, time, split(df)[1])


def slice_(df: DataFrame, a) -> DataFrame:
    dims, _ = split(df)
    df = select.variables(df, dims, _names(a.keep) or None, _names(a.drop) or None)
    return select.apply_flags(df, isel=a.isel, sel=a.sel, drop_isel=a.drop_isel, drop_sel=a.drop_sel)


def averages(df: DataFrame, a) -> DataFrame:
    dims, values = split(df)
    return reduce.averages(df, values, _names(a.over), dims, a.skipna)


def ensemble_mean(df: DataFrame, a) -> DataFrame:
    dims, values = split(df)
    return reduce.ensemble_mean(df, values, dims, a.member, a.skipna)


def quantiles(df: DataFrame, a) -> DataFrame:
    dims, values = split(df)
    return reduce.quantiles(df, values, _names(a.over), dims, [float(q) for q in _names(a.q)], a.skipna, a.suffix)


def moments(df: DataFrame, a) -> DataFrame:
    dims, values = split(df)
    by = [d for d in dims if d not in ("latitude", "longitude", a.time)]
    out = None
    for v in values:
        one = reduce.moments(df, v, by, a.time)
        out = one if out is None else (out.join(one, by) if by else out.crossJoin(one))  # without keys both sides are one row
    return out


def resample(df: DataFrame, a) -> DataFrame:
    df = moving(df, a.time)
    dims, values = split(df)
    pick = lambda t: values if t == "ALL" else _names(t)
    return windows.resample_in_time(df, [d for d in dims if d != a.time], a.period_hours, pick(a.mean), pick(a.min), pick(a.max), pick(a.sum), a.step_hours, a.method, a.side, a.mean_suffix, a.time, a.skipna)


def weekly(df: DataFrame, a) -> DataFrame:
    df = moving(df, a.time)
    dims, values = split(df)
    for v in values:
        df = windows.rolling(df, v, [d for d in dims if d != a.time], 7 * a.weeks, a.how, a.time)
    return df.withColumn(a.time, F.col(a.time) - F.expr(f"INTERVAL {7 * a.weeks - 1} DAY"))


def resample_daily(df: DataFrame, a) -> DataFrame:
    """Variables without a time are left out: nothing of them is resampled."""
    df = moving(df, a.time)
    dims, values = split(df)
    df = select.label_range(df, a.time, a.start_year, a.end_year)
    return windows.resample_daily(df, values, [d for d in dims if d != a.time], a.period, _names(a.statistics), a.add_statistic_suffix, a.method, a.time)


def regrid_(df: DataFrame, a) -> DataFrame:
    dims, values = split(df)
    source = regrid.Grid(tuple(select.check_increasing(sorted(r[0] for r in df.select("latitude").distinct().collect()))), tuple(sorted(r[0] for r in df.select("longitude").distinct().collect())))
    target = regrid.Grid.regular(a.latitudes, a.longitudes, a.poles)
    return regrid.regrid(df, values, [d for d in dims if d not in ("latitude", "longitude")], source, target, a.method)


def climatology_(df: DataFrame, a) -> DataFrame:
    df = moving(df)
    dims, values = split(df)
    df = df.where(F.year("time").between(a.first_year, a.last_year))
    space, keys, out = [d for d in dims if d != "time"], None, None
    for v in values:
        for s in _names(a.statistics):
            if s == "quantile":
                one = climatology.quantile(df, v, space, [float(q) for q in _names(a.q)], a.window, a.hourly)
            elif s == "seeps":
                one = climatology.seeps(df, v, space, a.dry_mm, a.window, a.hourly)
            elif a.method == "fast":
                one = climatology.fast(df, v, space, s, a.window, a.hourly)
            else:
                one = climatology.explicit(df, v, space, [s], a.window, a.hourly)
            keys = [c for c in one.columns if c in DIMS]
            out = one if out is None else out.join(one, [k for k in keys if k in out.columns], "outer")
    return out


def expand(df: DataFrame, a) -> DataFrame:
    start, stop = datetime.fromisoformat(a.start), datetime.fromisoformat(a.stop)
    span = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz"), F.expr(f"INTERVAL {a.step_hours} HOUR"))).alias("time"))
    return climatology.expand(df, span)


def derive(df: DataFrame, a) -> DataFrame:
    dims, _ = split(df)
    for name in _names(a.names):
        d = derived.REGISTRY[name]
        out = d(df, dims)
        df = out if set(dims) <= set(out.columns) and len(out.columns) > len(df.columns) else df.join(out, [c for c in dims if c in out.columns])
    return df


def spectrum(df: DataFrame, a) -> DataFrame:
    dims, values = split(df)
    by = [d for d in dims if d != "longitude"]
    n = df.select("longitude").distinct().count()
    over = _names(a.over)
    out = None
    for v in values:
        s = derived.zonal_energy_spectrum(df, v, by, n)
        keys = [d for d in by if d not in over] + ["wavenumber"]
        s = s.groupBy(*keys).agg(F.first("frequency").alias("frequency"), F.first("wavelength").alias("wavelength"), F.avg("energy").alias(v))
        out = s if out is None else out.join(s.drop("frequency", "wavelength"), keys)
    return out


def valid_time(df: DataFrame, a) -> DataFrame:
    dims, values = split(df)
    return align.valid_and_init(df) if a.mode == "valid_and_init" else align.index_on_valid_time(df, dims, a.init_step_hours, values)


def sampled(df: DataFrame, a) -> DataFrame:
    start, stop = datetime.fromisoformat(a.start), datetime.fromisoformat(a.stop)
    times = []
    while start <= stop:
        times.append(start)
        start += timedelta(hours=a.init_step_hours)
    s = sampler.Sampler(a.first_year, a.last_year, a.window, a.members, a.replace, a.leave_out_years, a.hold_days, a.edge, a.seed)
    return sampler.sampled_forecast(df, s, times, range(0, a.lead_hours + 1, a.lead_step_hours))


_TEXT = {"default": ""}
VERBS: dict[str, tuple[Callable, dict[str, dict]]] = {
    "slice": (slice_, {"keep": _TEXT, "drop": _TEXT, "isel": _TEXT, "sel": _TEXT, "drop-isel": _TEXT, "drop-sel": _TEXT}),
    "averages": (averages, {"over": {"required": True}, "skipna": {"action": "store_true"}}),
    "ensemble-mean": (ensemble_mean, {"member": {"default": "member"}, "skipna": {"action": "store_true"}}),
    "quantiles": (quantiles, {"over": {"required": True}, "q": {"required": True}, "suffix": _TEXT, "skipna": {"action": "store_true"}}),
    "moments": (moments, {"time": {"default": "time"}}),
    "resample": (resample, {"period-hours": {"type": int, "required": True}, "step-hours": {"type": int, "default": 24}, "mean": _TEXT, "min": _TEXT, "max": _TEXT, "sum": _TEXT, "method": {"default": "resample", "choices": ["resample", "rolling"]}, "side": {"default": "left", "choices": ["left", "right"]}, "mean-suffix": {"action": "store_true"}, "time": {"default": "time"}, "skipna": {"action": "store_true"}}),
    "resample-daily": (resample_daily, {"period": {"default": "1d"}, "statistics": {"default": "mean"}, "add-statistic-suffix": {"action": "store_true"}, "method": {"default": "resample", "choices": ["resample", "roll"]}, "start-year": {}, "end-year": {}, "time": {"default": "time"}}),
    "weekly": (weekly, {"weeks": {"type": int, "default": 1}, "how": {"default": "mean"}, "time": {"default": "time"}}),
    "regrid": (regrid_, {"latitudes": {"type": int, "required": True}, "longitudes": {"type": int, "required": True}, "poles": {"action": "store_true"}, "method": {"default": "conservative", "choices": sorted(regrid.METHODS)}}),
    "climatology": (climatology_, {"first-year": {"type": int, "default": 1990}, "last-year": {"type": int, "default": 2020}, "statistics": {"default": "mean"}, "method": {"default": "explicit", "choices": ["explicit", "fast"]}, "window": {"type": int, "default": 61}, "hourly": {"action": "store_true"}, "q": {"default": "0.1,0.5,0.9"}, "dry-mm": {"type": float, "default": 0.25}}),
    "expand": (expand, {"start": {"required": True}, "stop": {"required": True}, "step-hours": {"type": int, "default": 24}}),
    "derive": (derive, {"names": {"required": True}}),
    "spectrum": (spectrum, {"over": {"default": "time"}}),
    "valid-time": (valid_time, {"mode": {"default": "valid_and_delta", "choices": ["valid_and_delta", "valid_and_init"]}, "init-step-hours": {"type": int, "default": 12}}),
    "sample": (sampled, {"start": {"required": True}, "stop": {"required": True}, "init-step-hours": {"type": int, "default": 24}, "lead-hours": {"type": int, "default": 240}, "lead-step-hours": {"type": int, "default": 24}, "first-year": {"type": int, "required": True}, "last-year": {"type": int, "required": True}, "window": {"type": int, "default": 15}, "members": {"type": int, "default": 50}, "replace": {"action": "store_true"}, "leave-out-years": {"type": int}, "hold-days": {"type": int, "default": 0}, "edge": {"default": sampler.WRAP_YEAR}, "seed": {"type": int, "default": 0}}),
}


def parse_chunks(text: str) -> dict[str, int]:
    """'time=31,level=1' as labels per chunk; -1 is all of them, so it is left out."""
    out = {}
    for part in _names(text):
        dim, _, size = part.partition("=")
        if not dim or not size.lstrip("-").isdigit() or int(size) == 0 or int(size) < -1 or dim in out:
            raise ValueError(f"cannot read {part!r}")
        out[dim] = int(size)
    return {d: n for d, n in out.items() if n > 0}


def rechunk(spark: SparkSession, source: str, target: str, chunks: str, variables: str = "", memory_mb: int = layout.MAX_BYTES >> 20) -> None:
    """A store's variables in other chunks (see sources.layout)."""
    layout.rechunk(spark, source, target, parse_chunks(chunks), _names(variables) or None, most=int(memory_mb) << 20)


def run(spark: SparkSession, verb: str, source: str, target: str | None = None, chunks: str = "", **options) -> DataFrame:
    """A verb with its options by name (dashes as underscores); writes to target if it is given, in these chunks if it is a store."""
    work, flags = VERBS[verb]
    known = {k.replace("-", "_"): spec.get("default", False if spec.get("action") else None) for k, spec in flags.items()}
    wrong = set(options) - set(known)
    lacking = {k for k, spec in flags.items() if spec.get("required")} - {k.replace("_", "-") for k in options}
    if wrong or lacking:
        raise TypeError(f"{verb}: unknown options {sorted(wrong)}, missing options {sorted(lacking)}")
    out = work(read_cube(spark, source, dims=DIMS), argparse.Namespace(**(known | options)))
    if target:
        write_cube(out, target, chunks=parse_chunks(chunks))
    return out


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="skillcube", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name, (_, flags) in VERBS.items():
        p = verbs.add_parser(name)
        p.add_argument("--input", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--chunks", default="", help="labels per chunk of a store that is written, like time=31,level=1")
        for flag, spec in flags.items():
            p.add_argument(f"--{flag}", **spec)
    p = verbs.add_parser("rechunk")
    for flag in ("input", "output", "chunks"):
        p.add_argument(f"--{flag}", required=True)
    p.add_argument("--variables", default="")
    p.add_argument("--memory-mb", type=int, default=layout.MAX_BYTES >> 20)
    p = verbs.add_parser("evaluate")
    for flag in ("forecast", "truth", "climatology", "output", "variables"):
        p.add_argument(f"--{flag}", required=flag != "climatology")
    p.add_argument("--levels", default="")
    p.add_argument("--configs", default="deterministic")
    p.add_argument("--regions", default="global,tropics,extra-tropics")
    p.add_argument("--thresholds", default="0.1,0.9")
    p.add_argument("--by-valid", action="store_true")
    p.add_argument("--time-start")
    p.add_argument("--time-stop")
    p.add_argument("--level-suffixes", action="store_true")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("skillcube").getOrCreate()
    if a.verb == "evaluate":
        chosen = ev.named_configs(_names(a.regions), tuple(float(q) for q in _names(a.thresholds)))
        unknown = set(_names(a.configs)) - set(chosen)
        if unknown:
            parser.error(f"unknown configurations {sorted(unknown)}; known are {sorted(chosen)}")
        selection = ev.Selection(tuple(_names(a.variables)), (a.time_start, a.time_stop), tuple(int(x) for x in _names(a.levels)) or None)
        data = ev.Data(selection, a.forecast, a.truth, a.climatology, not a.by_valid, level_suffixes=a.level_suffixes)
        ev.evaluate(spark, data, {k: chosen[k] for k in _names(a.configs)}, a.output)
        return
    if a.verb == "rechunk":
        rechunk(spark, a.input, a.output, a.chunks, a.variables, a.memory_mb)
        return
    options = {k: v for k, v in vars(a).items() if k not in ("verb", "input", "output") and v is not None}
    run(spark, a.verb, a.input, a.output, **options)
