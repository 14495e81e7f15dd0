"""Projections, renames and selections by label or position along a dimension."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class MissingLabel(KeyError):
    """A label that was asked for exactly is not there."""


def variables(df: DataFrame, dims: Sequence[str], keep: Sequence[str] | None = None, drop: Sequence[str] | None = None) -> DataFrame:
    """Keep or drop data variables; the dimensions stay."""
    if keep is not None and drop is not None:
        raise ValueError("keep and drop exclude each other")
    names = [c for c in df.columns if c not in dims]
    wanted = list(keep) if keep is not None else [c for c in names if c not in set(drop or ())]
    return df.select(*dims, *wanted)


def described(df: DataFrame, dims: dict[str, Sequence[str]]) -> DataFrame:
    """df with the dimensions of variables noted in their columns' metadata, where files and stores keep them. Unnoted variables have all."""
    note = lambda c: F.col(c).alias(c, metadata=df.schema[c].metadata | {"dims": list(dims[c])}) if c in dims else F.col(c)
    return df.select(*map(note, df.columns))


def varies_along(df: DataFrame, variable: str, dim: str) -> bool:
    """Whether a variable has a dimension: by its column's metadata, where that says so."""
    return dim in df.schema[variable].metadata.get("dims", [dim])


def drop_static(df: DataFrame, dim: str, variables: Sequence[str]) -> DataFrame:
    """df without the variables that do not vary along a dimension; their values are repeated along it."""
    return df.drop(*(v for v in variables if not varies_along(df, v, dim)))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def decode_levels(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Turn variables name_500, name_850 into one variable name with a level dimension; other variables repeat per level as they are."""
    found: dict[int, dict[str, str]] = {}
    plain = []
    for c in df.columns:
        if c in dims:
            continue
        m = re.fullmatch(r"(.*)_(\d+)", c)
        if m:
            found.setdefault(int(m[2]), {})[m[1]] = c
        else:
            plain.append(c)
    names = sorted({n for v in found.values() for n in v})
    rows = [F.struct(F.lit(level).alias("level"), *(F.col(have[n]).cast("double").alias(n) if n in have else F.lit(None).cast("double").alias(n) for n in names)) for level, have in sorted(found.items())]
    out = df.select(*dims, *plain, F.explode(F.array(*rows)).alias("__l")) if rows else df
    return out.select(*dims, *plain, "__l.level", *(f"__l.{n}" for n in names)) if rows else out


def _period_end(text: str) -> Column:
    """Last instant of a partial date: a year, a month or a day."""
    start = F.to_timestamp_ntz(F.lit(text + "-01-01"[len(text) - 4 :] if len(text) in (4, 7) else text))
    unit = {4: "1 YEAR", 7: "1 MONTH", 10: "1 DAY"}.get(len(text))
    return start + F.expr(f"INTERVAL {unit}") - F.expr("INTERVAL 1 MICROSECOND") if unit else start


def _period_start(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text + "-01-01"[len(text) - 4 :] if len(text) in (4, 7) else text))


def label_range(df: DataFrame, dim: str, start=None, stop=None) -> DataFrame:
    """Labels from start to stop, both inclusive. Strings on a time dimension may be partial dates."""
    times = df.schema[dim].dataType.typeName().startswith("timestamp") or df.schema[dim].dataType.typeName() == "date"
    if start is not None:
        df = df.where(F.col(dim) >= (_period_start(start) if times and isinstance(start, str) else F.lit(start)))
    if stop is not None:
        df = df.where(F.col(dim) <= (_period_end(stop) if times and isinstance(stop, str) else F.lit(stop)))
    return df


def labels(df: DataFrame, dim: str, wanted: Sequence, strict: bool = True) -> DataFrame:
    """Rows at the listed labels; a missing label raises if strict."""
    if strict:
        there = {r[0] for r in df.where(F.col(dim).isin(list(wanted))).select(dim).distinct().collect()}
        if set(wanted) - there:
            raise MissingLabel(f"{dim}: {sorted(set(wanted) - there)}")
    return df.where(F.col(dim).isin(list(wanted)))


def nearest_label(df: DataFrame, dim: str, wanted: float, tolerance: float) -> DataFrame:
    """Rows at the label nearest to wanted, which must be within tolerance."""
    have = [r[0] for r in df.select(dim).distinct().collect()]
    best = min(have, key=lambda v: (abs(v - wanted), v), default=None)
    if best is None or abs(best - wanted) > tolerance:
        raise MissingLabel(f"{dim}: {wanted}")
    return df.where(F.col(dim) == best)


def ordinals(df: DataFrame, dim: str, name: str = "ord") -> DataFrame:
    """A table label -> position. An axis has few labels, so one ordered window over its distinct labels is small."""
    return df.select(dim).distinct().withColumn(name, F.row_number().over(Window.orderBy(dim)) - 1)


def positions(df: DataFrame, dim: str, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Positional slice with step along the sorted labels; negative ends count from the end."""
    order = ordinals(df, dim, "__ord")
    n = order.count() if (start or 0) < 0 or (stop or 0) < 0 else 0
    a = (start or 0) + (n if (start or 0) < 0 else 0)
    keep = (F.col("__ord") >= a) & ((F.col("__ord") - a) % step == 0)
    if stop is not None:
        keep &= F.col("__ord") < stop + (n if stop < 0 else 0)
    return df.join(order.where(keep).select(dim), dim, "left_semi")


def drop_labels(df: DataFrame, dim: str, unwanted: Sequence) -> DataFrame:
    return df.where(~F.col(dim).isin(list(unwanted)))


def drop_positions(df: DataFrame, dim: str, unwanted: Sequence[int]) -> DataFrame:
    return df.join(ordinals(df, dim, "__ord").where(F.col("__ord").isin(list(unwanted))).select(dim), dim, "left_anti")


def thin(df: DataFrame, dim: str, every: int) -> DataFrame:
    """Every n-th label."""
    return positions(df, dim, step=every)


def at_hour(df: DataFrame, hour: int, time: str = "time") -> DataFrame:
    """Rows of one hour of the day, their time floored to the day."""
    return df.where(F.hour(time) == hour).withColumn(time, F.date_trunc("day", F.col(time)))


def uniform_step(df: DataFrame, dim: str):
    """The one difference between neighbouring labels; more than one raises."""
    steps = df.select(dim).distinct().select((F.col(dim) - F.lag(dim).over(Window.orderBy(dim))).alias("step")).where("step is not null").distinct().limit(2).collect()
    if len(steps) != 1:
        raise ValueError(f"{dim} is not evenly spaced")
    return steps[0].step


def check_not_empty(df: DataFrame, what: str = "selection") -> DataFrame:
    if not df.take(1):
        raise ValueError(f"{what} is empty")
    return df


def check_increasing(values: Sequence[float]) -> list[float]:
    """Labels in increasing order; only strictly monotonic axes pass."""
    up = all(a < b for a, b in zip(values, values[1:], strict=False))
    down = all(a > b for a, b in zip(values, values[1:], strict=False))
    if not up and not down:
        raise ValueError("labels must be strictly monotonic")
    return list(values) if up else list(values)[::-1]


def snap(df: DataFrame, dim: str, to: Sequence[float], tolerance: float = 1e-3) -> DataFrame:
    """Replace labels by those of another grid that they agree with; raises where they do not."""
    have = sorted(r[0] for r in df.select(dim).distinct().collect())
    want = sorted(to)
    if len(have) != len(want) or any(abs(a - b) > tolerance for a, b in zip(have, want, strict=True)):
        raise ValueError(f"grids differ along {dim}")
    pairs = df.sparkSession.createDataFrame([(float(a), float(b)) for a, b in zip(have, want, strict=True)], "__have double, __want double")
    return df.join(F.broadcast(pairs), F.col(dim) == F.col("__have")).withColumn(dim, F.col("__want")).drop("__have", "__want")  # one row per axis label


def literal_dims(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


#: Order in which parsed selections apply.
_ORDER = ("isel", "sel", "drop_isel", "drop_sel")


def parse_flags(text: str) -> dict[str, dict]:
    """'time_start=2020-01-01,level_list=500+850' as {dim: {start|stop|step|list: value}}. Lists are parted by '+', empty items are errors."""
    out: dict[str, dict] = {}
    for part in filter(None, text.split(",")):
        key, _, value = part.partition("=")
        m = re.fullmatch(r"(.+)_(start|stop|step|list)", key.strip())
        if not m or not value:
            raise ValueError(f"cannot read {part!r}")
        if m[2] == "list" and "" in value.split("+"):
            raise ValueError(f"empty item in {part!r}")
        out.setdefault(m[1], {})[m[2]] = [coerce(v) for v in value.split("+")] if m[2] == "list" else coerce(value)
    return out


def coerce(value: str):
    """int, else float, else text."""
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return value


def apply_flags(df: DataFrame, **flags: str) -> DataFrame:
    """Apply isel, sel, drop_isel and drop_sel flags, in that order."""
    for kind in _ORDER:
        for dim, spec in parse_flags(flags.get(kind, "")).items():
            if kind == "isel":
                df = positions(df, dim, spec.get("start"), spec.get("stop"), spec.get("step", 1)) if "list" not in spec else df.join(ordinals(df, dim, "__ord").where(F.col("__ord").isin(spec["list"])).select(dim), dim, "left_semi")
            elif kind == "sel":
                df = labels(df, dim, spec["list"]) if "list" in spec else label_range(df, dim, spec.get("start"), spec.get("stop"))
                df = thin(df, dim, spec["step"]) if spec.get("step", 1) != 1 else df
            elif kind == "drop_isel":
                df = drop_positions(df, dim, spec["list"])
            else:
                df = drop_labels(df, dim, spec["list"])
    return df
