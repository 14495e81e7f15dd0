"""Derived variables as columns: pointwise formulas, stencils along a coordinate, and integrals over levels.

Functions take a frame with columns latitude, longitude, level and named fields; `cell` lists the other dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from skillcube.functions.numeric import fdiv, gradient, panel, strict

#: Radius of the Earth in metres (mean of the polar and the equatorial one), its rotation, gravity as used here.
EARTH_RADIUS = 1000 * (6357 + 6378) / 2
OMEGA, GRAVITY = 7.292e-5, 9.81
M_PER_DEGREE = EARTH_RADIUS * math.pi / 180

#: Zonal lines that one call of the transform takes.
LINES_AT_ONCE = 512


def wind_speed(u: str = "u", v: str = "v") -> Column:
    return F.sqrt(F.col(u) ** 2 + F.col(v) ** 2)


def along(cell: Sequence[str], coordinate: str):
    return Window.partitionBy(*[c for c in cell if c != coordinate]).orderBy(coordinate)


def d_dx(f: str | Column, cell: Sequence[str]) -> Column:
    """Eastward derivative per metre, 0 where the cosine of latitude vanishes. Longitudes do not wrap."""
    f = F.col(f) if isinstance(f, str) else f
    cos = F.cos(F.radians("latitude"))
    slope = gradient(f, F.col("longitude"), along(cell, "longitude"))
    return F.when(cos > 1e-6, slope / cos / M_PER_DEGREE).otherwise(F.when(slope.isNotNull(), 0.0))


def d_dy(f: str | Column, cell: Sequence[str]) -> Column:
    """Northward derivative per metre."""
    f = F.col(f) if isinstance(f, str) else f
    return gradient(f, F.col("latitude"), along(cell, "latitude")) / M_PER_DEGREE


def divergence(cell: Sequence[str], u: str = "u", v: str = "v") -> Column:
    return d_dx(u, cell) + d_dy(v, cell)


def vorticity(cell: Sequence[str], u: str = "u", v: str = "v") -> Column:
    return d_dx(v, cell) - d_dy(u, cell)


def vertical_velocity(df: DataFrame, cell: Sequence[str], u: str = "u", v: str = "v", name: str = "vertical_velocity") -> DataFrame:
    """Cumulative trapezoids of minus the divergence over pressure (100 * level), 0 at the first level."""
    rows = df.withColumn("__d", -divergence(cell, u, v))
    order = along(cell, "level")
    step = (F.col("__d") + F.lag("__d").over(order)) / 2 * (F.col("level") - F.lag("level").over(order)) * 100
    rows = rows.withColumn("__s", F.when(F.lag("level").over(order).isNull(), F.lit(0.0)).otherwise(step))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    total = F.when(F.count("__s").over(run) == F.count(F.lit(1)).over(run), F.sum("__s").over(run))
    return rows.withColumn(name, total).drop("__d", "__s")


def integrate(df: DataFrame, f: dict[str, Column], cell: Sequence[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """Trapezoidal integrals over level (in its own unit) of columns, one row per column of cells."""
    by = [c for c in cell if c != "level"]
    rows = df
    if low is not None:
        rows = rows.where(F.col("level").between(low, high))
    order = along(cell, "level")
    rows = rows.select(*cell, *(v.alias(k) for k, v in f.items()))
    panels = rows.withColumns({f"__{k}": panel(F.col(k), F.col("level"), order) for k in f})
    whole = lambda k: F.when(F.count(k) == F.count(F.lit(1)), F.coalesce(F.sum(f"__{k}"), F.lit(0.0))).alias(k)
    return panels.groupBy(*by).agg(*(whole(k) for k in f))


def eddy_kinetic_energy(df: DataFrame, cell: Sequence[str], u: str = "u", v: str = "v") -> DataFrame:
    """Half the integral over level of the squared departures from the zonal mean."""
    zone = Window.partitionBy(*[c for c in cell if c != "longitude"])
    away = lambda c: F.col(c) - F.when(F.count(c).over(zone) == F.count(F.lit(1)).over(zone), F.avg(c).over(zone))
    rows = df.withColumns({"__u": away(u), "__v": away(v)})
    return integrate(rows, {"eddy_kinetic_energy": (F.col("__u") ** 2 + F.col("__v") ** 2) / 2}, cell)


def coriolis() -> Column:
    return 2 * OMEGA * F.sin(F.radians("latitude"))


def geostrophic(cell: Sequence[str], phi: str = "geopotential") -> tuple[Column, Column]:
    """(u, v) of the geostrophic wind; infinite or missing at the equator."""
    return fdiv(-d_dy(phi, cell), coriolis()), fdiv(d_dx(phi, cell), coriolis())


def geostrophic_speed(df: DataFrame, cell: Sequence[str], name: str = "geostrophic_wind_speed") -> DataFrame:
    ug, vg = geostrophic(cell)
    return df.withColumns({"__ug": ug, "__vg": vg}).withColumn(name, F.sqrt(F.col("__ug") ** 2 + F.col("__vg") ** 2)).drop("__ug", "__vg")


def ageostrophic(df: DataFrame, cell: Sequence[str], u: str = "u", v: str = "v") -> DataFrame:
    """df with ageostrophic_u, ageostrophic_v and ageostrophic_speed."""
    ug, vg = geostrophic(cell)
    rows = df.withColumns({"__ug": ug, "__vg": vg}).withColumns({"ageostrophic_u": F.col(u) - F.col("__ug"), "ageostrophic_v": F.col(v) - F.col("__vg")})
    return rows.withColumn("ageostrophic_speed", wind_speed("ageostrophic_u", "ageostrophic_v")).drop("__ug", "__vg")


def lapse_rate(cell: Sequence[str], t: str = "temperature", phi: str = "geopotential") -> Column:
    """Temperature gradient over height, both taken by level."""
    order = along(cell, "level")
    return fdiv(gradient(F.col(t), F.col("level"), order), gradient(F.col(phi) / GRAVITY, F.col("level"), order))


def total_column(df: DataFrame, cell: Sequence[str], q: str = "specific_humidity", name: str = "total_column_water") -> DataFrame:
    """Integral over level (hPa, as it is) over gravity."""
    return integrate(df, {name: F.col(q) / GRAVITY}, cell)


def integrated_water_transport(df: DataFrame, cell: Sequence[str], u: str = "u", v: str = "v", q: str = "specific_humidity") -> DataFrame:
    """Norm of the integrals of moisture transport between levels 300 and 1000."""
    both = integrate(df, {"__qu": F.col(q) * F.col(u), "__qv": F.col(q) * F.col(v)}, cell, 300, 1000)
    return both.withColumn("integrated_vapor_transport", F.sqrt(F.col("__qu") ** 2 + F.col("__qv") ** 2) / GRAVITY).drop("__qu", "__qv")


def relative_humidity(t: str = "temperature", q: str = "specific_humidity", level: str = "level") -> Column:
    svp = 6.112 * F.exp(fdiv(17.67 * (F.col(t) - 273.15), F.col(t) - 29.65))
    return fdiv(fdiv(F.col(q), 1 - F.col(q)), fdiv(0.622 * svp, F.col(level) - svp))


def precipitation_accumulation(df: DataFrame, total: str, cell: Sequence[str], hours: int, lead: str = "lead_hours", name: str | None = None) -> DataFrame:
    """Accumulation over `hours` from a running total along the lead time; negative amounts are 0, incomplete windows missing."""
    order = along(cell, lead)
    steps = df.withColumns({"__d": F.col(total) - F.lag(total).over(order), "__h": F.col(lead) - F.lag(lead).over(order)})
    step = steps.agg(F.min("__h"), F.max("__h")).first()
    if step[0] is None or step[0] != step[1] or hours % step[0]:
        raise ValueError("lead times must be evenly spaced and divide the accumulation")
    return _rolled(steps, "__d", cell, int(hours // step[0]), lead, name or f"{total}_{hours}hr").drop("__d", "__h")


def _rolled(df: DataFrame, amount: str, cell: Sequence[str], k: int, lead: str, name: str) -> DataFrame:
    run = along(cell, lead).rowsBetween(-(k - 1), 0)
    total = F.when(F.count(amount).over(run) == k, F.sum(amount).over(run))
    return df.withColumn(name, F.when(total < 0, 0.0).otherwise(total))


def aggregate_accumulation(df: DataFrame, short: str, cell: Sequence[str], k: int, name: str, lead: str = "lead_hours") -> DataFrame:
    """Longer accumulation as the sum of the last k shorter ones."""
    run = along(cell, lead).rowsBetween(-(k - 1), 0)
    return df.withColumn(name, F.when(F.count(short).over(run) == k, F.sum(short).over(run)))


def _powers(n: int):
    """Arrow batches of lines (the last column) to batches with |rfft|**2 / n**2 in its place; a line with a missing value has missing powers."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        waves = n // 2 + 1
        for batch in batches:
            for start in range(0, batch.num_rows, LINES_AT_ONCE):
                part = batch.slice(start, LINES_AT_ONCE)
                lines, count = part.columns[-1], part.num_rows
                sizes = np.diff(lines.offsets.to_numpy())
                row = np.repeat(np.arange(count), sizes)
                at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                values = np.bincount(row * n + at % n, lines.flatten().to_numpy(zero_copy_only=False), count * n).reshape(count, n)
                power = np.abs(np.fft.rfft(values, norm="forward")) ** 2
                ends = pa.array(np.arange(count + 1, dtype=np.int32) * waves)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(power.ravel(), from_pandas=True))], [*part.schema.names[:-1], "__power"])

    return run


def zonal_energy_spectrum(df: DataFrame, value: str, by: Sequence[str], n_longitudes: int) -> DataFrame:
    """wavenumber, frequency, wavelength and energy of a zonal line per key (latitude among them) by a fast Fourier transform.

    A line is an array of n_longitudes values in one row, many lines are transformed at once, and only its n/2 + 1 energies are rows. All wavenumbers
    but 0 count twice, the highest included. A line with a missing value has missing energies.
    """
    points = F.array_sort(F.collect_list(F.struct("longitude", F.col(value).cast("double").alias("v"))))
    lines = df.groupBy(*by).agg(F.transform(points, lambda p: F.coalesce(p["v"], F.lit(float("nan")))).alias("__line"))
    schema = StructType([*(lines.schema[c] for c in by), StructField("__power", ArrayType(DoubleType()))])
    powers = lines.mapInArrow(_powers(n_longitudes), schema).select(*by, F.posexplode("__power").alias("wavenumber", "__p"))
    circle = F.cos(F.radians("latitude")) * (2 * math.pi * EARTH_RADIUS)
    energy = F.when(F.col("wavenumber") == 0, F.col("__p")).otherwise(2 * F.col("__p")) * circle
    return powers.select(*by, "wavenumber", fdiv(F.col("wavenumber"), circle).alias("frequency"), fdiv(circle, F.col("wavenumber")).alias("wavelength"), energy.alias("energy"))


def interpolate_spectrum(spectrum: DataFrame, by: Sequence[str], frequencies: Sequence[float]) -> DataFrame:
    """Energy at common frequencies by linear interpolation along each line; missing outside its range."""
    order = Window.partitionBy(*by).orderBy("wavenumber")
    spans = spectrum.withColumns({"f0": F.col("frequency"), "f1": F.lead("frequency").over(order), "e0": F.col("energy"), "e1": F.lead("energy").over(order), "__last": F.lead("wavenumber").over(order).isNull()})
    options = F.array(*(F.lit(float(f)) for f in frequencies))
    within = F.filter(options, lambda f: (f >= F.col("f0")) & ((f < F.col("f1")) | (F.col("__last") & (f == F.col("f0")))))
    hit = spans.withColumn("common_frequency", F.explode(within))
    value = F.when(F.col("__last"), F.col("e0")).otherwise(F.col("e0") + (F.col("e1") - F.col("e0")) * (F.col("common_frequency") - F.col("f0")) / (F.col("f1") - F.col("f0")))
    return hit.select(*by, "common_frequency", value.alias("energy"))


def common_frequencies(spectrum: DataFrame, by_latitude: str, n: int) -> list[float]:
    """n evenly spaced frequencies that every line covers: from the largest minimum to the smallest maximum."""
    ends = spectrum.groupBy(by_latitude).agg(F.min("frequency").alias("a"), F.max("frequency").alias("b")).agg(F.max("a"), F.min("b")).first()
    return [ends[0] + (ends[1] - ends[0]) * i / (n - 1) for i in range(n)]


@dataclass(frozen=True)
class Derived:
    """A named derived variable: the fields it needs and how a frame gets it. Subclass or register your own."""

    name: str
    needs: tuple[str, ...]
    compute: object

    def __call__(self, df: DataFrame, cell: Sequence[str]) -> DataFrame:
        missing = [n for n in self.needs if n not in df.columns]
        if missing:
            raise KeyError(f"{self.name} needs {missing}")
        if self.name in df.columns:
            raise ValueError(f"{self.name} is there already")
        return self.compute(df, cell)


def _column(name: str, needs: tuple[str, ...], f) -> Derived:
    return Derived(name, needs, lambda df, cell: df.withColumn(name, f(cell)))


def _accumulation(hours: int) -> Derived:
    total, name = "total_precipitation", f"total_precipitation_{hours}hr"
    return Derived(name, (total,), lambda df, cell: precipitation_accumulation(df, total, cell, hours, name=name))


def _longer(hours: int, short_hours: int) -> Derived:
    short, name = f"total_precipitation_{short_hours}hr", f"total_precipitation_{hours}hr_from_{short_hours}hr"
    return Derived(name, (short,), lambda df, cell: aggregate_accumulation(df, short, cell, hours // short_hours, name))


def _column_integral(name: str, species: str) -> Derived:
    return Derived(name, (species,), lambda df, cell: total_column(df, cell, species, name))


def _away(name: str, column: str) -> Derived:
    return Derived(name, (U, V, "geopotential"), lambda df, cell: ageostrophic(df, cell, U, V).withColumnRenamed(column, name).drop(*{"ageostrophic_u", "ageostrophic_v", "ageostrophic_speed"} - {name}))


#: Names of fields and of derived variables as users of such cubes know them.
U, V = "u_component_of_wind", "v_component_of_wind"
REGISTRY: dict[str, Derived] = {
    d.name: d
    for d in (
        _column("wind_speed", (U, V), lambda c: wind_speed(U, V)),
        _column("10m_wind_speed", (f"10m_{U}", f"10m_{V}"), lambda c: wind_speed(f"10m_{U}", f"10m_{V}")),
        _column("divergence", (U, V), lambda c: divergence(c, U, V)),
        _column("vorticity", (U, V), lambda c: vorticity(c, U, V)),
        Derived("vertical_velocity", (U, V), lambda df, c: vertical_velocity(df, c, U, V)),
        Derived("eddy_kinetic_energy", (U, V), lambda df, c: eddy_kinetic_energy(df, c, U, V)),
        Derived("geostrophic_wind_speed", ("geopotential",), geostrophic_speed),
        _column("u_component_of_geostrophic_wind", ("geopotential",), lambda c: geostrophic(c)[0]),
        _column("v_component_of_geostrophic_wind", ("geopotential",), lambda c: geostrophic(c)[1]),
        _away("ageostrophic_wind_speed", "ageostrophic_speed"),
        _away("u_component_of_ageostrophic_wind", "ageostrophic_u"),
        _away("v_component_of_ageostrophic_wind", "ageostrophic_v"),
        _column("lapse_rate", ("temperature", "geopotential"), lapse_rate),
        _column_integral("total_column_vapor", "specific_humidity"),
        _column_integral("total_column_liquid", "specific_cloud_liquid_water_content"),
        _column_integral("total_column_ice", "specific_cloud_ice_water_content"),
        Derived("integrated_vapor_transport", (U, V, "specific_humidity"), lambda df, c: integrated_water_transport(df, c, U, V)),
        _column("relative_humidity", ("temperature", "specific_humidity", "level"), lambda c: relative_humidity()),
        _accumulation(6),
        _accumulation(24),
        _longer(24, 6),
        _longer(24, 12),
    )
}


def base_variables(names: Sequence[str]) -> list[str]:
    """Fields that must be read so that the named variables can be derived."""
    out: list[str] = []
    for n in names:
        out += [b for b in (REGISTRY[n].needs if n in REGISTRY else (n,)) if b not in out]
    return out
