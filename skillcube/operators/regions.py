"""Regions as weights of grid cells.

Boxes are predicates on latitude and longitude, so a cell finds its regions without a join and all regions share one pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (south, north, west, east) of the boxes that make up each named region, ends included.
BOXES: dict[str, list[tuple[float, float, float, float]]] = {
    "global": [(-90, 90, 0, 360)],
    "tropics": [(-20, 20, 0, 360)],
    "extra-tropics": [(-90, -20, 0, 360), (20, 90, 0, 360)],
    "northern-hemisphere": [(20, 90, 0, 360)],
    "southern-hemisphere": [(-90, -20, 0, 360)],
    "europe": [(35, 75, 347.5, 360), (35, 75, 0, 42.5)],
    "north-america": [(25, 60, 240, 285)],
    "north-atlantic": [(25, 65, 290, 350)],
    "north-pacific": [(25, 60, 145, 230)],
    "east-asia": [(25, 60, 102.5, 150)],
    "ausnz": [(-45, -12.5, 120, 175)],
    "arctic": [(60, 90, 0, 360)],
    "antarctic": [(-90, -60, 0, 360)],
}


@dataclass(frozen=True)
class Region:
    """Weight of a cell: cells of boxes count once per box that holds them; the other parts multiply. parts: regions that all hold at once."""

    name: str
    boxes: tuple[tuple[float, float, float, float], ...] = ()
    extra_tropics_from: float | None = None
    land_mask: str | None = None
    land_threshold: float | None = None
    parts: tuple[Region, ...] = ()

    def weight(self, lat: Column, lon: Column) -> Column:
        one = lambda p: p.cast("double")
        w = F.lit(1.0)
        if self.boxes:
            w = reduce(lambda a, b: a + b, (one(lat.between(s, n) & lon.between(a, b)) for s, n, a, b in self.boxes))
        if self.extra_tropics_from is not None:
            w = w * one(F.abs(lat) >= self.extra_tropics_from)
        if self.land_mask:
            mask = F.coalesce(F.col(self.land_mask), F.lit(0.0))
            w = w * (mask if self.land_threshold is None else one(mask > self.land_threshold))
        for part in self.parts:
            w = w * part.weight(lat, lon)
        return w

    def masks(self) -> set[str]:
        """Columns of land masks that the weight reads."""
        return {self.land_mask} - {None} | {m for p in self.parts for m in p.masks()}

    def combined(self, other: Region) -> Region:
        """Both regions at once: a cell's weights multiply, so two boxed regions overlap."""
        return Region(f"{self.name}_{other.name}", parts=(self, other))


def named(*names: str, land_mask: str = "land_sea_mask") -> list[Region]:
    """Predefined regions; a suffix _land restricts one to land."""
    out = []
    for n in names:
        base = n.removesuffix("_land")
        if base not in BOXES:
            raise KeyError(n)
        out.append(Region(n, tuple(BOXES[base]), land_mask=land_mask if n != base else None))
    return out


def extra_tropical(threshold: float = 20.0) -> Region:
    return Region("extra-tropics", extra_tropics_from=threshold)


def with_regions(df: DataFrame, regions: list[Region] | None, weight: str = "w", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """df with a row for each region that a cell belongs to: region, and weight times the region's weight.

    Cells outside a region leave it before any value is looked at, so missing or infinite values there cannot leak in.
    """
    if not regions:
        return df
    options = F.array(*(F.struct(F.lit(r.name).alias("region"), r.weight(F.col(lat), F.col(lon)).alias("rw")) for r in regions))
    rows = df.withColumn("__r", F.explode(F.filter(options, lambda x: x["rw"] > 0)))
    return rows.withColumns({"region": F.col("__r.region"), weight: F.col(weight) * F.col("__r.rw")}).drop("__r")
