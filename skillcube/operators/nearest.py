"""The nearest of scattered points on the sphere, by equi-joins of cells: stations, ships, events and the cells of any grid.

Points lie in cubes of space around the unit sphere. A place meets the points in its own cube and the 26 around it; what it finds within a cube's
length is the nearest there is, since nothing nearer can lie outside. Places that find nothing so near look again in cubes twice as long, until all
have found theirs. Coordinates that repeat are looked up once, and every round is written, so no round repeats another's work.

Places are not copied into the cubes around them: each cube that holds places gathers the points that it can see, and a place meets those of its own
cube. Pairs of a place and a point are made, measured and reduced to the nearest within one stage, so none is shuffled, sorted or written. Cubes of very
many places are dealt out in parts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillcube.sources.io import remove, remove_at_exit, scratch

#: Metres of the earth's mean radius.
RADIUS = 6_371_000.0
#: About as many places as a part of a cube has at most; more make more parts.
PART = 50_000


def _place(lat: Column, lon: Column) -> list[Column]:
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def _cubes(df: DataFrame, size: float, around: bool) -> DataFrame:
    """df by its cubes __i, __j, __k of a length: its own, or also those around it."""
    df = df.withColumns({i: F.floor((F.col(c) + 1) / size) for i, c in zip(("__i", "__j", "__k"), ("__x", "__y", "__z"), strict=True)})
    return _around(df) if around else df


def _around(df: DataFrame) -> DataFrame:
    """df by its cube and those around it."""
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)))
    return df.withColumn("__s", F.explode(steps)).withColumns({i: F.col(i) + F.col(f"__s.{a}") for i, a in (("__i", "a"), ("__j", "b"), ("__k", "c"))}).drop("__s")


def _meets_sphere(size: float) -> Column:
    """Whether the cube __i, __j, __k has room for points of the sphere."""
    starts = [F.col(c) * size - 1 for c in ("__i", "__j", "__k")]
    nearest = sum((F.greatest(a, -a - size, F.lit(0.0)) ** 2 for a in starts), F.lit(0.0))
    farthest = sum((F.greatest(F.abs(a), F.abs(a + size)) ** 2 for a in starts), F.lit(0.0))
    return (nearest <= 1 + 1e-9) & (farthest >= 1 - 1e-9)


def _key() -> Column:
    """The cube __i, __j, __k as one number: lengths of 1e-6 and more make indices below 2 ** 21."""
    return (F.col("__i") * 2**42 + F.col("__j") * 2**21 + F.col("__k")).cast("long")


def _seen(cubes: DataFrame, have: DataFrame, size: float) -> DataFrame:
    """For each part __part of the cubes __home (in __parts parts) the points in it and around it, numbered by latitude and longitude."""
    reached = _around(cubes).where(_meets_sphere(size)).select("__home", "__parts", _key().alias("__cube"))
    points = reached.join(_cubes(have, size, False).select("__plat", "__plon", _key().alias("__cube")), "__cube")
    points = points.select("__home", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"), "__plat", "__plon")
    points = points.withColumn("__nth", F.row_number().over(Window.partitionBy("__home", "__part").orderBy("__plat", "__plon")))
    return points.withColumns(dict(zip(("__px", "__py", "__pz"), _place(F.col("__plat"), F.col("__plon")), strict=True)))


def nearest(places: DataFrame, points: DataFrame, names: Sequence[str] = ("latitude", "longitude"), suffix: str = "_near", within: float | None = None) -> DataFrame:
    """places with the columns of their nearest point (named with a suffix) and distance, in metres along the great circle.

    names: latitude and longitude, in degrees, in both. Ties, to a billionth of the radius, go to the smaller latitude, then the smaller longitude. Points
    that repeat a coordinate are all nearest. A place with a null or no point within `within` metres keeps nulls; so does every place if there are no points.
    """
    spark, (lat, lon) = places.sparkSession, names

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark, "nearest")
        df.write.parquet(path)
        remove_at_exit(spark, path)
        return spark.read.schema(df.schema).parquet(path), path

    def put(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.withColumns(dict(zip(("__x", "__y", "__z"), _place(F.col(a), F.col(b)), strict=True)))

    def spots(df: DataFrame, a: str, b: str) -> tuple[DataFrame, str]:
        at = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(F.col(lat).cast("double")) & ~F.isnan(F.col(lon).cast("double"))).select(F.col(lat).alias(a), F.col(lon).alias(b))
        return written(at.dropDuplicates([a, b]))

    (have, *gone), (wanted, path) = spots(points, "__plat", "__plon"), spots(places, "__qlat", "__qlon")
    gone.append(path)
    n = have.count()
    have = put(have, "__plat", "__plon")
    most = 2 * math.sin(min(within / RADIUS, math.pi) / 2) if within is not None else 2.0
    size = min(2.0, max(7.2 / math.sqrt(n), 1e-6)) if n else 2.0  # about four of n even points in a cube: few places need a second look

    def chord(x: Column, y: Column, z: Column) -> Column:
        return F.sqrt((F.col("__x") - x) ** 2 + (F.col("__y") - y) ** 2 + (F.col("__z") - z) ** 2)

    # billionths of the radius, then the point's number, as one long: a plain number keeps the reduction in place
    met_at = chord(F.col("__px"), F.col("__py"), F.col("__pz"))
    rank = F.when(met_at <= most + 1e-9, F.floor(met_at * 1e9 + 0.5) * 2**32 + F.col("__nth"))
    found = None
    while n:
        own = _cubes(put(wanted, "__qlat", "__qlon"), size, False).withColumn("__home", _key())
        cubes, path = written(own.groupBy("__home", "__i", "__j", "__k").agg(F.ceil(F.count("*") / PART).cast("int").alias("__parts")))
        gone.append(path)
        parted = F.broadcast(cubes.where("__parts > 1").select("__home", "__parts"))  # one row at most of PART places
        part = F.pmod(F.hash("__qlat", "__qlon"), F.coalesce("__parts", F.lit(1)))
        own = own.join(parted, "__home", "left").select("__home", part.alias("__part"), "__qlat", "__qlon", "__x", "__y", "__z")
        met = own.join(_seen(cubes, have, size), ["__home", "__part"], "left").withColumn("__rank", rank)
        best = met.groupBy("__home", "__part", "__qlat", "__qlon").agg(*(F.min_by(c, F.col("__rank")).alias(c) for c in ("__plat", "__plon")))
        best = put(best.select("__qlat", "__qlon", "__plat", "__plon"), "__qlat", "__qlon")
        best = best.withColumn("__d", chord(*_place(F.col("__plat"), F.col("__plon"))))
        # a point outside may equal one found at a cube's length, to the billionth to which ties are told
        sure = F.col("__d") <= (most if size >= most else size - 1e-9)
        looked, _ = written(best.select("__qlat", "__qlon", *(F.when(sure, F.col(c)).alias(c) for c in ("__plat", "__plon", "__d"))))
        near = looked.where(F.col("__d").isNotNull())
        found = near if found is None else found.unionByName(near)
        wanted = looked.where(F.col("__d").isNull()).select("__qlat", "__qlon")
        if size >= most or wanted.isEmpty():
            break
        size *= 2
    if found is None:
        found = places.sparkSession.createDataFrame([], places.select(F.col(lat).alias("__qlat"), F.col(lon).alias("__qlon"), F.col(lat).alias("__plat"), F.col(lon).alias("__plon"), F.lit(0.0).alias("__d")).schema)
    for path in gone:
        remove(spark, path)
    right = points.withColumnsRenamed({c: c + suffix for c in points.columns})
    pairs = found.join(right, (F.col("__plat") == F.col(lat + suffix)) & (F.col("__plon") == F.col(lon + suffix))).withColumn("distance", 2 * RADIUS * F.asin(F.least(F.col("__d") / 2, F.lit(1.0)))).drop("__plat", "__plon", "__d")
    return places.join(pairs, (F.col(lat) == F.col("__qlat")) & (F.col(lon) == F.col("__qlon")), "left").drop("__qlat", "__qlon")
