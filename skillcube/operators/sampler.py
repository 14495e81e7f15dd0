"""Sampled climatological forecasts: which source times stand in for each initial time and member.

drawn() draws in Spark: a draw is a function of the seed, the initial time and the member (a counter), so it needs no state, is the same for any
partitions and retries, and nothing but the sampler's own numbers reaches the driver. mapping() draws the numbers of a seeded generator on the driver,
for a small table of initial times and members.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.operators.align import sampled

WRAP_YEAR, REFLECT_RANGE, NO_EDGE = "WRAP_YEAR", "REFLECT_RANGE", "NO_EDGE"


@dataclass(frozen=True)
class Sampler:
    first_year: int
    last_year: int
    window: int = 15
    members: int = -1
    replace: bool = True
    leave_out_years: int | None = None
    hold_days: int = 0
    edge: str = WRAP_YEAR
    seed: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.window <= 728:
            raise ValueError("the window lies in [1, 728]")
        if self.members == -1 and self.replace:
            raise ValueError("all combinations are sampled without replacement")

    def offsets(self) -> np.ndarray:
        return np.arange(-self.window // 2, self.window // 2) + self.window % 2

    def years(self, of: int) -> np.ndarray:
        years = np.arange(self.first_year, self.last_year + 1)
        if self.leave_out_years is not None:
            years = years[(years < of) | (years > of + self.leave_out_years)]
            if not len(years):
                raise ValueError("no years are left to sample")
        return years

    def size(self) -> int:
        return self.members if self.members != -1 else (self.last_year - self.first_year + 1) * self.window

    def draw(self, times: Sequence[datetime]) -> tuple[np.ndarray, np.ndarray]:
        """(years, day offsets), each [times, members]."""
        rng = np.random.default_rng(self.seed)
        n, m, days = len(times), self.size(), self.offsets()
        if self.replace:
            offsets = rng.integers(days[0], days[-1] + 1, (n, m))
            pools = [self.years(t.year) for t in times]
            picks = rng.integers(0, [[len(p)] for p in pools], (n, m))
            return np.stack([p[i] for p, i in zip(pools, picks, strict=True)]), offsets
        years, chosen = np.empty((n, m), int), np.empty((n, m), int)
        for i, t in enumerate(times):
            pool = np.array([(y, d) for y in self.years(t.year) for d in days])
            if m > len(pool):
                raise ValueError(f"{m} members from {len(pool)} combinations")
            take = np.argsort(rng.random(len(pool)), kind="stable")[:m] if self.members != -1 else np.arange(m)
            years[i], chosen[i] = pool[take, 0], pool[take, 1]
        return years, chosen

    def source_times(self, times: Sequence[datetime]) -> list[list[datetime]]:
        years, offsets = self.draw(times)
        if self.hold_days:
            steps = {b - a for a, b in zip(times, times[1:], strict=False)}
            if len(steps) != 1:
                raise ValueError("held samples need evenly spaced times")
            stride = steps.pop().total_seconds() / 86400
            if self.hold_days % stride:
                raise ValueError("the hold must be a multiple of the spacing")
            block = (np.arange(len(times)) // int(self.hold_days / stride)).astype(int)
            offsets = offsets[block]  # block b holds the offsets drawn for time number b
        return [[self._source(t, int(y), int(d)) for y, d in zip(ys, ds, strict=True)] for t, ys, ds in zip(times, years, offsets, strict=True)]

    def _source(self, t: datetime, year: int, offset: int) -> datetime:
        length = 366 if datetime(year, 12, 31).timetuple().tm_yday == 366 else 365
        day = t.timetuple().tm_yday + offset
        if self.edge == WRAP_YEAR:
            day = (day - 1) % length + 1
        elif self.edge == REFLECT_RANGE:
            if year == self.first_year and day < 1:
                day = abs(day) + 2
            if year == self.last_year and day > length:
                day = 2 * length - day
        return datetime(year, 1, 1) + timedelta(days=day - 1, hours=t.hour)

    def mapping(self, spark: SparkSession, times: Sequence[datetime], lead_hours: Sequence[int]) -> DataFrame:
        """time, member, lead_hours, source_time: the source plus the lead time for every cell of the sampled forecast."""
        rows = [(t, m, s) for t, ss in zip(times, self.source_times(times), strict=True) for m, s in enumerate(ss)]
        drawn = spark.createDataFrame(rows, "time timestamp_ntz, member int, base timestamp_ntz")
        leads = drawn.withColumn("lead_hours", F.explode(F.array(*(F.lit(int(h)).cast("long") for h in lead_hours))))
        return leads.select("time", "member", "lead_hours", (F.col("base") + F.make_dt_interval(hours=F.col("lead_hours").cast("int"))).alias("source_time"))


#: Fixed values of the counter's mixing: a prime modulus, an odd multiplier, an increment and weights of the counters.
PRIME, FACTOR, STEP, WEIGHTS = 2_147_483_647, 48_271, 12_345, (1_000_003, 7_919, 104_729, 15_485_863)


def counter(seed: int, *counters: Column) -> Column:
    """An even whole number below PRIME that depends on seed and counters alone: four rounds of x -> x * x + FACTOR * x + STEP. Counters: up to three."""
    x = F.lit(seed * WEIGHTS[0])
    for w, c in zip(WEIGHTS[1:], counters, strict=False):
        x = x + F.pmod(c.cast("long"), F.lit(PRIME)) * w
    x = F.array(F.pmod(x, F.lit(PRIME)))
    for _ in range(4):  # lambdas, so that an expression isn't written out again for each use
        x = F.transform(x, lambda y: (F.pmod(y * y, F.lit(PRIME)) + y * FACTOR + STEP) % PRIME)
    return x[0]


def _pick_year(s: Sampler, of: Column, k: Column) -> tuple[Column, Column]:
    """(number of years that may be drawn for a year, the k-th of them)."""
    n = s.last_year - s.first_year + 1
    if s.leave_out_years is None:
        return F.lit(n), s.first_year + k
    before = F.least(F.greatest(of - s.first_year, F.lit(0)), F.lit(n))
    again = F.greatest(of + s.leave_out_years + 1, F.lit(s.first_year))
    return before + F.greatest(s.last_year - again + 1, F.lit(0)), F.when(k < before, s.first_year + k).otherwise(again + k - before)


def drawn(times: DataFrame, s: Sampler) -> DataFrame:
    """time, member, source_time of every initial time (a column time of times) and member.

    With replacement a year and a day of the window are drawn apart. Without, the combinations of both are put into a random order of their own for
    each time, of which the first ones are taken. Held samples keep their days for hold_days from the first time on. A time for which no year is left,
    or too few combinations, raises.
    """
    days = s.offsets()
    hours = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01', CAST(time AS TIMESTAMP_NTZ))")
    rows = times.select("time").distinct().withColumns({"__h": hours, "__of": F.year("time")})
    years, _ = _pick_year(s, F.col("__of"), F.lit(0))
    rows = rows.withColumn("__n", years.cast("long"))
    first, width = int(days[0]), len(days)
    if s.replace:
        held = F.col("__h")
        if s.hold_days:
            start = times.agg(F.min("time")).first()[0]
            since = (start - datetime(1970, 1, 1)).total_seconds() // 3600
            held = F.lit(int(since)) + F.floor((F.col("__h") - int(since)) / (24 * s.hold_days)) * (24 * s.hold_days)
        rows = rows.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(s.members - 1))))
        some = F.when(F.col("__n") > 0, F.col("__n")).otherwise(F.raise_error(F.lit("no years are left to sample")).cast("long"))
        rows = rows.withColumns({"__k": counter(s.seed, F.col("__h"), F.col("member"), F.lit(1)) % some, "__day": counter(s.seed, held, F.col("member"), F.lit(2)) % width + first})
    else:
        if s.hold_days:
            raise ValueError("held samples are drawn with replacement")
        pool = F.sequence(F.lit(0).cast("long"), F.col("__n") * width - 1)
        if s.members == -1:
            order = pool
        else:
            least = F.col("__n") * width >= s.members
            keyed = F.transform(pool, lambda k: F.struct(counter(s.seed, F.col("__h"), k, F.lit(3)).alias("key"), k.alias("k")))
            order = F.when(least, F.slice(F.array_sort(keyed), 1, s.members)["k"]).otherwise(F.raise_error(F.lit(f"{s.members} members from too few combinations")).cast("array<bigint>"))
        rows = rows.where((F.col("__n") > 0) | F.raise_error(F.lit("no years are left to sample")).cast("boolean")).select("*", F.posexplode(order).alias("member", "__c"))
        rows = rows.withColumns({"__k": F.expr(f"__c div {width}"), "__day": F.col("__c") % width + first})
    year = _pick_year(s, F.col("__of"), F.col("__k"))[1].cast("int")
    rows = rows.withColumns({"__year": year, "__length": F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))), "__at": F.dayofyear("time") + F.col("__day")})
    at = F.col("__at")
    if s.edge == WRAP_YEAR:
        at = F.pmod(at - 1, F.col("__length")) + 1
    elif s.edge == REFLECT_RANGE:
        at = F.when((F.col("__year") == s.first_year) & (at < 1), F.abs(at) + 2).when((F.col("__year") == s.last_year) & (at > F.col("__length")), 2 * F.col("__length") - at).otherwise(at)
    source = F.date_add(F.make_date("__year", F.lit(1), F.lit(1)), (at - 1).cast("int")).cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour("time"))
    return rows.select("time", F.col("member").cast("int").alias("member"), source.alias("source_time"))


def drawn_forecast(observations: DataFrame, s: Sampler, times: DataFrame, lead_hours: Sequence[int]) -> DataFrame:
    """The sampled forecast of a table of initial times, drawn in Spark."""
    leads = drawn(times, s).withColumn("lead_hours", F.explode(F.array(*(F.lit(int(h)).cast("long") for h in lead_hours))))
    return sampled(leads.withColumn("source_time", F.col("source_time") + F.make_dt_interval(hours=F.col("lead_hours").cast("int"))), observations)


def sampled_forecast(observations: DataFrame, sampler: Sampler, times: Sequence[datetime], lead_hours: Sequence[int]) -> DataFrame:
    return sampled(sampler.mapping(observations.sparkSession, times, lead_hours), observations)
