"""Reductions: area-weighted means, temporal means, averages, moments, quantiles, ensemble statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce as reduce_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillcube.functions.numeric import fdiv, mean, weighted_mean
from skillcube.functions.weights import latitude_weights, with_latitude_weights, axis, table


def spatial_mean(df: DataFrame, values: dict[str, Column], by: Sequence[str], skipna: bool = False, weight: str = "w") -> DataFrame:
    """Area-weighted mean of pointwise columns per key of `by`, all in one aggregate with partial sums."""
    points = df.select(*by, weight, *(v.alias(k) for k, v in values.items()))
    return points.groupBy(*by).agg(*(weighted_mean(F.col(k), F.col(weight), skipna).alias(k) for k in values))


def time_mean(df: DataFrame, values: Sequence[str], by: Sequence[str], skipna: bool = False) -> DataFrame:
    """Mean of per-time values."""
    return df.groupBy(*by).agg(*(mean(F.col(v), skipna).alias(v) for v in values))


def densify(df: DataFrame, dims: Sequence[Sequence[str]], labels: dict[str, Sequence] | None = None) -> DataFrame:
    """A row for every combination of labels, missing where there was none.

    dims: groups of columns whose combinations are kept as they occur. labels: axes whose labels are known, which then need no pass over the
    data and no product: they are generated. Each group's labels are an axis of the cube, so the result has as many rows as the cube has cells.
    """
    labels = labels or {}
    cells = None
    for group in dims:
        found = df.select(*group).distinct()
        cells = found if cells is None else cells.crossJoin(found)
    for name, values in labels.items():
        cells = cells.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values)).cast(f"array<{df.schema[name].dataType.simpleString()}>")))
    return cells.join(df, [c for g in dims for c in g] + list(labels), "left")


def averages(df: DataFrame, values: Sequence[str], over: Sequence[str], dims: Sequence[str], skipna: bool = False) -> DataFrame:
    """Plain means over dimensions; with latitude among them, of weight times value. Weights are of the latitudes selected."""
    by = [d for d in dims if d not in over]
    if "latitude" in over:
        df = with_latitude_weights(df)
        df = df.withColumns({v: F.col(v) * F.col("w") for v in values})
    return df.groupBy(*by).agg(*(mean(F.col(v), skipna).alias(v) for v in values))


def ensemble_mean(df: DataFrame, values: Sequence[str], dims: Sequence[str], member: str = "member", skipna: bool = False) -> DataFrame:
    return averages(df, values, [member], dims, skipna)


#: Values of a key up to which they are gathered as they are; beyond, quantiles are selected by counting. Values that a selection gathers in the end.
GATHERED, REMAINDER = 1 << 20, 1 << 16
#: Parts into which a sketch cuts what is between the brackets, and the inverse of its error.
GRID, ACCURACY = 1000, 16_000


def quantiles(df: DataFrame, values: Sequence[str], over: Sequence[str], dims: Sequence[str], q: Sequence[float], skipna: bool = False, suffix: str = "", gathered: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, on a new dimension quantile.

    Where no key has more than `gathered` rows (GATHERED, if unset) each key's values are gathered by one task. Otherwise order statistics are
    selected: see selected_quantiles. Both are exact.
    """
    if not all(0 <= x <= 1 for x in q):
        raise ValueError("quantiles lie in [0, 1]")
    by = [d for d in dims if d not in over]
    longest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if longest > (GATHERED if gathered is None else gathered):
        return selected_quantiles(df, values, by, q, skipna, suffix)
    arrays = [F.percentile(v, F.array(*(F.lit(float(x)) for x in q))).alias(v) for v in values]
    ok = [(F.count(v) == F.count(F.lit(1))).alias(f"__ok_{v}") for v in values]
    rows = df.groupBy(*by).agg(*arrays, *ok).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(len(q) - 1))))
    label = F.get(F.array(*(F.lit(float(x)) for x in q)), F.col("__i")).alias("quantile")
    return rows.select(*by, label, *(F.when(F.col(f"__ok_{v}") | F.lit(skipna), F.get(v, F.col("__i"))).alias(v + suffix) for v in values))


def selected_quantiles(df: DataFrame, values: Sequence[str], by: Sequence[str], q: Sequence[float], skipna: bool = False, suffix: str = "", remainder: int = REMAINDER, grid: int = GRID, accuracy: int = ACCURACY) -> DataFrame:
    """quantiles() of keys with any number of values, exact and in bounded memory, by repeated bracketing.

    A quantile lies between two values of a key, of which it is known how many are below, equal to the lower one and strictly between. A round
    sketches the values strictly between (a mergeable sketch of fixed size, with partial results before the shuffle), draws the brackets in around
    the order statistics that are sought, and counts again. Ties are on a bracket or outside, so a round leaves about 5 / grid of the values whatever
    their distribution. Once few are left they are counted by value and the statistics are read off.
    """
    out = None
    for v in values:
        one = _selected(df, F.col(v).cast("double"), by, q, skipna, remainder, grid, accuracy).withColumnRenamed("__v", v + suffix)
        out = one if out is None else _joined(out, one, [*by, "quantile"])
    return out


def _joined(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which missing labels of a key equal each other."""
    on = reduce_(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return a.alias("a").join(b.alias("b"), on, how).select(*(F.col(f"a.{c}") for c in a.columns), *(F.col(f"b.{c}") for c in b.columns if c not in keys))


def _selected(df: DataFrame, value: Column, by: Sequence[str], q: Sequence[float], skipna: bool, remainder: int, grid: int, accuracy: int) -> DataFrame:
    from skillcube.sources.io import remove, remove_at_exit, scratch

    spark, keys = df.sparkSession, [*by, "__g"]  # a constant key beside the others, for none at all
    everything = df.select(*by, F.lit(0).alias("__g"), value.alias("__x"))
    rows = everything.where("__x IS NOT NULL")

    def kept(frame: DataFrame) -> tuple[DataFrame, str]:
        """A row per key and quantile, written: rounds do not repeat each other's work."""
        path = scratch(spark, "brackets")
        frame.write.parquet(path)
        remove_at_exit(spark, path)
        return spark.read.schema(frame.schema).parquet(path), path

    x, lo, hi = F.col("__x"), F.col("__lo"), F.col("__hi")
    levels = F.array(*(F.lit(float(p)) for p in q))
    ends = everything.groupBy(*keys).agg(F.count(x).alias("__n"), (F.count(x) == F.count(F.lit(1))).alias("__ok"), F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    sought, sought_at = kept(ends.select(*keys, F.posexplode(levels).alias("__i", "quantile"), "__n", "__ok", ((F.col("__n") - 1) * F.col("quantile")).alias("__r")))
    ids = [*keys, "__i"]

    def counted(brackets: DataFrame) -> DataFrame:
        """keys, __i, __k, __lo, __hi with __below, __at (the lower bracket) and __inside (strictly between) counted."""
        met = _joined(rows, brackets.select(*ids, "__k", "__lo", "__hi"), keys)
        return met.groupBy(*ids, "__k", "__lo", "__hi").agg(F.count_if(x < lo).alias("__below"), F.count_if(x == lo).alias("__at"), F.count_if((x > lo) & (x < hi)).alias("__inside"), F.count_if(x == hi).alias("__last"))

    start = _joined(sought.where("__n > 0"), ends.select(*keys, "__lo", "__hi"), keys).withColumn("__k", F.floor("__r"))
    state, path = kept(counted(start))
    while True:
        open_ = state.where(F.col("__inside") > remainder)
        if open_.isEmpty():
            break
        met = _joined(rows, open_, keys).where((x > lo) & (x < hi))
        cuts = met.groupBy(*open_.columns).agg(F.approx_percentile(x, [k / grid for k in range(grid + 1)], accuracy).alias("__cuts"))
        # ranks p and p + 1 among the values strictly between are sought, -1 being the lower bracket and the last one after them the upper
        p = F.col("__k") - F.col("__below") - F.col("__at")
        first, last = F.floor(p * grid / F.col("__inside")) - 1, F.ceil((p + 1) * grid / F.col("__inside")) + 1
        low = F.when(p >= F.col("__inside"), hi).when(first < 0, lo).otherwise(F.get("__cuts", F.least(first, F.lit(grid)).cast("int")))
        high = F.when(p < -1, lo).when(last > grid, hi).otherwise(F.get("__cuts", F.greatest(last, F.lit(0)).cast("int")))
        drawn, drawn_at = kept(cuts.select(*ids, "__k", low.alias("__lo"), high.alias("__hi"), F.col("__inside").alias("__was")))
        new = _joined(counted(drawn), drawn.select(*ids, "__was"), ids)
        # a bracket is taken if counting confirms it: rank k is not below it, rank k + 1 not above
        upto = F.col("__below") + F.col("__at") + F.col("__inside") + F.when(lo < hi, F.col("__last")).otherwise(0)
        size = _joined(new, sought.select(*ids, "__n"), ids)
        good = size.where((F.col("__below") <= F.col("__k")) & (upto > F.least(F.col("__k") + 1, F.col("__n") - 1)) & (F.col("__inside") < F.col("__was"))).drop("__was", "__n")
        rest = state.alias("s").join(good.alias("g"), [F.col(f"s.{k}").eqNullSafe(F.col(f"g.{k}")) for k in ids], "left_anti")
        state, new_path = kept(rest.unionByName(good))
        if good.isEmpty():
            raise RuntimeError("no bracket was confirmed")
        remove(spark, path)
        remove(spark, drawn_at)
        path = new_path
    counts = _joined(rows, state.select(*ids, "__k", "__lo", "__hi", "__below"), keys).where(x.between(lo, hi)).groupBy(*ids, "__k", "__below", "__x").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*ids).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)) + F.col("__below")
    steps = counts.withColumn("__upto", upto)
    found = steps.groupBy(*ids).agg(F.min(F.when(F.col("__upto") > F.col("__k"), x)).alias("__v0"), F.min(F.when(F.col("__upto") > F.col("__k") + 1, x)).alias("__v1"))
    done = _joined(sought, found, ids, "left")
    part = F.col("__r") - F.floor("__r")
    result = (1 - part) * F.col("__v0") + part * F.coalesce("__v1", "__v0")
    return done.select(*by, "quantile", F.when(F.col("__ok") | F.lit(skipna), result).alias("__v"))


def moments(df: DataFrame, value: str, by: Sequence[str], time: str = "time") -> DataFrame:
    """Raw moments 0 to 2: unweighted spatial means of presence, value and square, then their means over time."""
    x = F.col(value)
    per_time = df.groupBy(*by, time).agg(F.avg(x.isNotNull().cast("double")).alias("zeroth"), F.avg(x).alias("first"), F.avg(x * x).alias("second"))
    return per_time.groupBy(*by).agg(*(F.avg(m).alias(f"{value}_{m}") for m in ("zeroth", "first", "second")))


__all__ = ["averages", "axis", "densify", "ensemble_mean", "fdiv", "latitude_weights", "moments", "quantiles", "spatial_mean", "table", "time_mean"]
