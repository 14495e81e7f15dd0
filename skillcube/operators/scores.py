"""Scores. Each is a pointwise column (or several) with the way it is reduced; the planner fuses those that share a frame.

Columns of an aligned frame: v the forecast, v_t the truth, v_c the climatology, w the cell's weight, with region if regions apply.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillcube.functions.numeric import fdiv, flog, mean, norm_cdf, norm_pdf, norm_ppf, strict
from skillcube.operators.reduce import spatial_mean, time_mean


@dataclass
class Score:
    """points: columns to average over space; combine: the score from those averages, before the mean over time."""

    name: str
    points: dict[str, Column]
    combine: Column | None = None
    skipna: bool = False
    meta: dict = field(default_factory=dict)

    def value(self) -> Column:
        return self.combine if self.combine is not None else F.col(next(iter(self.points)))


# ---- deterministic


def mse(v: str) -> Score:
    return Score("mse", {f"mse_{v}": (F.col(v) - F.col(f"{v}_t")) ** 2})


def rmse_sqrt_before_time_avg(v: str) -> Score:
    return Score("rmse", {f"se_{v}": (F.col(v) - F.col(f"{v}_t")) ** 2}, F.sqrt(F.col(f"se_{v}")))


def wind_vector_mse(u: str, v: str, name: str) -> Score:
    return Score("mse", {f"vmse_{name}": (F.col(u) - F.col(f"{u}_t")) ** 2 + (F.col(v) - F.col(f"{v}_t")) ** 2})


def wind_vector_rmse_sqrt_before_time_avg(u: str, v: str, name: str) -> Score:
    s = wind_vector_mse(u, v, name)
    return Score("rmse", s.points, F.sqrt(F.col(f"vmse_{name}")))


def mae(v: str) -> Score:
    return Score("mae", {f"mae_{v}": F.abs(F.col(v) - F.col(f"{v}_t"))})


def bias(v: str) -> Score:
    return Score("bias", {f"bias_{v}": F.col(v) - F.col(f"{v}_t")})


def acc(v: str) -> Score:
    """Anomaly correlation; anomalies from climatology are not centred again."""
    f, t = F.col(v) - F.col(f"{v}_c"), F.col(f"{v}_t") - F.col(f"{v}_c")
    names = [f"acc_{v}_{k}" for k in ("ft", "ff", "tt")]
    return Score("acc", dict(zip(names, (f * t, f * f, t * t), strict=True)), fdiv(F.col(names[0]), F.sqrt(F.col(names[1]) * F.col(names[2]))))


def spatial(df: DataFrame, points: dict[str, Column], by: Sequence[str], skipna: bool = False) -> DataFrame:
    """Scores per grid cell: pointwise columns averaged over time alone."""
    return df.groupBy(*by).agg(*(mean(p, skipna).alias(k) for k, p in points.items()))


def evaluate_scores(df: DataFrame, scores: Sequence[Score], by: Sequence[str], time: str, skipna: bool = False, over_time: bool = True) -> DataFrame:
    """All scores in one spatial aggregate and one temporal aggregate. by: what stays, time apart."""
    points: dict[str, Column] = {}
    for s in scores:
        points |= s.points
    strict_points = {k: p for s in scores for k, p in s.points.items() if not (s.skipna or skipna)}
    loose = {k: p for k, p in points.items() if k not in strict_points}
    keys = [*by, time]
    per_time = None
    for part, loose_ in ((strict_points, False), (loose, True)):
        if part:
            one = spatial_mean(df, part, keys, loose_)
            per_time = one if per_time is None else per_time.join(one, keys)
    names = [f"{s.name}_{i}" for i, s in enumerate(scores)]
    values = per_time.select(*keys, *(s.value().alias(n) for n, s in zip(names, scores, strict=True)))
    out = time_mean(values, names, by, skipna) if over_time else values
    return out.withColumnsRenamed({n: s.meta.get("column", s.name) for n, s in zip(names, scores, strict=True)})


# ---- SEEPS


def seeps_points(v: str, threshold: str, p1: str, dry_mm: float = 0.25, min_p1: float = 0.1, max_p1: float = 0.85) -> Column:
    """SEEPS of a cell. Dry: below dry_mm / 1000; light: above it and below the threshold; heavy: from the threshold on. A value equal to the dry limit
    is in no category. Missing unless min_p1 < p1 < max_p1 and both amounts are there."""
    d, h, p = dry_mm / 1000, F.col(threshold), F.col(p1)

    def kinds(x: Column) -> list[Column]:
        return [(x < d).cast("double"), ((x > d) & (x < h)).cast("double"), (x >= h).cast("double")]

    f, t = kinds(F.col(v)), kinds(F.col(f"{v}_t"))
    a, b, c = fdiv(F.lit(1.0), 1 - p), fdiv(F.lit(1.0), p), fdiv(F.lit(3.0), 2 + p)
    zero = F.lit(0.0)
    matrix = [[zero, a, 4 * a], [b, zero, 3 * a], [b + c, c, zero]]
    total = sum((f[i] * t[j] * matrix[i][j] for i in range(3) for j in range(3) if i != j), zero) / 2
    return F.when((p > min_p1) & (p < max_p1), total)


def seeps(v: str, threshold: str, p1: str, **limits: float) -> Score:
    return Score("seeps", {f"seeps_{v}": seeps_points(v, threshold, p1, **limits)}, skipna=True)


# ---- ensembles


def with_ranks(df: DataFrame, x: str, cell: Sequence[str], member: str = "member", name: str = "rank") -> DataFrame:
    """Rank of a member within its cell, from 1, missing values last."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*cell).orderBy(F.asc_nulls_last(x), member)))


def ensemble_cells(df: DataFrame, x: str, cell: Sequence[str], keep: Sequence[str] = (), member: str = "member", truth: str | None = None, skipna: bool = False) -> DataFrame:
    """One row per cell: n members, mean, var (ddof 1), crps_skill, crps_spread, and the first of the columns to keep.

    The spread is the mean absolute difference of member pairs by ranks, O(n log n); with skipna its mean skips missing members but
    n and ranks do not change. One window and one aggregate on the same keys share a shuffle.
    """
    t = F.col(truth or f"{x}_t")
    ranked = with_ranks(df, x, cell, member)
    n = F.count(F.lit(1))
    spread = F.when(n < 2, F.lit(0.0)).otherwise(fdiv(2 * F.avg(F.col("rank") * F.col(x)) * 2 - (n + 1) * F.avg(x) * 2, n - 1))
    whole = lambda agg, v: agg if skipna else strict(agg, v)
    return ranked.groupBy(*cell).agg(
        n.alias("n"), whole(F.avg(x), F.col(x)).alias("mean"), whole(F.var_samp(x), F.col(x)).alias("var"), whole(F.avg(F.abs(t - F.col(x))), t - F.col(x)).alias("crps_skill"),
        F.when(n < 2, F.lit(0.0)).otherwise(whole(spread, F.col(x))).alias("crps_spread"), F.first(t).alias("truth"), *(F.first(k).alias(k) for k in keep),
    )


def ensemble_cells_of(df: DataFrame, variables: Sequence[str], cell: Sequence[str], member: str = "member", skipna: bool = False, keep: Sequence[str] = (), want: Sequence[str] = ("scores",)) -> DataFrame:
    """As ensemble_cells for several variables at once: one shuffle for all. A variable's columns begin with its name and two underscores.

    A cell's members are sorted inside it, so ranks need no window. want: scores (statistics of the members), members (__members, an array of
    the members and their values by member, for energy_scores) and ranks (the truth's rank, for rank_histograms).
    """
    n = F.count(F.lit(1))
    whole = lambda agg, v: agg if skipna else strict(agg, v)
    columns = [n.alias("n")]
    for v in variables:
        x, t = F.col(v), F.col(f"{v}_t")
        columns.append(F.first(t).alias(f"{v}__truth"))
        if "scores" in want:
            values = F.array_sort(F.collect_list(x))
            ranked = F.aggregate(F.transform(values, lambda y, i: y * (i + 1)), F.lit(0.0), lambda a, y: a + y) / F.nullif(F.count(x), F.lit(0))
            spread = whole(fdiv(4 * ranked - 2 * (n + 1) * F.avg(x), n - 1), x)
            columns += [
                n.alias(f"{v}__n"), whole(F.avg(x), x).alias(f"{v}__mean"), whole(F.var_samp(x), x).alias(f"{v}__var"), whole(F.avg(F.abs(t - x)), t - x).alias(f"{v}__crps_skill"),
                F.when(n < 2, F.lit(0.0)).otherwise(spread).alias(f"{v}__crps_spread"),
            ]
        if "ranks" in want:
            columns.append(F.sum((x.isNotNull() & (t.isNull() | (x < t))).cast("int")).alias(f"{v}__rank"))
    if "members" in want:
        columns.append(F.array_sort(F.collect_list(F.struct(F.col(member).alias("member"), *variables))).alias("__members"))
    return df.groupBy(*cell).agg(*columns, *(F.first(k).alias(k) for k in keep))


def zero_variance_of_one(var: str = "var", n: str = "n") -> Column:
    """Variance of an ensemble of one counts as zero."""
    return F.when(F.col(n) == 1, F.lit(0.0)).otherwise(F.col(var))


# p: what the columns of a variable begin with (see ensemble_cells_of)


def crps(p: str = "") -> Score:
    return Score("crps", {f"{p}p_crps": F.col(f"{p}crps_skill") - F.col(f"{p}crps_spread") / 2})


def crps_skill(p: str = "") -> Score:
    return Score("crps_skill", {f"{p}p_crps_skill": F.col(f"{p}crps_skill")})


def crps_spread(p: str = "") -> Score:
    return Score("crps_spread", {f"{p}p_crps_spread": F.col(f"{p}crps_spread")})


def ensemble_mean_mse(p: str = "") -> Score:
    return Score("ensemble_mean_mse", {f"{p}p_em_mse": (F.col(f"{p}truth") - F.col(f"{p}mean")) ** 2})


def ensemble_mean_rmse_sqrt_before_time_avg(p: str = "") -> Score:
    return Score("ensemble_mean_rmse", ensemble_mean_mse(p).points, F.sqrt(f"{p}p_em_mse"))


def debiased_ensemble_mean_mse(p: str = "") -> Score:
    """Missing for an ensemble of one."""
    return Score("debiased_ensemble_mean_mse", {f"{p}p_dem_mse": (F.col(f"{p}truth") - F.col(f"{p}mean")) ** 2 - F.col(f"{p}var") / F.col(f"{p}n")})


def ensemble_variance(p: str = "") -> Score:
    return Score("ensemble_variance", {f"{p}p_var": zero_variance_of_one(f"{p}var", f"{p}n")})


def ensemble_stddev_sqrt_before_time_avg(p: str = "") -> Score:
    return Score("ensemble_stddev", ensemble_variance(p).points, F.sqrt(f"{p}p_var"))


def energy_scores(cells: DataFrame, variables: Sequence[str], by: Sequence[str], time: str, skipna: bool = False) -> DataFrame:
    """{v}__energy_score, {v}__energy_skill and {v}__energy_spread per key: norms over space per member, then means over members, then over time.

    cells: those of ensemble_cells_of with members and the weight w. The spread takes neighbouring members (k, k + 1); a single member has none.
    """
    both = F.transform("__members", lambda m, i: F.struct(m.alias("m"), F.get("__members", i + 1).alias("next")))
    rows = cells.select(*by, time, "w", *(f"{v}__truth" for v in variables), F.explode(both).alias("__b"))
    more = F.col("__b.next").isNotNull()
    points = {f"s_{v}": (F.col(f"__b.m.{v}") - F.col(f"{v}__truth")) ** 2 for v in variables} | {f"d_{v}": (F.col(f"__b.m.{v}") - F.col(f"__b.next.{v}")) ** 2 for v in variables}
    rows = rows.select(*by, time, "w", F.col("__b.m.member").alias("__member"), more.alias("__more"), *(p.alias(k) for k, p in points.items()))

    def norm(c: str) -> Column:
        x, w = F.col(c), F.col("w")
        value = fdiv(F.sum(w * x), F.sum(F.when(x.isNotNull(), w)))
        there = F.count_if("__more") if c[0] == "d" else F.count(F.lit(1))
        return F.sqrt(value if skipna else F.when(F.count(x) == there, value))

    norms = rows.groupBy(*by, time, "__member").agg(*(norm(c).alias(c) for c in points), F.max("__more").alias("__more"))
    pairs = F.count_if("__more")
    out = []  # a spread that has no pairs, or a missing member, is 0
    for v in variables:
        spread = F.avg(f"d_{v}") if skipna else F.when(F.count(f"d_{v}") == pairs, F.avg(f"d_{v}"))
        out += [mean(F.col(f"s_{v}"), skipna).alias(f"{v}__energy_skill"), F.coalesce(spread, F.lit(0.0)).alias(f"{v}__energy_spread")]
    times = norms.groupBy(*by, time).agg(*out).withColumns({f"{v}__energy_score": F.col(f"{v}__energy_skill") - F.col(f"{v}__energy_spread") / 2 for v in variables})
    return time_mean(times, [f"{v}__{k}" for v in variables for k in ("energy_score", "energy_skill", "energy_spread")], by, skipna)


def energy_score(df: DataFrame, x: str, by: Sequence[str], time: str, member: str = "member", skipna: bool = False) -> DataFrame:
    """energy_score, energy_skill and energy_spread of one variable of a weighted frame (see energy_scores)."""
    cells = ensemble_cells_of(df, [x], [*by, time, "latitude", "longitude"], member, skipna, ["w"], ["members"])
    return energy_scores(cells, [x], by, time, skipna).select(*by, *(F.col(f"{x}__{k}").alias(k) for k in ("energy_score", "energy_skill", "energy_spread")))


def rank_histograms(cells: DataFrame, variables: Sequence[str], by: Sequence[str], n_members: int) -> DataFrame:
    """bin and a column of frequencies per variable, as rank_histogram without ties broken; cells: those of ensemble_cells_of with ranks."""
    bins = range(n_members + 1)
    shares = cells.groupBy(*by).agg(*(F.array(*(F.avg((F.col(f"{v}__rank") == i).cast("double")) for i in bins)).alias(v) for v in variables))
    return shares.select(*by, F.posexplode(F.arrays_zip(*variables)).alias("bin", "__f")).select(*by, "bin", *(F.col(f"__f.{v}").alias(v) for v in variables))


def rank_histogram(df: DataFrame, x: str, cell: Sequence[str], by: Sequence[str], n_members: int, num_bins: int | None = None, break_ties_randomly: bool = False, seed: int = 0) -> DataFrame:
    """bin, frequency: share of cells per rank bin of the truth among its members, 0 to n; missing values count as largest.

    Ties: the truth takes its lowest rank, or with break_ties_randomly one drawn evenly from those it shares.
    """
    bins = num_bins or n_members + 1
    if (n_members + 1) % bins:
        raise ValueError("bins must divide the members plus one")
    t = F.col(f"{x}_t")
    below = F.sum((F.col(x).isNotNull() & (t.isNull() | (F.col(x) < t))).cast("int"))
    equal = F.sum((F.col(x).eqNullSafe(t)).cast("int"))
    ranks = df.groupBy(*cell).agg(below.alias("rank"), equal.alias("ties"))
    if break_ties_randomly:
        # drawn from the cell's labels, so that it does not change with partitions
        ranks = ranks.withColumn("rank", F.col("rank") + F.pmod(F.xxhash64(F.lit(seed), *(F.col(c).cast("string") for c in cell)), F.col("ties") + 1))
    counts = ranks.withColumn("bin", F.floor(F.col("rank") / ((n_members + 1) // bins)).cast("int")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("k"))
    one_hot = [F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("k"))), F.lit(0)) / F.sum("k") for i in range(bins)]
    rows = counts.groupBy(*by).agg(F.array(*one_hot).alias("f"))
    return rows.select(*by, F.posexplode("f").alias("bin", "frequency"))


def central_reliability(histogram: DataFrame, by: Sequence[str], num_bins: int) -> DataFrame:
    """desired_prob, probability: cumulative share of symmetric pairs of bins from the centre outwards."""
    if num_bins < 3:
        raise ValueError("central reliability needs three bins")
    step = F.floor(F.abs(F.col("bin") - (num_bins - 1) / 2) + (0.5 if num_bins % 2 == 0 else 0)).cast("int")
    pairs = histogram.withColumn("step", step).groupBy(*by, "step").agg(F.sum("frequency").alias("p"), F.count(F.lit(1)).alias("k"))
    run = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return pairs.select(*by, (F.sum("k").over(run) / num_bins).alias("desired_prob"), F.sum("p").over(run).alias("probability"))


# ---- Gaussian forecasts


def _z(v: str) -> Column:
    return fdiv(F.col(v) - F.col(f"{v}_t"), F.col(f"{v}_std"))


def gaussian_crps(v: str) -> Score:
    z = _z(v)
    return Score("gaussian_crps", {f"g_crps_{v}": F.col(f"{v}_std") * (z * (2 * norm_cdf(z) - 1) + 2 * norm_pdf(z) - 1 / sqrt(pi))})


def gaussian_variance(v: str) -> Score:
    return Score("gaussian_variance", {f"g_var_{v}": F.col(f"{v}_std") ** 2})


def _below(v: str, h: str) -> Column:
    return norm_cdf(fdiv(F.col(h) - F.col(v), F.col(f"{v}_std")))


def gaussian_brier(v: str, h: str = "threshold") -> Score:
    return Score("gaussian_brier", {f"g_brier_{v}": ((1 - _below(v, h)) - (F.col(f"{v}_t") > F.col(h)).cast("double")) ** 2})


def gaussian_ignorance(v: str, h: str = "threshold") -> Score:
    p = _below(v, h)
    return Score("gaussian_ignorance", {f"g_ign_{v}": F.when(F.col(f"{v}_t") > F.col(h), -flog(1 - p)).when(F.col(f"{v}_t").isNotNull(), -flog(p))})


def gaussian_rps_points(v: str, h: str = "threshold") -> Column:
    return (_below(v, h) - (F.col(f"{v}_t") < F.col(h)).cast("double")) ** 2


# ---- thresholds


def with_quantile_threshold(df: DataFrame, climatology: DataFrame, v: str | Sequence[str], space: Sequence[str], q: Sequence[float], time: str = "time", tolerance: float = 0.01) -> DataFrame:
    """A row per requested quantile with the climatology's value at the label nearest to it, all quantiles in one pass.

    The value is the column threshold, or for several variables threshold_v of each, which all come from one join.
    """
    from skillcube.operators.align import calendar_keys

    have = sorted(r[0] for r in climatology.select("quantile").distinct().collect())
    chosen = []
    for x in q:
        best = min(have, key=lambda h: abs(h - x), default=None)
        if best is None or abs(best - x) > tolerance:
            raise KeyError(f"quantile {x}")
        chosen.append((float(x), best))
    wanted = F.explode(F.filter(F.array(*(F.struct(F.lit(a).alias("q"), F.lit(b).alias("label")) for a, b in chosen)), lambda s: s["label"] == F.col("quantile")))
    table = climatology.withColumn("__q", wanted)
    keys = calendar_keys(time, "hour" in climatology.columns)
    values = [F.col(f"{v}_quantile").alias("threshold")] if isinstance(v, str) else [F.col(f"{x}_quantile").alias(f"threshold_{x}") for x in v]
    table = table.select(*keys, *space, F.col("__q.q").alias("quantile"), *values)
    return df.withColumns(keys).join(table, [*keys, *space]).drop(*keys)


def with_gaussian_threshold(df: DataFrame, v: str | Sequence[str], q: Sequence[float]) -> DataFrame:
    """A row per quantile with the threshold mean + quantile * std of the climatology columns v_c and v_std_c; columns as in with_quantile_threshold."""
    options = F.array(*(F.struct(F.lit(float(x)).alias("quantile"), F.lit(norm_ppf(x)).alias("z")) for x in q))
    rows = df.withColumn("__q", F.explode(options))
    values = {"threshold": v} if isinstance(v, str) else {f"threshold_{x}": x for x in v}
    return rows.withColumns({"quantile": F.col("__q.quantile")} | {h: F.col(f"{x}_c") + F.col("__q.z") * F.col(f"{x}_std_c") for h, x in values.items()}).drop("__q")


THRESHOLDS = {"quantile": with_quantile_threshold, "gaussian_quantile": with_gaussian_threshold}


def _exceedances(x: str, h: str, p: str = "") -> list[Column]:
    """n, p (share above, missing if a member is), p_var, p_some and below_some (missing members count as false), above and truth_below (truth)."""
    above = F.when(F.col(x).isNotNull() & F.col(h).isNotNull(), (F.col(x) > F.col(h)).cast("double"))
    t = F.col(f"{x}_t")
    return [
        F.count(F.lit(1)).alias(f"{p}n"), strict(F.avg(above), above).alias(f"{p}p"), strict(F.var_samp(above), above).alias(f"{p}p_var"), F.avg(F.coalesce(above, F.lit(0.0))).alias(f"{p}p_some"),
        F.avg(F.coalesce((F.col(x) < F.col(h)).cast("double"), F.lit(0.0))).alias(f"{p}below_some"), F.first((t > F.col(h)).cast("double")).alias(f"{p}above"),
        F.first(F.coalesce((t < F.col(h)).cast("double"), F.lit(0.0))).alias(f"{p}truth_below"),
    ]


def exceedance_cells(df: DataFrame, x: str, cell: Sequence[str], keep: Sequence[str] = (), h: str = "threshold") -> DataFrame:
    """One row per cell and threshold (see _exceedances)."""
    return df.groupBy(*cell).agg(*_exceedances(x, h), *(F.first(k).alias(k) for k in keep))


def exceedance_cells_of(df: DataFrame, variables: Sequence[str], cell: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """As exceedance_cells for several variables with thresholds threshold_v, in one aggregate; columns begin with the variable and two underscores."""
    return df.groupBy(*cell).agg(*(c for v in variables for c in _exceedances(v, f"threshold_{v}", f"{v}__")), *(F.first(k).alias(k) for k in keep))


def brier(p: str = "") -> Score:
    return Score("brier", {f"{p}p_brier": (F.col(f"{p}p") - F.col(f"{p}above")) ** 2})


def debiased_brier(p: str = "") -> Score:
    return Score("debiased_brier", {f"{p}p_dbrier": (F.col(f"{p}p") - F.col(f"{p}above")) ** 2 - F.col(f"{p}p_var") / F.col(f"{p}n")})


def ignorance(p: str = "") -> Score:
    some, above = F.col(f"{p}p_some"), F.col(f"{p}above")
    return Score("ignorance", {f"{p}p_ign": F.when(above == 1, -flog(some)).when(above == 0, -flog(1 - some))})


def rps_points(p: str = "") -> Column:
    return (F.col(f"{p}below_some") - F.col(f"{p}truth_below")) ** 2


def sum_over_quantiles(per_quantile: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Sum over the quantile dimension; missing counts as zero."""
    return per_quantile.groupBy(*by).agg(F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias(value))
