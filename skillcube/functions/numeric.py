"""Arithmetic on columns in which NULL means missing.

NaN never enters a frame (sources turn it into NULL), so conditions and aggregates skip missing values natively. Division and
logarithm follow IEEE limits instead of raising under ANSI mode: x/0 is signed infinity, 0/0 is missing, log 0 is minus infinity.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def fdiv(a: Column, b: Column) -> Column:
    """a / b; signed infinity for a zero divisor, missing for 0/0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / b).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))


def flog(x: Column) -> Column:
    """Natural logarithm; minus infinity at 0, missing below."""
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(-INF))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def strict(agg: Column, x: Column) -> Column:
    """An aggregate that is missing as soon as one of its inputs is."""
    return F.when(F.count(x) == F.count(F.lit(1)), agg)


def mean(x: Column, skipna: bool = False) -> Column:
    return F.avg(x) if skipna else strict(F.avg(x), x)


def weighted_mean(x: Column, w: Column, skipna: bool = False) -> Column:
    """Sum of w * x over the sum of w; with skipna, over the cells that have x."""
    total = F.sum(F.when(x.isNotNull(), w))
    value = fdiv(F.sum(w * x), total)
    return value if skipna else strict(value, x)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


#: Hart's rational approximation of the normal tail as given by West (2005), highest power first.
_P = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_Q = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_SPLIT, _SCALE = 7.07106781186547, 2.506628274631


def _horner(a: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * a + c
    return out


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function, absolute error below 1e-15; built of exp, + , * and / alone."""
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    fraction = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    tail = F.when(a > 37, F.lit(0.0)).when(a < _SPLIT, e * _horner(a, _P) / _horner(a, _Q)).otherwise(e / (fraction * _SCALE))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_cdf_sql(x: str) -> str:
    """The same approximation as an SQL expression."""
    a = f"abs({x})"

    def horner(cs: tuple[float, ...]) -> str:
        out = f"{cs[0]!r}::DOUBLE"
        for c in cs[1:]:
            out = f"({out}*{a}+{c!r}::DOUBLE)"
        return out

    e = f"exp(-{a}*{a}/2)"
    tail = f"CASE WHEN {a} > 37 THEN 0 WHEN {a} < {_SPLIT!r} THEN {e}*{horner(_P)}/{horner(_Q)} ELSE {e}/({_SCALE!r}*({a}+1/({a}+2/({a}+3/({a}+4/({a}+0.65)))))) END"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN 1-({tail}) ELSE ({tail}) END)"


def norm_ppf(q: float) -> float:
    """Inverse of the standard normal distribution function, for the driver."""
    return NormalDist().inv_cdf(q)


def gradient(f: Column, x: Column, window) -> Column:
    """Derivative of f by x along a window's order: second order inside, one-sided at the ends."""
    fm, fp, xm, xp = F.lag(f).over(window), F.lead(f).over(window), F.lag(x).over(window), F.lead(x).over(window)
    s, d = x - xm, xp - x
    inner = fdiv(s * s * fp + (d * d - s * s) * f - d * d * fm, s * d * (s + d))
    return F.when(xm.isNull(), fdiv(fp - f, d)).when(xp.isNull(), fdiv(f - fm, s)).otherwise(inner)


def panel(f: Column, x: Column, window) -> Column:
    """Area of the trapezoid from a row to the next one; missing at the last row."""
    return (f + F.lead(f).over(window)) / 2 * (F.lead(x).over(window) - x)
