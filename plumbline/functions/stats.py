"""Statistics as Column functions, and exact counterparts for driver-side scalars."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard normal quantile of 0.975.
Z = 1.959963984540054


def wilson(correct: Column, total: Column) -> tuple[Column, Column]:
    """A 95 % interval; its ends are exactly 0 and 1 at the extremes, and null without cases."""
    n, k = total.cast("double"), correct.cast("double")
    p = k / n
    middle = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    some = total > 0
    low = F.when(some & (correct == 0), F.lit(0.0)).when(some, F.greatest(F.lit(0.0), middle - half))
    high = F.when(some & (correct == total), F.lit(1.0)).when(some, F.least(F.lit(1.0), middle + half))
    return low, high


def mcnemar(fixed: Column, regressed: Column) -> Column:
    """Two-sided exact McNemar test, for up to 10^8 discordant pairs: time grows with the smaller count, memory doesn't.

    Terms of the binomial tail come from the largest down, each from the one before it, and only as long as they count in a double.
    """
    n, k = (fixed + regressed).cast("long"), F.least(fixed, regressed).cast("long")
    # the log of C(n, k) / 2^n, by Stirling's series for the logs of factorials beyond 20
    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * F.lit(math.log(2)))
    start = F.struct(top.alias("term"), top.alias("sum"))
    # beyond 12 roots of n a term is below 1e-30 of the sum of those before it
    steps = F.least(k, F.ceil(12 * F.sqrt(n.cast("double"))).cast("long") + 40)
    places = F.when(steps > 0, F.sequence(F.lit(0).cast("long"), steps - 1)).otherwise(F.array().cast("array<bigint>"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] * ((k - i).cast("double") / (n - k + i + 1))  # C(n, j - 1) = C(n, j) j / (n - j + 1)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    tail = F.aggregate(places, start, add, lambda a: a["sum"])
    return F.when((n == 0) | (fixed == regressed), F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def log_factorial(x: Column) -> Column:
    x = x.cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(x > 20, series).otherwise(F.log(F.factorial(x.cast("int")).cast("double")))


def mcnemar_exact(fixed: int, regressed: int) -> float:
    """The same with whole numbers of any size."""
    n = fixed + regressed
    if n == 0 or fixed == regressed:
        return 1.0
    return min(1.0, float(2 * sum(math.comb(n, i) for i in range(min(fixed, regressed) + 1)) / 2**n))


def p95(x: Column) -> Column:
    """An aggregate: the 95th percentile by linear interpolation, null below 20 values."""
    return F.when(F.count(x) >= 20, F.percentile(x, F.lit(0.95)))


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    out = F.when(b != 0, a.cast("double") / b)
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.log(x)))
