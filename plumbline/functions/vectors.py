"""Column functions over vectors and score arrays; all stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x computed once: what a lambda uses of an outer expression is else computed for each element."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, y: s + y)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def l2_normalise(v: Column, epsilon: float = 1e-12) -> Column:
    """x / (|x| + epsilon)."""
    return let(v, lambda w: let(norm(w) + F.lit(epsilon), lambda n: F.transform(w, lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; null if a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / n)))


def maxsim(query: Column, document: Column) -> Column:
    """Late interaction: for each query token the best dot product with a document token, summed."""
    return total(F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d)))))


def mean_vector(v: Column, size: int) -> Column:
    """An aggregate: the mean of vectors of one size, component by component, with map-side partial sums."""
    return F.array(*[F.avg(F.get(v, F.lit(i))) for i in range(size)])


def scale(logit: float) -> float:
    """min(exp(logit), 100)."""
    return min(math.exp(logit), 100.0)


def finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == float("inf")))


def softmax(scores: Column) -> Column:
    """Stable shares of an array of scores; fails on an empty array or a score that isn't finite."""
    ok = (F.size(scores) > 0) & F.forall(scores, lambda s: s.isNotNull() & finite(s))
    shares = let(
        scores,
        lambda s: let(F.array_max(s), lambda top: let(F.transform(s, lambda x: F.exp(x - top)), lambda raised: let(total(raised), lambda z: F.transform(raised, lambda x: x / z)))),
    )
    return F.when(ok, shares).otherwise(F.raise_error(F.lit("scores must be finite and not empty")).cast("array<double>"))


def max_abs_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def scaled_rms_difference(a: Column, b: Column) -> Column:
    """Root mean square of a - b, scaled by the largest difference so that squares can't overflow."""
    def scaled(d: Column, top: Column) -> Column:
        return F.when(top == 0, F.lit(0.0)).otherwise(top * F.sqrt(total(F.transform(d, lambda x: (x / top) * (x / top))) / F.size(d)))

    return let(F.zip_with(a, b, lambda x, y: x - y), lambda d: let(F.array_max(F.transform(d, lambda x: F.abs(x))), lambda top: scaled(d, top)))
