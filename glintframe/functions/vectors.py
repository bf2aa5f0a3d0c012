"""Vector arithmetic as Column expressions; nothing here leaves the JVM.

``precision`` is ``"double"`` (sums in float64, the default) or ``"float"``
(sequential float32, as a scalar single-precision loop gives).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT_EPSILON = 1.1920928955078125e-07


def _kind(precision: str) -> str:
    if precision not in ("double", "float"):
        raise ValueError(f"unknown precision {precision!r}")
    return precision


def dot(a: Column, b: Column, precision: str = "double") -> Column:
    """Inner product, added in order; null if a vector or an element is null, or if the widths differ."""
    k = _kind(precision)
    products = F.zip_with(a, b, lambda x, y: (x.cast(k) * y.cast(k)).cast(k))
    return F.aggregate(products, F.lit(0.0).cast(k), lambda s, x: (s + x).cast(k))


def norm(v: Column, precision: str = "double") -> Column:
    return F.sqrt(dot(v, v, precision)).cast(_kind(precision))


def _divided(v: Column, by: Column, k: str) -> Column:
    return F.transform(v, lambda x: (x.cast(k) / by).cast(k))


def normalise(v: Column, zero: str = "null", precision: str = "double") -> Column:
    """``v`` scaled to length 1.

    ``zero`` names what a vector without direction gives: ``"null"`` (length
    not finite or at most the float epsilon), ``"keep"`` (an exactly zero
    vector stays as it is), ``"floor"`` (the length counts as at least 1e-8).
    """
    k = _kind(precision)
    n = norm(v, precision)
    if zero == "null":
        good = ~F.isnan(n) & (n < F.lit(float("inf"))) & (n > FLOAT_EPSILON)
        return F.when(good, _divided(v, n, k))
    if zero == "keep":
        return _divided(v, F.when(n == 0, F.lit(1.0)).otherwise(n).cast(k), k)
    if zero == "floor":
        return _divided(v, F.greatest(n, F.lit(1e-8).cast(k)), k)
    raise ValueError(f"unknown zero policy {zero!r}")


def compose(positive: Column, negative: Column, weight: Column | float, precision: str = "double") -> Column:
    """``positive - weight * negative``; ``positive`` where there is no negative vector."""
    k = _kind(precision)
    w = (weight if isinstance(weight, Column) else F.lit(weight)).cast(k)
    return F.when(negative.isNull(), positive.cast(f"array<{k}>")).otherwise(F.zip_with(positive, negative, lambda p, n: (p.cast(k) - (w * n.cast(k)).cast(k)).cast(k)))


def project(v: Column, weights: list[list[float]], precision: str = "double") -> Column:
    """``v`` times a matrix of len(v) rows, row by row; null if the width of ``v`` isn't the number of rows."""
    k = _kind(precision)
    if not weights or len({len(r) for r in weights}) != 1:
        raise ValueError("the matrix needs rows of one width")
    width = len(weights[0])
    matrix = F.array(*[F.array(*[F.lit(float(x)).cast(k) for x in row]) for row in weights])
    start = F.array(*[F.lit(0.0).cast(k)] * width)
    out = F.aggregate(F.zip_with(v, matrix, lambda x, row: F.transform(row, lambda w: (w * x.cast(k)).cast(k))), start, lambda acc, row: F.zip_with(acc, row, lambda a, b: (a + b).cast(k)))
    return F.when(F.size(v) == len(weights), out)


def dequantise(codes: Column, scale: Column | float, zero_point: Column | int) -> Column:
    """``(code - zero_point) * scale`` of every code, in float32."""
    s = (scale if isinstance(scale, Column) else F.lit(scale)).cast("float")
    z = (zero_point if isinstance(zero_point, Column) else F.lit(zero_point)).cast("int")
    return F.transform(codes, lambda c: ((c.cast("int") - z).cast("float") * s).cast("float"))


def max_difference(a: Column, b: Column) -> Column:
    """Largest absolute difference of two vectors' elements."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def finite(v: Column) -> Column:
    """Whether no element is null, NaN or infinite."""
    return F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast("float")), F.lit(False)))
