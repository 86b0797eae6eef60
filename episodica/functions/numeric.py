"""Rounding rules and finite-value helpers (all JVM expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Ties go towards +infinity, as ``Math.round`` does in a browser."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale if digits else F.floor(value + F.lit(0.5))


def round_half_even(value: Column, digits: int = 0) -> Column:
    """Ties go to the even neighbour, as Python and NumPy round."""
    return F.bround(value, digits)


def to_finite(value: Column) -> Column:
    """Number or numeric text as a finite DOUBLE, anything else NULL."""
    number = value.try_cast("double")
    return F.when(is_finite(number), number)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def finite_vector(vector: Column, width: Column | int) -> Column:
    """True when the array has ``width`` elements and each is a finite number."""
    return (
        vector.isNotNull()
        & (F.size(vector) == width)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    )


def hold_frames(seconds: Column | float, fps: Column | float) -> Column:
    """Frames needed to cover ``seconds``: never less than one."""
    s = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    f = fps if isinstance(fps, Column) else F.lit(float(fps))
    return F.greatest(F.lit(1), F.ceil(s * f)).cast("bigint")


def percent_count(total: Column, percent: Column | float) -> Column:
    """How many of ``total`` make ``percent`` per cent, halves rounded up."""
    p = percent if isinstance(percent, Column) else F.lit(float(percent))
    return F.floor(total * p / 100.0 + 0.5).cast("bigint")


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(value, lo), hi)


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two equally long arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def max_abs_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
