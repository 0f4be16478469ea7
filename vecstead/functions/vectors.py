"""Vector algebra as column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(x: Column | str) -> Column:
    return _col(x).cast("array<double>")


def total(x: Column | str) -> Column:
    return F.aggregate(_col(x), F.lit(0.0), lambda a, b: a + b)


def dot(x: Column | str, y: Column | str) -> Column:
    return total(F.zip_with(_col(x), _col(y), lambda a, b: a * b))


def norm(x: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(x), F.lit(0.0), lambda a, b: a + b * b))


def normalized(x: Column | str) -> Column:
    """A zero vector stays zero."""
    size = norm(x)
    return F.transform(_col(x), lambda a: a / F.when(size == 0, F.lit(1.0)).otherwise(size))


def cosine_distance(x: Column | str, y: Column | str) -> Column:
    """Null where either vector is zero, so that averages leave it out."""
    return 1 - F.try_divide(dot(x, y), norm(x) * norm(y))


def squared_difference(x: Column | str, y: Column | str) -> Column:
    return total(F.zip_with(_col(x), _col(y), lambda a, b: (a - b) * (a - b)))


def section(x: Column | str, first: int, size: int) -> Column:
    """`size` entries from the `first`, counted from 1."""
    return F.slice(_col(x), first, size)


def quantized(x: Column | str, bits: int, bound: Column | float) -> Column:
    """Each entry clipped to +-bound and rounded to the nearest of 2^bits equally spaced levels; 32 bits change nothing."""
    if bits >= 32:
        return _col(x)
    bound = F.lit(bound) if not isinstance(bound, Column) else bound
    step = 2 * bound / F.lit(float(2**bits - 1))
    return F.transform(_col(x), lambda a: F.when(bound == 0, F.lit(0.0)).otherwise(F.floor((F.least(F.greatest(a, -bound), bound) + bound) / F.when(bound == 0, F.lit(1.0)).otherwise(step) + 0.5) * step - bound))
