"""Vector arithmetic on array columns: built-in higher-order functions, no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    """Storage may be FLOAT; all mathematics is DOUBLE."""
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is all zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def normalize(v: Column) -> Column:
    """Unit vector; an all-zero vector stays as it is."""
    length = norm(v)
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)))


def concatenated(*parts: Column) -> Column:
    """The "mix" of several encoders' vectors, side by side."""
    return F.concat(*parts)


def tidy(value: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def tidy_small(value: Column, digits: int = 6) -> Column:
    """As ``tidy`` for sizes below 10^9, in plain arithmetic: rounding by decimals takes seven times as long, most of the time of all pairs."""
    scale = 10.0**digits
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale + F.lit(0.0)


def padded(v: Column, size: Column | int) -> Column:
    """Zeros appended up to ``size`` elements."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(v, F.array_repeat(F.lit(0.0).cast("double"), F.greatest(size - F.size(v), F.lit(0)).cast("int")))


def reshaped(v: Column) -> Column:
    """Rows of a heat map: floor(sqrt(n)) rows of n / rows values, which must be whole."""
    rows = F.floor(F.sqrt(F.size(v))).cast("int")
    width = (F.size(v) / rows).cast("int")
    whole = F.assert_true(rows * width == F.size(v), F.lit("a heat map needs a rectangular shape"))
    return F.when(whole.isNull(), F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.slice(v, r * width + 1, width)))
