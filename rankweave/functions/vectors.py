"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value made once a row: a lambda within `use` would make it again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalized(a: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""

    def over(v: Column, size: Column) -> Column:
        return F.when(size == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / size))

    return once(a, lambda v: once(norm(v), lambda size: over(v, size)))


def negative_squared_distance(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return -F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def log_saturation(x: Column) -> Column:
    """ln(1 + relu(x))."""
    return F.log1p(F.greatest(x, F.lit(0.0)))
