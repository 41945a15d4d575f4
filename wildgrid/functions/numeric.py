"""Numeric expressions: vectors, shares, bins, tiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed from the left."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def unit(vector: Column) -> Column:
    """The vector divided by its norm; a zero vector has no direction and gives NULLs.

    The norm is bound as the element of a one-element array. As a plain column it
    would be computed again for every component.
    """
    scaled = F.transform(F.array(norm(vector)), lambda n: F.transform(vector, lambda x: F.try_divide(x.cast("double"), n)))
    return F.get(scaled, F.lit(0))


def round_to(value: Column, places: int) -> Column:
    """Nearest number of that many places to the exact binary value, ties to even.

    ``bround`` rounds the shortest decimal text instead and so moves a value such
    as 0.21315 the wrong way. Here the distance to the midpoint between two
    results is computed without error: the value is split into a float and a
    remainder, whose products with the scale are exact.
    """
    scale = 10.0**places
    x = value.cast("double")
    low = F.floor(x * scale)
    high_part = x.cast("float").cast("double")
    beyond = high_part * (2 * scale) - (2 * low + 1).cast("double")
    short = (high_part - x) * (2 * scale)
    up = F.when(beyond > short, 1).when(beyond < short, 0).otherwise(F.abs(low % 2))
    return (low + up) / F.lit(scale)


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """Rounded percentage, 0 where the whole is 0."""
    return F.coalesce(round_to(F.try_divide(part, whole) * 100, places), F.lit(0.0))


def power_bin(value: Column, top: Column, exponent: float = 0.4, last_bin: int = 5) -> Column:
    """Bin 0..last_bin on a power scale of value/top; NULL for a value of 0 or NULL."""
    scaled = F.floor(F.pow(value / top, F.lit(exponent)) * last_bin)
    return F.when(value != 0, F.least(scaled, F.lit(last_bin)).cast("int"))


def mean_of_two(a: Column, b: Column) -> Column:
    return (a + b) / 2


def blend(weight: float, a: Column, b: Column) -> Column:
    return F.lit(weight) * a + F.lit(1 - weight) * b


def confidence_tier(score: Column, margin: Column) -> Column:
    # Tier names and their thresholds.
    return (
        F.when((score > 0.85) & (margin > 0.03), F.lit("alta"))
        .when(score > 0.70, F.lit("media"))
        .otherwise(F.lit("baja"))
    )


def page_count(total: Column, page_size: int) -> Column:
    return F.greatest(F.ceil(total / F.lit(page_size)), F.lit(1)).cast("int")
