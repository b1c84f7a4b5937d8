"""Rounding, scaling and truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From this magnitude on a double has no digits behind the point.
_WHOLE = float(1 << 52)


def floor_round(x: Column, digits: int) -> Column:
    """Round half up by way of floor: the same double in every engine. Null stays null."""
    m = float(10**digits)
    return F.floor(x * F.lit(m) + F.lit(0.5)) / F.lit(m)


def exact_round(x: Column, digits: int) -> Column:
    """Round the exact binary value, halves to even, as Python's ``round`` does; the built-in functions round the decimal
    text. Null, infinite and not-a-number values stay. Built-in arithmetic: the value times twice 10**digits is taken as a
    product and its error (the factor is short, so splitting the value makes both exact), and compared with the odd
    number in the middle between two candidates."""
    m = float(10**digits)
    x = x.cast("double")
    a = F.abs(x)
    split = a * F.lit(134217729.0)
    high = split - (split - a)
    product = a * F.lit(2 * m)
    error = (high * F.lit(2 * m) - product) + (a - high) * F.lit(2 * m)
    below = F.floor(product / 2).cast("double")
    over = product - F.lit(2.0) * below - F.lit(1.0)
    odd = below - F.lit(2.0) * F.floor(below / 2).cast("double")
    up = F.when((over > 0) | ((over == 0) & (error > 0)), F.lit(1.0)).when((over == 0) & (error == 0), odd).otherwise(F.lit(0.0))
    rounded = (below + up) / F.lit(m)
    plain = F.isnan(x) | (a >= _WHOLE / m)
    return F.when(plain, x).when(x < 0, -rounded).otherwise(rounded)


def fixed(x: Column, digits: int) -> Column:
    """Text with so many digits behind the point, from the exact binary value."""
    return F.format_string(f"%.{digits}f", exact_round(x, digits))


def fit_to_max(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Width and height scaled so that the larger is ``most``; unchanged if it isn't larger. Truncates."""
    largest = F.greatest(width, height)
    ratio = F.lit(float(most)) / largest
    pick = lambda x: F.when(largest > most, (x * ratio).cast("int")).otherwise(x.cast("int"))
    return pick(width), pick(height)


def percent_of_max(values: Column, whole: Column | None = None) -> Column:
    """Each entry as a whole percentage of the largest, truncated toward zero; null unless all are positive. An empty array
    stays empty, and so does one of whole numbers only (``whole``), whatever their signs."""
    top = F.array_max(values)
    scaled = F.when(F.exists(values, lambda v: v <= 0), F.lit(None)).otherwise(F.transform(values, lambda v: (v / top * 100).cast("int")))
    return scaled if whole is None else F.when(whole, F.transform(values, lambda v: v.cast("int"))).otherwise(scaled)


def percent_of_max_json(raw: Column) -> Column:
    """``percent_of_max`` of a JSON array of numbers; it is one of whole numbers if none is written with a point."""
    texts = F.from_json(raw, "array<string>")
    return percent_of_max(F.transform(texts, lambda t: t.cast("double")), F.forall(texts, lambda t: t.rlike("^-?[0-9]+$")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two epoch seconds."""
    return (end - start) * 1000
