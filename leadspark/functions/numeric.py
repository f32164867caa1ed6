"""Exact numbers: half-up rounding, ranges with open ends, three-valued comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up_ratio(numerator: Column, denominator: Column, scale: int = 1) -> Column:
    """round_half_up(scale * numerator / denominator) on non-negative integers, by integer division; NULL for a zero denominator."""
    n, d = numerator.cast("long"), denominator.cast("long")
    return F.when(d > 0, F.call_function("div", n * (2 * scale) + d, d * 2))


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def coerce_range(value: Column) -> Column:
    """A quantity as JSON text (number, numeric string, {min,max,unit}, {max}, {min}) as (min, max, unit, error).

    A lone maximum starts at 0, a lone minimum is unknown; negative or inverted bounds are errors; else all NULL."""
    v = F.try_parse_json(value)
    number = lambda path: F.try_variant_get(v, path, "decimal(20,6)")
    scalar, low, high = number("$"), number("$.min"), number("$.max")
    low2 = F.when(scalar.isNotNull(), scalar).when(high.isNotNull(), F.coalesce(low, F.lit(0).cast("decimal(20,6)")))
    high2 = F.coalesce(scalar, high)
    bad = (F.coalesce(scalar, low, high) < 0) | (high < 0) | (low > high)
    bad = F.coalesce(bad, F.lit(False))
    keep = lambda c: F.when(~bad, c)
    return F.struct(keep(low2).alias("min"), keep(high2).alias("max"), F.try_variant_get(v, "$.unit", "string").alias("unit"), bad.alias("error"))


def satisfies_max(minimum: Column, ceiling: Column) -> Column:
    """Three-valued: NULL if either is unknown."""
    return minimum <= ceiling


def rate(numerator: Column, denominator: Column, decimals: int = 4) -> Column:
    """Rate in units of 10^-decimals, half-up; NULL for a zero denominator."""
    return half_up_ratio(numerator, denominator, 10**decimals)
