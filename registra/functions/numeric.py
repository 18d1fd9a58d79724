"""Number expressions: money, rounding, scales and the map projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thousands of roubles down to the kopeck. Decimal sums do not depend on the order of rows, so
# results are the same however the data is partitioned.
MONEY = "decimal(22,5)"


def money_sum(c: Column) -> Column:
    """Exact sum of money as a double; null when there is nothing to add."""
    return F.sum(c.cast(MONEY)).cast("double")


def money_avg(c: Column) -> Column:
    """Exact sum divided by the number of values."""
    return money_sum(c) / F.count(c)


def round_dec(c: Column, n: int) -> Column:
    """Round half away from zero on the decimal value."""
    return F.round(c.cast("decimal(38,15)"), n).cast("double")


def sqrt_scale(c: Column, top: Column, lo: float, k: float, base: float = 0.0,
               hi: float | None = None) -> Column:
    """Radius that grows with the square root of the share of the maximum."""
    size = F.greatest(F.lit(float(lo)), base + F.sqrt(c / top) * k)
    return size if hi is None else F.least(F.lit(float(hi)), size)


# ---- fixed values: edges and size of the map ----------------------------------------------
LON_WEST, LON_EAST = 19.0, 192.0
LAT_SOUTH, LAT_NORTH = 41.0, 74.0
MAP_WIDTH, MAP_HEIGHT = 780.0, 430.0
WRAP_WEST_OF = -10.0
# ---- end of fixed values ------------------------------------------------------------------


def _mercator(lat: Column) -> Column:
    return F.ln(F.tan(F.lit(math.pi / 4) + lat * math.pi / 360))


def mercator_x(lon: Column) -> Column:
    """Horizontal position; longitudes far in the west continue east of 180 degrees."""
    east = F.when(lon < WRAP_WEST_OF, lon + 360).otherwise(lon)
    return (east - LON_WEST) / (LON_EAST - LON_WEST) * MAP_WIDTH


def mercator_y(lat: Column) -> Column:
    """Vertical position, north at zero."""
    north, south = _mercator(F.lit(LAT_NORTH)), _mercator(F.lit(LAT_SOUTH))
    return (north - _mercator(lat)) / (north - south) * MAP_HEIGHT
