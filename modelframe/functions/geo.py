"""Great-circle distance and radius predicates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from modelframe.errors import QueryError

#: Mean radius of the earth in metres.
EARTH_RADIUS = 6_371_008.8
METRES = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.344}


def metres(radius: float, unit: str) -> float:
    if unit not in METRES:
        raise QueryError(f"radius unit {unit!r} is none of {', '.join(METRES)}")
    return radius * METRES[unit]


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres of points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), F.lit(2)
    )
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def within(lat: Column, lon: Column, center: tuple[float, float], radius_m: float) -> Column:
    """Points at most radius_m from the center; a box of plain comparisons stands first, so that scans can prune."""
    lat0, lon0 = center
    reach = math.degrees(radius_m / EARTH_RADIUS) * 1.0001 + 1e-9
    box = (lat >= lat0 - reach) & (lat <= lat0 + reach)
    # no bound on longitude where the circle holds a pole, two ranges where it crosses the antimeridian
    if abs(lat0) + reach < 90:
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(min(reach, 90))) / math.cos(math.radians(lat0))))) * 1.0001 + 1e-9
        low, high = lon0 - wide, lon0 + wide
        if wide < 180:
            if low < -180:
                box = box & ((lon >= low + 360) | (lon <= high))
            elif high > 180:
                box = box & ((lon >= low) | (lon <= high - 360))
            else:
                box = box & (lon >= low) & (lon <= high)
    return box & (haversine(F.lit(float(lat0)), F.lit(float(lon0)), lat, lon) <= radius_m)
