"""Great-circle geometry as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Earth radius in miles, the point drives are measured from, grid step.
EARTH_MILES = 3958.8
HOME_LAT, HOME_LON = 32.7767, -96.7970
GRID = 0.25
POINTS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
          "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def _lit(v):
    return v if isinstance(v, Column) else F.lit(float(v))


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_lit, (lat1, lon1, lat2, lon2))
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
         * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2)))
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing from the first point to the second, 0 <= b < 360."""
    lat1, lon1, lat2, lon2 = map(_lit, (lat1, lon1, lat2, lon2))
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    x = F.sin(dl) * F.cos(p2)
    y = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(x, y)) + 360, F.lit(360.0))


def angle_gap(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(_lit(a) - _lit(b)), F.lit(360.0))
    return F.least(d, 360 - d)


def compass16(bearing: Column) -> Column:
    sector = F.floor(F.pmod(bearing + 11.25, F.lit(360.0)) / 22.5).cast("int")
    return F.element_at(F.array(*[F.lit(p) for p in POINTS]), sector + 1)


def miles_from_home(lat, lon) -> Column:
    return haversine_miles(HOME_LAT, HOME_LON, lat, lon)


def grid_snap(degrees: Column, step: float = GRID) -> Column:
    """Nearest multiple of the step, halves to even."""
    return F.bround(degrees / step, 0) * step
