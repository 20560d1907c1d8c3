"""Moon and daylight from the date and position alone."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .dates import us_dst

# A new moon at 2000-01-06 18:14, and the synodic month in days.
NEW_MOON = "2000-01-06"
NEW_MOON_LAG = (18 + 14 / 60 - 12) / 24
SYNODIC = 29.53058867
# Upper edges of the phase names.
PHASE_EDGES = [(0.033, "new"), (0.217, "waxing_crescent"), (0.283, "first_quarter"),
               (0.467, "waxing_gibbous"), (0.533, "full"), (0.717, "waning_gibbous"),
               (0.783, "last_quarter"), (0.967, "waning_crescent")]


def moon_phase(day: Column) -> Column:
    """0 new, 0.25 first quarter, 0.5 full, 0.75 last quarter; four places."""
    days = F.datediff(day, F.lit(NEW_MOON).cast("date")) - F.lit(NEW_MOON_LAG)
    return F.round(F.pmod(days, F.lit(SYNODIC)) / SYNODIC, 4)


def moon_illumination(day: Column) -> Column:
    days = F.datediff(day, F.lit(NEW_MOON).cast("date")) - F.lit(NEW_MOON_LAG)
    turn = F.pmod(days, F.lit(SYNODIC)) / SYNODIC
    return F.round((1 - F.cos(2 * math.pi * turn)) / 2, 4)


def moon_name(phase: Column) -> Column:
    out = F.lit("new")
    for edge, name in reversed(PHASE_EDGES):
        out = F.when(phase < edge, name).otherwise(out)
    return out


def sun_columns(day: Column, lat: Column, lon: Column, tz_offset: Column | None = None) -> dict[str, Column]:
    """Sunrise and sunset as HH:MM local time, and day length in hours.

    Standard low-precision solar position; local time is US Central with
    daylight saving unless an offset is given.
    """
    offset = F.when(us_dst(day), -5.0).otherwise(-6.0) if tz_offset is None else tz_offset
    n = F.datediff(day, F.lit("2000-01-01").cast("date")) + 0.0008 - lon / 360.0
    anomaly = F.pmod(357.5291 + 0.98560028 * n, F.lit(360.0))
    m = F.radians(anomaly)
    centre = 1.9148 * F.sin(m) + 0.0200 * F.sin(2 * m) + 0.0003 * F.sin(3 * m)
    ecliptic = F.radians(F.pmod(anomaly + centre + 180 + 102.9372, F.lit(360.0)))
    transit = n + 0.0053 * F.sin(m) - 0.0069 * F.sin(2 * ecliptic)
    declination = F.asin(F.sin(ecliptic) * math.sin(math.radians(23.44)))
    cosine = ((math.sin(math.radians(-0.833)) - F.sin(F.radians(lat)) * F.sin(declination))
              / (F.cos(F.radians(lat)) * F.cos(declination)))
    half_arc = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))

    def clock(moment: Column) -> Column:
        hours = F.pmod(F.pmod(moment + 0.5, F.lit(1.0)) * 24.0 + offset, F.lit(24.0))
        whole = F.floor(hours)
        return F.concat(F.lpad(whole.cast("string"), 2, "0"), F.lit(":"),
                        F.lpad(F.floor((hours - whole) * 60).cast("string"), 2, "0"))

    return {"sunrise": clock(transit - half_arc / 360.0), "sunset": clock(transit + half_arc / 360.0),
            "day_length_h": F.round(2 * half_arc / 360.0 * 24.0, 2)}
