"""Banding rules. Every interval is open on the left and closed on the right."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Cut points of the bands.
CLOUD_EDGES, CLOUD_NAMES = [-1, 30, 70, 101], ["clear_sky", "partly", "overcast"]
WIND_EDGES, WIND_NAMES = [-1, 7, 15, 200], ["calm", "moderate", "windy"]
CLARITY_EDGES, CLARITY_NAMES = [-0.01, 1.0, 3.0, 100], ["murky", "stained", "clear"]
ACRES_EDGES, ACRES_NAMES = [-1, 12, 30, 100000], ["small", "medium", "large"]
WEIGHT_EDGES, WEIGHT_NAMES = [0, 2, 3, 5, 8, 100], ["<2 lb", "2-3", "3-5", "5-8", "8+"]


def cut_right(value: Column, edges: list, names: list) -> Column:
    """Band of a value; NULL outside the outermost edges."""
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(list(zip(edges[:-1], edges[1:], names))):
        out = F.when((value > F.lit(lo)) & (value <= F.lit(hi)), name).otherwise(out)
    return out


def band_of(value: Column, edges: list, names: list) -> Column:
    """First edge not below the value; above all edges the last name; NULL stays NULL."""
    out = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names))):
        out = F.when(value <= F.lit(edge), name).otherwise(out)
    return F.when(value.isNotNull(), out)


def size_band(acres: Column) -> Column:
    return F.when(acres > 0, F.when(acres <= 15, "small").when(acres <= 30, "mid").otherwise("large"))


def volatility_band(cv: Column) -> Column:
    return F.when(cv.isNotNull(), F.when(cv <= 0.70, "steady").when(cv <= 0.95, "typical")
                  .otherwise("swingy"))


def confidence(n: Column) -> Column:
    return F.when(n >= 80, "good").when(n >= 30, "fair").when(n >= 10, "thin").otherwise("very thin")


def trend_class(delta: Column, threshold: float = 2.0) -> Column:
    return F.when(delta >= threshold, "rising").when(delta <= -threshold, "falling") \
            .when(delta.isNotNull(), "steady")
