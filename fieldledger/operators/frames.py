"""The wide analysis frame and the views on its child tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import bands as B


def trips_frame(obs: DataFrame, units: DataFrame, conditions: DataFrame,
                *details: DataFrame) -> DataFrame:
    """Fact table left-joined to units, same-day conditions and any further
    one-row-per-observation tables, with the four bands added."""
    unit_cols = units.drop("unit")
    out = (obs.join(unit_cols, "unit_id", "left")
           .join(conditions, ["unit_id", "obs_date"], "left"))
    for detail in details:
        out = out.join(detail, "obs_id", "left")
    return out.withColumns({
        "cloud_band": B.cut_right(F.col("cloud_pct"), B.CLOUD_EDGES, B.CLOUD_NAMES),
        "wind_band": B.cut_right(F.col("wind_max_mph"), B.WIND_EDGES, B.WIND_NAMES),
        "clarity_band": B.cut_right(F.col("clarity_ft"), B.CLARITY_EDGES, B.CLARITY_NAMES),
        "acres_band": B.cut_right(F.col("acres"), B.ACRES_EDGES, B.ACRES_NAMES)})


def labels_view(labels: DataFrame) -> DataFrame:
    return labels.select("obs_id", "category", "subtype", "color", "source")


def tags_view(tags: DataFrame, kind: str | None = None) -> DataFrame:
    out = tags.select("obs_id", "kind", "value", "detail")
    return out if kind is None else out.where(F.col("kind") == kind)
