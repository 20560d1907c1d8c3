"""Daily series per cell: lags, trailing means and the condition columns.

Each window is one cell's series, at most one row per calendar day, so its size
is bounded by the calendar and not by the number of observations.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.bands import trend_class


def lag_delta(df: DataFrame, cell: list[str], day: str, value: str, steps: int, out: str) -> DataFrame:
    """value[i] - value[i-steps] by row position; NULL when either is missing."""
    w = Window.partitionBy(*cell).orderBy(day)
    return df.withColumn(out, F.col(value) - F.lag(value, steps).over(w))


def trailing_mean(df: DataFrame, cell: list[str], day: str, value: str, out: str, rows: int = 7) -> DataFrame:
    """Mean of the non-null values in the last ``rows`` rows."""
    w = Window.partitionBy(*cell).orderBy(day).rowsBetween(-(rows - 1), 0)
    return df.withColumn(out, F.avg(value).over(w))


def conditions_columns(df: DataFrame, cell: list[str], day: str) -> DataFrame:
    out = lag_delta(df, cell, day, "pressure_hpa", 1, "pressure_delta_24h")
    out = lag_delta(out, cell, day, "pressure_hpa", 2, "pressure_delta_48h")
    out = trailing_mean(out, cell, day, "temp_mean_f", "temp_7d_mean_f")
    return out.withColumn("pressure_trend", trend_class(F.col("pressure_delta_24h")))


def cell_fanout_join(series: DataFrame, units: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One series per snapped grid cell, joined to every unit inside the cell."""
    from ..functions.geo import grid_snap
    placed = units.withColumns({"cell_lat": grid_snap(F.col(lat)), "cell_lon": grid_snap(F.col(lon))})
    return placed.join(series, ["cell_lat", "cell_lon"])


def conditions_rows(series: DataFrame, units: DataFrame) -> DataFrame:
    """The full daily row per unit: measurements, changes, trend, moon and sun."""
    from ..functions import astro
    dated = conditions_columns(series, ["unit_id"], "obs_date").join(
        units.select("unit_id", "lat", "lon"), "unit_id")
    day = F.col("obs_date")
    return dated.withColumns({"moon_phase": astro.moon_phase(day), "moon_illum": astro.moon_illumination(day),
                              **astro.sun_columns(day, F.col("lat"), F.col("lon"))}).drop("lat", "lon")


def interval_expand_daily(intervals: DataFrame, spread: bool = False) -> DataFrame:
    """ISO-8601 intervals ('start/PnDTnH') to calendar days.

    Input: cell, field, valid_time, value. The full value counts once per hour
    covered, as published; ``spread`` divides it over its hours instead. Hours are
    counted per day, not emitted one by one, except for the middle element that
    wind direction needs, which is found from running hour counts.
    """
    start_text = F.split_part("valid_time", F.lit("/"), F.lit(1))
    span = F.split_part("valid_time", F.lit("/"), F.lit(2))
    digits = lambda rx: F.regexp_extract(span, rx, 1)
    number = lambda rx: F.when(digits(rx) == "", 0).otherwise(digits(rx).try_cast("int"))
    hours = F.greatest(F.lit(1), number("^P(\\d+)D") * 24 + number("^P(?:\\d+D)?T?(\\d+)H"))
    # Calendar date and hour as written; the offset does not move them.
    rows = (intervals.where(F.col("value").isNotNull())
            .withColumn("start_day", F.to_date(F.substring(start_text, 1, 10)))
            .withColumn("start_hour", F.substring(start_text, 12, 2).cast("int"))
            .withColumn("hours", F.when(number("^P(\\d+)D").isNotNull() & number("^P(?:\\d+D)?T?(\\d+)H").isNotNull(), hours))
            .where(F.col("hours").isNotNull()))
    last = F.floor((F.col("start_hour") + F.col("hours") - 1) / 24).cast("int")
    per_day = rows.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    first_hour = F.greatest(F.lit(0), F.col("start_hour") - 24 * F.col("k"))
    end_hour = F.least(F.lit(24), F.col("start_hour") + F.col("hours") - 24 * F.col("k"))
    per_day = per_day.withColumns({"day": F.date_add("start_day", F.col("k")), "h": end_hour - first_hour})
    return per_day.withColumn("amount", F.col("value") / F.col("hours") if spread else F.col("value"))


def interval_daily_columns(expanded: DataFrame) -> DataFrame:
    """Day columns from expanded intervals: max/min temperature in °F, mean sky, max
    wind in mph, middle wind direction, summed rain in inches."""
    is_f = lambda name: F.col("field") == name
    pick = lambda name, c="amount": F.when(is_f(name), F.col(c))
    # The element at position size // 2 of the hourly list, by interval start, then sequence.
    w = Window.partitionBy("cell", "day").orderBy("start_day", "start_hour", "seq")
    winds = expanded.where(is_f("windDirection")).withColumns({
        "_to": F.sum("h").over(w), "_size": F.sum("h").over(Window.partitionBy("cell", "day"))})
    middle = F.floor(F.col("_size") / 2)
    winds = winds.where((F.col("_to") - F.col("h") <= middle) & (middle < F.col("_to"))).select(
        "cell", "day", F.col("value").alias("wind_dir_deg"))
    days = expanded.groupBy("cell", "day").agg(
        F.max(pick("maxTemperature", "value")).alias("hi"), F.min(pick("minTemperature", "value")).alias("lo"),
        (F.sum(pick("skyCover", "value") * F.col("h")) / F.sum(F.when(is_f("skyCover"), F.col("h")))).alias("cloud_pct"),
        F.max(pick("windSpeed", "value")).alias("wind"),
        F.sum(pick("quantitativePrecipitation") * F.col("h")).alias("rain"))
    days = days.where(F.col("hi").isNotNull() | F.col("lo").isNotNull())
    out = days.join(winds, ["cell", "day"], "left").select(
        "cell", "day", (F.col("hi") * 9 / 5 + 32).alias("temp_max_f"), (F.col("lo") * 9 / 5 + 32).alias("temp_min_f"),
        (F.col("rain") / 25.4).alias("precip_in"), (F.col("wind") * 0.621371).alias("wind_max_mph"),
        "wind_dir_deg", "cloud_pct")
    return out.withColumn("temp_mean_f", (F.col("temp_max_f") + F.col("temp_min_f")) / 2)


def json_series_unpivot(blocks: DataFrame, fields: list[str], json_col: str = "block") -> DataFrame:
    """{"daily": {"time": [...], field: [...]}} to one row per cell and date; a
    missing or short array gives NULL."""
    arrays = ", ".join(f"`{f}`: array<double>" for f in fields)
    daily = F.from_json(json_col, f"daily struct<`time`: array<string>, {arrays}>")["daily"]
    parsed = blocks.withColumn("_d", daily)
    out = parsed.select(*[c for c in blocks.columns if c != json_col], "_d", F.posexplode("_d.time").alias("i", "day"))
    return out.select(*[c for c in blocks.columns if c != json_col], F.try_to_date("day").alias("day"),
                      *[F.get(F.col("_d")[f], F.col("i")).alias(f) for f in fields])


def stale_fallback_join(cells: DataFrame, live: DataFrame, cached: DataFrame, second: DataFrame,
                        max_age_hours: float = 12.0) -> DataFrame:
    """Forecast per cell: the live one, else a cached one young enough, else the
    second source. Each input: cell, value columns; ``cached`` also age_hours."""
    fresh = cached.where(F.col("age_hours") <= max_age_hours).drop("age_hours")
    values = [c for c in live.columns if c != "cell"]
    rename = lambda df, tag: df.select("cell", F.struct(*values).alias(tag))
    out = (cells.join(rename(live, "l"), "cell", "left").join(rename(fresh, "c"), "cell", "left")
           .join(rename(second, "s"), "cell", "left"))
    chosen = F.coalesce("l", "c", "s")
    source = F.when(F.col("l").isNotNull(), "live").when(F.col("c").isNotNull(), "cached") \
        .when(F.col("s").isNotNull(), "second")
    return out.select("cell", source.alias("source"), *[chosen[v].alias(v) for v in values])


def coverage_gap_plan(members: DataFrame, have: DataFrame, as_of, lead_days: int = 3) -> DataFrame:
    """Spans still to be fetched per grid cell.

    ``members``: cell, unit_id, first, last observation; ``have``: unit_id, lo, hi
    stored. A cell is skipped when every member already covers the needed span.
    """
    spans = members.groupBy("cell").agg(
        F.date_sub(F.min("first"), lead_days).alias("start"),
        F.least(F.max("last"), F.date_sub(F.lit(as_of).cast("date"), 1)).alias("end"),
        F.count("*").alias("members"))
    spans = spans.where(F.col("end") >= F.col("start"))
    checked = members.select("cell", "unit_id").join(have, "unit_id", "left").join(spans, "cell")
    covered = F.coalesce((F.col("lo") <= F.col("start")) & (F.col("hi") >= F.col("end")), F.lit(False))
    status = checked.groupBy("cell").agg(F.bool_and(covered).alias("covered"))
    return spans.join(status, "cell").where(~F.col("covered")).drop("covered")
