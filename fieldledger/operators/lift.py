"""Label ranking inside a slice: shrunk rate, conservative lower end, lift."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import SHRINK_K, shrunk_mean
from .effects import label_sets

MIN_CELL = 3


def lift_columns(df: DataFrame, k: float = SHRINK_K) -> DataFrame:
    """Needs n_trips, raw_rate, baseline, pooled_std."""
    shrunk = shrunk_mean(F.col("raw_rate"), F.col("n_trips"), F.col("baseline"), k)
    return (df.withColumn("shrunk_rate", shrunk)
            .withColumn("lower_rate", F.greatest(F.lit(0.0), F.col("shrunk_rate")
                        - F.coalesce("pooled_std", F.lit(0.0)) / F.sqrt(F.col("n_trips").cast("double"))))
            .withColumn("lift", F.try_divide("shrunk_rate", "baseline"))
            .withColumn("lift_lb", F.try_divide("lower_rate", "baseline")))


def label_lift(trips: DataFrame, labels: DataFrame, level: str = "category",
               min_n: int = MIN_CELL, keys: list[str] = ()) -> DataFrame:
    """Lift per (keys, level), each against the baseline of its own slice.

    With no keys the slice figures are one row, taken in as a scalar subquery;
    with keys they are a small grouped table joined on the keys.
    """
    keys = list(keys)
    scored = trips.where(F.col("rate").isNotNull())
    if keys:
        scored = scored.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    slice_stats = [F.avg("rate").alias("baseline"), F.stddev_pop("rate").alias("pooled_std"),
                   F.count("*").alias("scored_trips")]
    cells = (scored.select("obs_id", "rate", *keys).join(label_sets(labels, level), "obs_id")
             .select("rate", *keys, F.explode("things").alias(level))
             .groupBy(*keys, level)
             .agg(F.count("*").alias("n_trips"), F.avg("rate").alias("raw_rate"),
                  F.median("rate").alias("median_rate"))
             .where(F.col("n_trips") >= min_n))
    if keys:
        cells = cells.join(scored.groupBy(*keys).agg(*slice_stats), keys)
    else:
        figures = scored.agg(F.struct(*slice_stats).alias("s")).scalar()
        cells = cells.withColumn("s", figures).select("*", "s.*").drop("s")
    return lift_columns(cells)


def slice_filter(trips: DataFrame, unit: str | None = None, cohort: str | None = None,
                 month: int | None = None, season: str | None = None, pressure: str | None = None,
                 clarity: str | None = None, wind: str | None = None,
                 max_acres: float | None = None, exact_dates: bool = False) -> DataFrame:
    """The slice a lift is asked for. A pressure condition implies exact dates,
    because a one-day error destroys a same-day reading."""
    terms: list[Column] = []
    for column, wanted in (("cohort", cohort), ("month", month), ("season", season),
                           ("pressure_trend", pressure), ("clarity_band", clarity),
                           ("wind_band", wind)):
        if wanted is not None:
            terms.append(F.col(column) == F.lit(wanted))
    if unit is not None:
        terms.append(F.lower("unit") == unit.lower())
    if max_acres is not None:
        terms.append(F.col("acres") <= max_acres)
    if exact_dates or pressure is not None:
        terms.append(F.col("date_source") == "reservation")
    return trips.where(reduce(lambda a, b: a & b, terms)) if terms else trips


def label_detail(trips: DataFrame, labels: DataFrame, keys: list[str] = ()) -> dict[str, DataFrame]:
    """Versions, colours, seasons, best month and source split of every label."""
    keys = list(keys)
    from .ranking import topk_per_group
    scored = trips.where(F.col("rate").isNotNull()).select("obs_id", "rate", "season", "month", *keys)
    by = [*keys, "category"]
    named = scored.select("obs_id", *keys).join(labels, "obs_id")
    counts = {}
    for level in ("subtype", "color"):
        usable = named.where(F.col(level).isNotNull() & (F.col(level) != "unspecified"))
        tally = usable.groupBy(*by, level).agg(F.count("*").alias("n"))
        counts[level] = topk_per_group(tally, by, [F.desc("n"), F.asc(level)], 4)
    once = scored.join(labels.select("obs_id", "category").dropDuplicates(), "obs_id")
    seasons = (once.groupBy(*by, "season").agg(F.count("*").alias("n"), F.avg("rate").alias("rate"))
               .where(F.col("n") >= 4))
    months = (once.groupBy(*by, "month").agg(F.count("*").alias("n"), F.avg("rate").alias("rate"))
              .where(F.col("n") >= 3))
    best = months.groupBy(*by).agg(F.max_by("month", F.struct("rate", -F.col("month"))).alias("best_month"))
    sources = named.groupBy(*by).agg(F.count_if(F.col("source") == "field").alias("from_field"),
                                     F.count_if(F.col("source") == "narrative").alias("from_narrative"))
    return {"subtypes": counts["subtype"], "colors": counts["color"], "by_season": seasons,
            "best_month": best, "sources": sources}
