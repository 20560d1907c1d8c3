"""Effort hours per slot, measured instead of assumed."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HALF_DAY_HOURS = 4.0
ALL_DAY_FALLBACK = 8.0
MIN_SIDE = 100
RATIO_LOW, RATIO_HIGH = 1.0, 2.0


def calibrate_effort(obs: DataFrame) -> DataFrame:
    """One row: all-day hours = half-day hours x the ratio of mean totals.

    Falls back to the documented hours when either side is short of
    ``MIN_SIDE`` rows or the ratio lies outside the accepted range.
    """
    half, full = F.col("slot").isin("AM", "PM"), F.col("slot") == "ALL_DAY"
    sides = obs.where(F.col("count_total").isNotNull() & F.col("slot").isNotNull()).agg(
        F.count_if(half).alias("n_half"), F.count_if(full).alias("n_all_day"),
        F.avg(F.when(half, F.col("count_total"))).alias("half_mean"),
        F.avg(F.when(full, F.col("count_total"))).alias("all_day_mean"))
    ratio = F.try_divide("all_day_mean", "half_mean")
    measured = F.coalesce((F.col("n_half") >= MIN_SIDE) & (F.col("n_all_day") >= MIN_SIDE)
                          & (F.col("half_mean") > 0) & ratio.between(RATIO_LOW, RATIO_HIGH),
                          F.lit(False))
    return (sides.withColumn("measured", measured)
            .withColumn("ratio", F.when(F.col("measured"), ratio))
            .withColumn("all_day_hours",
                        F.when(F.col("measured"), F.round(HALF_DAY_HOURS * ratio, 2))
                         .otherwise(F.lit(ALL_DAY_FALLBACK)))
            .withColumn("source", F.when(F.col("measured"), "measured").otherwise("fallback")))


def effort_hours(slot, all_day_hours):
    return F.when(slot.isin("AM", "PM"), F.lit(HALF_DAY_HOURS)).when(slot == "ALL_DAY", all_day_hours)


def restate_rates(obs: DataFrame, calibration: DataFrame) -> DataFrame:
    """Hours and rate of every observation. The one-row calibration comes in as a
    scalar subquery, so the fact table is neither joined nor shuffled."""
    all_day = calibration.select("all_day_hours").scalar()
    with_hours = obs.withColumn("hours", effort_hours(F.col("slot"), all_day))
    return with_hours.withColumn("rate", F.try_divide("count_total", "hours"))


def slot_spread(obs: DataFrame) -> DataFrame:
    """Mean rate per slot, and (max - min) / min over the slots."""
    per_slot = (obs.where(F.col("rate").isNotNull() & F.col("slot").isNotNull())
                .groupBy("slot").agg(F.count("*").alias("n"), F.avg("rate").alias("mean_rate")))
    spread = per_slot.agg(F.try_divide(F.max("mean_rate") - F.min("mean_rate"),
                                       F.min("mean_rate")).alias("spread")).scalar()
    return per_slot.withColumn("spread", spread)
