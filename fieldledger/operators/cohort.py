"""Advice by size band, and whether effects repeat across halves of a record."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.bands import size_band
from ..functions.stats import pearson, support_case
from . import effects as E
from ..sources.tables import settle
from .ranking import topk_per_group

MIN_BAND, MIN_TRIPS, SUGGESTIVE, BACKED = 300, 40, 60, 90
MIN_UNIT_ROWS = 60


def with_band(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("acres") > 0).withColumn("band", size_band(F.col("acres")))


def band_summary(banded: DataFrame) -> DataFrame:
    return banded.groupBy("band").agg(
        F.count_distinct("unit").alias("units"), F.count("*").alias("trips"),
        F.median("acres").alias("median_acres"), F.avg("rate").alias("mean_rate"))


def band_moments(banded: DataFrame, labels: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Moments keyed by band and half of the band's record."""
    halved = E.half_split(banded.select("band", "obs_id", "obs_date", "rate"), ["band"])
    frame = E.strata_label_count(halved, labels)
    if tags is not None:
        frame = E.with_tags(frame, tags)
    return settle(E.moments(frame, ["band", "half"]))


def band_effects(banded: DataFrame, labels: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Effects of labels (or of technique tags) measured inside each size band."""
    m = band_moments(banded, labels, tags)
    counts = E.usage(m, ["band"]).where((F.col("scored") >= MIN_BAND) & (F.col("trips") >= MIN_TRIPS))
    pooled = E.effects(E.merge_moments(m, ["band", "stratum", "label"]), ["band"])
    stability = E.half_stability(m, pooled, ["band"], min_band=MIN_BAND)
    joined = E.with_interval(counts.select("band", "label", "trips").join(pooled, ["band", "label"])
                             .join(stability, ["band", "label"]))
    return joined.withColumn("support", support_case(
        F.col("diff"), F.col("lo"), F.col("hi"), F.col("trips"), MIN_TRIPS, SUGGESTIVE, BACKED,
        F.col("stable"))).select("band", "label", "trips", "diff", "lo", "hi", "halves",
                                 "halves_agreeing", "support")


def band_advice(effects: DataFrame, units: DataFrame, k: int = 4) -> DataFrame:
    """Up to ``k`` labels to use and to avoid for the band of every unit."""
    good = (F.col("support") == "backed") & (F.col("diff") > 0)
    bad = F.col("support").isin("backed", "below") & (F.col("diff") < 0)
    verdicts = effects.withColumn("advice", F.when(good, "use").when(bad, "avoid"))
    ranked = topk_per_group(verdicts.where(F.col("advice").isNotNull()), ["band", "advice"],
                            [F.desc(F.abs("diff")), F.asc("label")], k, rank="rank")
    sized = units.select("unit", size_band(F.col("acres")).alias("band")).where(F.col("band").isNotNull())
    return sized.join(ranked, "band").select("unit", "band", "advice", "rank", "label", "diff")


def big_units(obs: DataFrame, min_rows: int = MIN_UNIT_ROWS) -> DataFrame:
    """Scored rows of every unit that carries enough of them."""
    sizes = obs.where(F.col("unit").isNotNull()).groupBy("unit").agg(
        F.count("rate").alias("_scored"))
    chosen = sizes.where(F.col("_scored") >= min_rows)
    return obs.where(F.col("rate").isNotNull()).join(chosen.select("unit"), "unit", "left_semi")


def halved_units(obs: DataFrame) -> DataFrame:
    """The scored rows of big units with the half of the unit's record that they belong to."""
    return E.half_split(big_units(obs).select("unit", "obs_id", "obs_date", "rate"), ["unit"])


def rate_split_half(obs: DataFrame, min_units: int = 10) -> DataFrame:
    """The control: correlation of a unit's early with its late mean rate."""
    return rate_halves(halved_units(obs), min_units)


def rate_halves(halved: DataFrame, min_units: int = 10) -> DataFrame:
    """`rate_split_half` of rows that are halved already."""
    per_unit = halved.groupBy("unit").agg(
        F.avg(F.when(F.col("half") == "early", F.col("rate"))).alias("early"),
        F.avg(F.when(F.col("half") == "late", F.col("rate"))).alias("late"))
    out = per_unit.agg(F.count("*").alias("units"), pearson("early", "late").alias("r"))
    return out.select("units", F.when(F.col("units") >= min_units, F.col("r")).alias("r"))
