"""Profiles, briefs and the published payload: sections joined on the unit.

Every section is one grouped pass over all units at once. A nested list is built
only from an already aggregated section, whose length per unit is fixed by the
calendar or by a top-k.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import recommend as R, units as U
from .effects import LABEL_SUPPORT_ORDER, support_rank
from .lift import label_lift
from .ranking import topk_per_group

MIN_REPORTS = 8


def nest(section: DataFrame, fields: list[str], order: Column, name: str) -> DataFrame:
    """A section's rows as one ordered array per unit."""
    items = F.array_sort(F.collect_list(F.struct(order.alias("_o"), *fields)))
    return section.groupBy("unit").agg(F.transform(items, lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(name))


def top_values(obs: DataFrame, tags: DataFrame, kind: str, k: int, name: str) -> DataFrame:
    """Most named values of one tag kind per unit, as an array of names."""
    named = obs.select("obs_id", "unit").join(tags.where(F.col("kind") == kind).select("obs_id", "value"), "obs_id")
    counts = named.groupBy("unit", "value").agg(F.count("*").alias("n"))
    best = topk_per_group(counts, ["unit"], [F.desc("n"), F.asc("value")], k, rank="r")
    nested = nest(best, ["value"], F.col("r"), name)
    return nested.withColumn(name, F.transform(name, lambda s: s["value"]))


def profiles_all(frame: DataFrame, units: DataFrame, labels: DataFrame, tags: DataFrame, catches: DataFrame,
                 evidence: DataFrame, min_reports: int = MIN_REPORTS) -> DataFrame:
    """One row per unit with enough reports, all sections nested."""
    volume = U.unit_volume(frame).where(F.col("reports") >= min_reports)
    rates = U.rate_summary(frame)
    months = nest(U.rate_by_month(frame), ["month", "n", "median", "mean"], F.col("month"), "by_month")
    years = nest(U.rate_by(frame, ["unit", "year"]), ["year", "n", "median"], F.col("year"), "by_year")
    slot_order = F.when(F.col("slot") == "AM", 0).when(F.col("slot") == "PM", 1).otherwise(2)
    slots = nest(U.rate_by(frame, ["unit", "slot"]), ["slot", "n", "median", "mean"], slot_order, "by_slot")
    lifts = topk_per_group(label_lift(frame, labels, keys=["unit"]), ["unit"], [F.desc("lift_lb"), F.asc("category")], 12, rank="r")
    overall = nest(lifts, ["category", "n_trips", "shrunk_rate", "lift", "lift_lb"], F.col("r"), "labels")
    proof = nest(evidence, ["label", "trips", "rate", "diff", "lo", "hi", "support"],
                 F.struct(support_rank(LABEL_SUPPORT_ORDER).alias("s"), (-F.coalesce("diff", F.lit(-99.0))).alias("d"), F.col("label").alias("l")), "evidence")
    species = nest(U.species_mix(frame, catches), ["species", "n", "pct"], F.struct((-F.col("n")).alias("n"), F.col("species").alias("s")), "species")
    water = U.water_panel(frame, tags)
    weights = U.weight_bands(frame).groupBy("unit").agg(F.max("best").alias("best"), F.max("over_5_rate").alias("over_5_rate"))
    spread = U.unit_consistency(frame).select("unit", "cv", "band", "bust_rate", "worst_decile", "best_decile", "typical_count")
    bands = nest(U.conditions_panel(frame), ["condition", "value", "n", "median"], F.struct("condition", "value"), "conditions")
    out = volume.join(units.select("unit", "town", "region", "acres", "day_rate"), "unit", "left")
    for section in (rates, months, years, slots, overall, proof, species, water, weights, spread, bands,
                    top_values(frame, tags, "vegetation", 8, "veg_top"), top_values(frame, tags, "structure", 10, "structure_top"),
                    top_values(frame, tags, "technique", 8, "technique_top")):
        out = out.join(section, "unit", "left")
    return out


def slim_sections(profiles: DataFrame) -> DataFrame:
    """The part of a profile a page shows: empty months dropped, lists cut short."""
    keep = {"labels": 8, "evidence": 12, "species": 5, "veg_top": 6, "structure_top": 7, "technique_top": 6}
    out = profiles.withColumns({c: F.slice(c, 1, k) for c, k in keep.items()})
    return out.withColumns({"by_month": F.filter("by_month", lambda m: m["n"] > 0),
                            "by_year": F.when(F.size("by_year") > 8, F.slice("by_year", -8, 8)).otherwise(F.col("by_year"))})


def club_label_plan(evidence: DataFrame) -> DataFrame:
    """Labels to use (backed and positive) and to avoid (below), three each, in order."""
    side = F.when((F.col("support") == "backed") & (F.col("diff") > 0), "use").when(F.col("support") == "below", "avoid")
    return topk_per_group(evidence.withColumn("side", side).where(F.col("side").isNotNull()), ["side"],
                          [F.desc("diff"), F.asc("label")], 3, rank="rank").select("side", "rank", "label", "trips", "diff", "lo", "hi", "support")


def presentation_plan(club: DataFrame, local: DataFrame) -> DataFrame:
    """Presentations to use (three), avoid (two) and that are unstable, archive-wide,
    with each unit's own figure alongside. local: unit, label, diff, trips."""
    support = F.col("support")
    side = F.when(support == "backed", "use").when(support == "below", "avoid").when(support == "unstable", "unstable")
    sided = club.withColumn("side", side).where(F.col("side").isNotNull())
    order = Window.partitionBy("side").orderBy(F.desc("diff"), F.asc("label"))
    shown = F.when(F.col("side") == "use", 3).when(F.col("side") == "avoid", 2)
    ranked = sided.withColumn("rank", F.row_number().over(order)).where(F.coalesce(F.col("rank") <= shown, F.lit(True)))
    here = local.select("unit", "label", F.col("diff").alias("here_diff"), F.col("trips").alias("here_trips"))
    return ranked.select("side", "rank", "label", "trips", "diff").join(here, "label", "left")


def unit_briefs(days: DataFrame, expected: DataFrame, sentences: DataFrame, notes: DataFrame, advice: DataFrame,
                evidence_rows: DataFrame, shares: DataFrame) -> DataFrame:
    """One row per (unit, day): expectation, spread, weather note, advice, receipts.
    days: unit, day."""
    tips = advice.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("advice", "rank", "label", "diff"))).alias("size_band"))
    receipts = topk_per_group(evidence_rows, ["unit"], [F.desc("obs_date"), F.desc("obs_id"), F.asc("category")], 10, rank="r")
    cites = nest(receipts, ["category", "obs_id", "obs_date", "count_total"], F.col("r"), "citations")
    thrown = nest(shares, ["category", "trips", "share"], F.struct((-F.col("trips")).alias("t"), F.col("category").alias("c")), "here")
    out = days.join(expected, "unit").join(sentences, "unit", "left").join(notes, ["unit", "day"], "left")
    for part in (tips, cites, thrown):
        out = out.join(part, "unit", "left")
    return out.withColumns({"weekday": F.date_format("day", "EEEE"), "month_name": F.date_format("day", "MMMM")})


def planner_payload(obs: DataFrame, units: DataFrame, days: dict[str, int], as_of_year: int, max_miles: float, top: int = 12) -> DataFrame:
    """(day, unit): rate for every placed unit, and its rank on the shortlist."""
    placed = units.where(F.col("lat").isNotNull()).withColumn("miles", F.round(R.miles_from_home(F.col("lat"), F.col("lon")), 1))
    per_month = {m: R.expected_rate(obs, m, as_of_year) for m in sorted(set(days.values()))}
    out = None
    for day, month in days.items():
        rated = placed.join(per_month[month].where(F.col("expected").isNotNull()), "unit", "left")
        near = rated.where(F.col("lower").isNotNull() & (F.col("miles") <= max_miles))
        best = near.orderBy(F.desc("lower"), "unit").limit(top)
        ranked = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("lower")).alias("o"), "unit"))).alias("list")) \
            .select(F.posexplode("list").alias("i", "s")).select(F.col("s.unit").alias("unit"), (F.col("i") + 1).alias("rank"))
        part = rated.join(ranked, "unit", "left").select(F.lit(day).alias("day"), "unit", "miles", "geo_uncertain", "expected", "lower", "n_total", "rank")
        out = part if out is None else out.unionByName(part)
    return out


