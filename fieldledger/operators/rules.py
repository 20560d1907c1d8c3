"""The rule layer: child tables and coverage from parsed reports.

Reports carry obs_id, raw (free-text total), label_raw (free-text labels) and
body. Every rule is a column expression, so the reports are read once per child
table and nothing is shuffled before the children are aggregated.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X

FULL_TIER = ["unit", "trip_date_exact", "trip_date_estimated", "fish_count", "label_any", "label_field_matched"]


def totals(reports: DataFrame) -> DataFrame:
    out = reports.withColumn("species", X.species_pairs(F.col("raw")))
    out = out.withColumn("total", X.count_total(F.col("raw"), F.col("species")))
    return out.withColumns({"max_weight": X.max_weight(F.col("raw")), "max_length": X.max_length(F.col("raw")),
                            "vague": X.vague_flag(F.col("raw"), F.col("total"))})


def catch_rows(with_totals: DataFrame) -> DataFrame:
    """One row per species; a bare total goes to the first species named in the
    field, else in the narrative, else to 'unspecified'."""
    first = lambda c: F.get(X.species_mentions(F.col(c)), F.lit(0))
    named = F.coalesce(first("raw"), first("body"), F.lit("unspecified"))
    fallback = F.when(F.col("total").isNotNull(), F.array(F.struct(named.alias("species"), F.col("total").alias("n"))))
    rows = F.when(F.size("species") > 0, F.col("species")).otherwise(fallback)
    return (with_totals.select("obs_id", F.explode(rows).alias("s"), "max_weight", F.col("raw").alias("note"))
            .select("obs_id", "s.species", "s.n", "max_weight", "note"))


def features(with_totals: DataFrame) -> DataFrame:
    body, depth = F.col("body"), X.depth_range(F.col("body"))
    return with_totals.select(
        "obs_id", X.clarity_ft(body).alias("clarity_ft"), X.clarity_label(body).alias("clarity_label"),
        X.water_temp(body).alias("water_temp_f"), depth["lo"].alias("depth_min_ft"), depth["hi"].alias("depth_max_ft"),
        X.bite_window(body).alias("bite_window"), X.blank_flag(body, F.col("total")).alias("blank"))


def tag_rows(reports: DataFrame, vocabulary: dict | None = None, dense: tuple = ("vegetation",)) -> DataFrame:
    tags = X.vocab_tags(F.col("body"), vocabulary or X.FISHING_VOCABULARY, dense)
    return reports.select("obs_id", F.explode(tags).alias("t")).select("obs_id", "t.*")


def coverage_stats(trips: DataFrame, extracted: DataFrame) -> DataFrame:
    """(dimension, n_with, n_total, pct, tier).

    ``trips``: unit_known, date_source; ``extracted``: one row per report with the
    boolean columns named below. Each table is aggregated once; the dimensions are
    then unpivoted. Denominators differ: trips for unit and dates, the reports
    with the field for its match rate, all reports for the rest.
    """
    t = trips.agg(F.count_if("unit_known").alias("unit"),
                  F.count_if(F.col("date_source") == "reservation").alias("trip_date_exact"),
                  F.count_if(F.col("date_source") == "posted_estimate").alias("trip_date_estimated"),
                  F.count("*").alias("t_total"))
    dims = ["fish_count", "label_any", "label_field", "label_field_matched", "narrative", "clarity", "water_temp",
            "depth", "bite_window", "vegetation", "structure", "technique"]
    e = extracted.agg(*[F.count_if(F.col(d)).alias(d) for d in dims], F.count("*").alias("e_total"))
    first = t.unpivot(["t_total"], ["unit", "trip_date_exact", "trip_date_estimated"], "dimension", "n_with") \
        .withColumnRenamed("t_total", "n_total")
    second = e.withColumn("field_total", F.col("label_field")).unpivot(
        ["e_total", "field_total"], dims, "dimension", "n_with").select(
        F.when(F.col("dimension") == "label_field_matched", F.col("field_total")).otherwise(F.col("e_total")).alias("n_total"),
        "dimension", "n_with")
    rows = first.unionByName(second)
    return rows.select("dimension", "n_with", "n_total",
                       F.coalesce(F.round(F.try_divide(100.0 * F.col("n_with"), F.col("n_total")), 1), F.lit(0.0)).alias("pct"),
                       F.when(F.col("dimension").isin(FULL_TIER), "full").otherwise("partial").alias("tier"))


def snippets(reports: DataFrame, unit: str = "unit", k: int = 4, useful: str | None = None,
             noise: str | None = None, min_chars: int = 30) -> DataFrame:
    """First distinct sentences per unit that hint at a place. Repeated sentences are
    folded before ranking, so a much-copied sentence costs one row. Texts are cut after
    each end of a sentence, in one pass however long they are; a rest without one goes."""
    from ..functions import vocabulary as V
    from .ranking import topk_per_group
    whole = F.filter(F.split(F.col("body"), V.SENTENCE_END, -1), lambda s: s.rlike("[.!?]$"))
    sentences = F.transform(whole, X.collapse_ws)
    rows = reports.where(F.col("body").isNotNull()).select(
        F.col(unit).alias("unit"), "obs_id", F.posexplode(sentences).alias("pos", "sentence"))
    s = F.col("sentence")
    kept = rows.where((F.length(s) >= min_chars) & s.rlike(useful or V.USEFUL) & ~s.rlike(noise or V.NOISE))   # few are useful
    firsts = kept.groupBy("unit", "sentence").agg(F.min(F.struct("obs_id", "pos")).alias("seen"))
    return topk_per_group(firsts, ["unit"], [F.asc("seen")], k, rank="rank").select("unit", "rank", "sentence")
