"""Effect of a label on the rate, matched on how many labels an observation names.

The data is read once. Each observation carries its distinct labels as an array
(at most one entry per vocabulary term), plus a NULL entry that stands for "all
observations". One grouped aggregation then yields count, mean and centred sum
of squares for every (keys, stratum, label) and for the totals alike; "the other
observations" are totals minus users. Everything after that works on this small
table, so neither labels nor units nor years are looped over, and a unit holding
a large share of the rows is pre-aggregated before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.stats import effect_interval, support_case

MIN_STRATUM = 4
STABLE_FRACTION = 2 / 3
MIN_STABLE_YEARS = 3
YEAR_MIN_SCORED, YEAR_MIN_USING = 25, 8
# Order of the verdicts in label evidence and in tag effects.
LABEL_SUPPORT_ORDER = ["backed", "suggestive", "unproven", "thin", "unstable", "below"]
TAG_SUPPORT_ORDER = ["backed", "suggestive", "unproven", "unstable", "thin", "below"]


def label_sets(labels: DataFrame, level: str = "category", out: str = "things") -> DataFrame:
    """Distinct labels of each observation."""
    return (labels.where(F.col(level).isNotNull()).groupBy("obs_id")
            .agg(F.collect_set(level).alias(out)))


def strata_label_count(obs: DataFrame, labels: DataFrame, level: str = "category",
                       cap: int | None = None) -> DataFrame:
    """Adds ``things`` (the labels) and ``stratum``, their number. With a cap the observations of that many labels or
    more share one stratum: a coarser match, for archives too small to fill the higher strata."""
    joined = obs.join(label_sets(labels, level), "obs_id", "left")
    number = F.coalesce(F.array_size("things"), F.lit(0))
    return joined.withColumn("stratum", (number if cap is None else F.least(number, F.lit(cap))).cast("long"))


def with_tags(obs: DataFrame, tags: DataFrame, kind: str = "technique") -> DataFrame:
    """Replaces ``things`` by the observation's tags of one kind; strata stay."""
    chosen = label_sets(tags.where(F.col("kind") == kind), "value")
    return obs.drop("things").join(chosen, "obs_id", "left")


def moments(frame: DataFrame, keys: list[str], things: str = "things") -> DataFrame:
    """(keys, stratum, label) -> n, mean, m2; label NULL holds the totals."""
    total = F.array(F.lit(None).cast("string"))
    entries = F.when(F.col(things).isNull(), total).otherwise(F.concat(F.col(things), total))
    exploded = frame.where(F.col("rate").isNotNull()).select(
        *keys, "stratum", "rate", F.explode(entries).alias("label"))
    return exploded.groupBy(*keys, "stratum", "label").agg(
        F.count("*").alias("n"), F.avg("rate").alias("mean"),
        (F.var_pop("rate") * F.count("*")).alias("m2"))


def merge_moments(m: DataFrame, keys: list[str]) -> DataFrame:
    """Combines moments over the columns left out of ``keys``."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    return m.groupBy(*keys).agg(
        n.alias("n"), mean.alias("mean"),
        F.greatest(F.lit(0.0), F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean"))
                   - n * mean * mean).alias("m2"))


def used_and_other(m: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, label): moments of the users and of everyone else."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    total = F.col("label").isNull()
    for name in ("n", "mean", "m2"):
        m = m.withColumn(f"all_{name}", F.max(F.when(total, F.col(name))).over(w))
    rest = F.col("all_n") - F.col("n")
    other_mean = F.try_divide(F.col("all_n") * F.col("all_mean") - F.col("n") * F.col("mean"), rest)
    gap = F.col("mean") - F.col("other_mean")
    other_m2 = F.col("all_m2") - F.col("m2") - F.try_divide(gap * gap * F.col("n") * F.col("other_n"), F.col("all_n"))
    # A difference of sums this small next to the total is rounding, not spread.
    settled = F.when(other_m2 > F.col("all_m2") * 1e-9, other_m2).otherwise(F.lit(0.0))
    return (m.where(F.col("label").isNotNull())
            .withColumn("other_n", rest).withColumn("other_mean", other_mean)
            .withColumn("other_m2", settled))


def effects(m: DataFrame, keys: list[str], min_stratum: int = MIN_STRATUM) -> DataFrame:
    """Inverse-variance combination over strata: (keys, label) -> diff, se, n_used."""
    cells = used_and_other(m, [*keys, "stratum"]).where(
        (F.col("n") >= min_stratum) & (F.col("other_n") >= min_stratum))
    var = (F.try_divide(F.col("m2"), F.col("n") - 1) / F.col("n")
           + F.try_divide(F.col("other_m2"), F.col("other_n") - 1) / F.col("other_n"))
    weighed = cells.withColumn("var", var).where(F.col("var") > 0).withColumn("w", 1.0 / F.col("var"))
    return weighed.groupBy(*keys, "label").agg(
        (F.sum(F.col("w") * (F.col("mean") - F.col("other_mean"))) / F.sum("w")).alias("diff"),
        F.sqrt(1.0 / F.sum("w")).alias("se"), F.sum("n").alias("n_used"))


def usage(m: DataFrame, keys: list[str]) -> DataFrame:
    """Users against everyone else without matching: (keys, label) -> trips, rate, ..."""
    pooled = used_and_other(merge_moments(m, [*keys, "label"]), keys)
    return pooled.select(
        *keys, "label", F.col("n").alias("trips"), F.col("mean").alias("rate"),
        F.col("all_n").alias("scored"), F.col("all_mean").alias("baseline"),
        F.col("other_n").alias("other"), (100.0 * F.col("n") / F.col("all_n")).alias("share"),
        (F.col("mean") - F.col("other_mean")).alias("naive_diff"))


def with_interval(df: DataFrame) -> DataFrame:
    lo, hi = effect_interval(F.col("diff"), F.col("se"))
    return df.withColumns({"lo": lo, "hi": hi})


def yearly_effects(m: DataFrame, keys: list[str]) -> DataFrame:
    """Effect inside each sufficiently sampled year; strata are the pooled ones."""
    by_year = [*keys, "year"]
    counts = usage(m, by_year).where(
        (F.col("scored") >= YEAR_MIN_SCORED) & (F.col("trips") >= YEAR_MIN_USING))
    return (effects(m, by_year).join(counts.select(*by_year, "label"), [*by_year, "label"], "left_semi")
            .withColumn("diff", F.round("diff", 3)))


def year_consistency(m: DataFrame, pooled: DataFrame, keys: list[str]) -> DataFrame:
    """Years measured, years whose sign agrees with the pooled one, and the verdict."""
    same = (F.col("year_diff") > 0) == (F.col("diff") > 0)
    yearly = yearly_effects(m, keys).withColumnRenamed("diff", "year_diff")
    joined = pooled.select(*keys, "label", "diff").join(
        yearly.select(*keys, "label", "year", "year_diff"), [*keys, "label"], "left")
    out = joined.groupBy(*keys, "label").agg(
        F.count("year_diff").alias("years"), F.count_if(same).alias("years_agreeing"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(
            F.col("year_diff").isNotNull(), F.struct("year", "year_diff"))))).alias("per_year"))
    return out.withColumn("stable", F.when(
        F.col("years") >= MIN_STABLE_YEARS,
        F.col("years_agreeing") / F.col("years") >= STABLE_FRACTION))


def club_stability(m: DataFrame, min_trips: int = 60, min_scored: int = 200) -> DataFrame:
    """Year-by-year verdict on every label over the whole archive."""
    kept = usage(m, []).where((F.col("trips") >= min_trips) & (F.col("scored") >= min_scored))
    pooled = effects(merge_moments(m, ["stratum", "label"]), []).join(
        kept.select("label"), "label", "left_semi")
    return year_consistency(m, pooled, []).join(pooled.select("label", "diff"), "label")


def label_evidence(m: DataFrame, keys: list[str], stability: DataFrame | None = None,
                   min_trips: int = 6, suggestive: int = 12, backed: int = 15,
                   min_scored: int = 12) -> DataFrame:
    """Evidence for every label of every group. ``m`` is keyed by keys + year.

    A label that no stratum can compare stays as a 'thin' row without an effect.
    The archive-wide instability is carried along and never changes the verdict.
    """
    counts = usage(m, keys).where((F.col("scored") >= min_scored) & (F.col("trips") >= min_trips)
                                  & (F.col("other") >= MIN_STRATUM))
    pooled = effects(merge_moments(m, [*keys, "stratum", "label"]), keys)
    years = year_consistency(m, pooled, keys).drop("per_year")
    joined = with_interval(counts.join(pooled.drop("n_used"), [*keys, "label"], "left")
                           .join(years, [*keys, "label"], "left"))
    out = joined.withColumns({
        "years": F.coalesce("years", F.lit(0)), "years_agreeing": F.coalesce("years_agreeing", F.lit(0)),
        "support": F.when(F.col("diff").isNull(), "thin").otherwise(support_case(
            F.col("diff"), F.col("lo"), F.col("hi"), F.col("trips"), min_trips, suggestive,
            backed, F.col("stable")))})
    if stability is None:
        return out.withColumn("club_unstable", F.lit(False))
    unstable = stability.where(~F.col("stable")).select("label", F.lit(True).alias("club_unstable"))
    return (out.join(unstable, "label", "left")
            .withColumn("club_unstable", F.coalesce("club_unstable", F.lit(False))))


def tag_effects(m: DataFrame, keys: list[str], min_trips: int = 25, suggestive: int = 40,
                backed: int = 60, min_scored: int = 40, check_years: bool = True) -> DataFrame:
    """The same estimator for tags; tags without a comparable stratum are dropped."""
    counts = usage(m, keys).where((F.col("scored") >= min_scored) & (F.col("trips") >= min_trips))
    pooled = effects(merge_moments(m, [*keys, "stratum", "label"]), keys)
    joined = with_interval(counts.join(pooled.drop("n_used"), [*keys, "label"]))
    if check_years:
        joined = joined.join(year_consistency(m, pooled, keys), [*keys, "label"], "left")
    else:
        joined = joined.withColumns({"years": F.lit(0), "years_agreeing": F.lit(0),
                                     "stable": F.lit(None).cast("boolean")})
    return joined.withColumn("support", support_case(
        F.col("diff"), F.col("lo"), F.col("hi"), F.col("trips"), min_trips, suggestive,
        backed, F.col("stable")))


def unit_tag_effects(m: DataFrame, keys: list[str]) -> DataFrame:
    """Thinner gates for one unit, and no year check."""
    return tag_effects(m, keys, min_trips=12, backed=25, check_years=False)


def support_rank(order: list[str], column: str = "support"):
    out = F.lit(9)
    for i, name in reversed(list(enumerate(order))):
        out = F.when(F.col(column) == name, i).otherwise(out)
    return out


def half_split(df: DataFrame, keys: list[str], day: str = "obs_date", tie: str = "obs_id") -> DataFrame:
    """Adds ``half``: 'early' for the first floor(n/2) rows by (day, tie), else 'late'.

    Positions are counted over ranges of (group, day, id), so a group of any size, a day with very many rows, or very
    many rows without a date, which come last, is spread over several ranges.
    """
    from ..sources.tables import settle
    from .ranking import row_number_by
    df = settle(df)              # read for its ranges, its places and its sizes
    placed = row_number_by(df, keys, [F.col(day).asc_nulls_last()], [tie], "_place")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_n")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    half = F.when(F.col("_place") <= F.floor(F.col("_n") / 2), "early").otherwise("late")
    return placed.join(sizes, same).withColumn("half", half).select(*df.columns, "half")


def half_effects(m: DataFrame, keys: list[str], min_rows: int, min_using: int,
                 min_stratum: int) -> DataFrame:
    """Effect inside each half; ``m`` is keyed by keys + half."""
    by_half = [*keys, "half"]
    counts = usage(m, by_half).where((F.col("scored") >= min_rows) & (F.col("trips") >= min_using))
    return effects(m, by_half, min_stratum).join(
        counts.select(*by_half, "label"), [*by_half, "label"], "left_semi")


def half_stability(m: DataFrame, pooled: DataFrame, keys: list[str], min_band: int = 300,
                   min_rows: int = 80, min_using: int = 15) -> DataFrame:
    """Whether both halves of a group's record carry the pooled sign."""
    halves = half_effects(m, keys, min_rows, min_using, MIN_STRATUM)
    sizes = merge_moments(m.where(F.col("label").isNull()), keys).where(F.col("n") >= min_band)
    halves = halves.withColumnRenamed("diff", "half_diff")
    if keys:
        halves = halves.join(sizes.select(*keys), keys, "left_semi")
    joined = pooled.select(*keys, "label", "diff").join(
        halves.select(*keys, "label", "half", "half_diff"), [*keys, "label"], "left")
    same = (F.col("half_diff") > 0) == (F.col("diff") > 0)
    out = joined.groupBy(*keys, "label").agg(
        F.count("half_diff").alias("halves"), F.count_if(same).alias("_agree"))
    return out.select(*keys, "label", "halves",
                      F.when(F.col("halves") == 2, F.col("_agree")).otherwise(0).alias("halves_agreeing"),
                      F.when(F.col("halves") == 2, F.col("_agree") == 2).alias("stable"))


def split_half(m: DataFrame, unit: str = "unit") -> DataFrame:
    """(unit, label) effects in the early and in the late half, side by side."""
    halves = half_effects(m, [unit], min_rows=20, min_using=8, min_stratum=3)
    return (halves.groupBy(unit, "label").agg(
        F.max(F.when(F.col("half") == "early", F.col("diff"))).alias("early"),
        F.max(F.when(F.col("half") == "late", F.col("diff"))).alias("late"))
        .where(F.col("early").isNotNull() & F.col("late").isNotNull()))


def split_half_summary(pairs: DataFrame, unit: str = "unit", min_cells: int = 15,
                       repeats_at: float = 0.25) -> DataFrame:
    """Correlation and sign agreement over cells; NULL below ``min_cells``."""
    from ..functions.stats import pearson
    agg = pairs.agg(F.count("*").alias("cells"), F.count_distinct(unit).alias("units"),
                    pearson("early", "late").alias("r"),
                    F.avg((F.signum("early") == F.signum("late")).cast("double")).alias("sign_agreement"))
    enough = F.col("cells") >= min_cells
    return agg.select("cells", F.when(enough, F.col("units")).alias("units"),
                      F.when(enough, F.col("r")).alias("r"),
                      F.when(enough, F.col("sign_agreement")).alias("sign_agreement"),
                      F.when(enough, F.col("r") >= repeats_at).alias("repeats"))
