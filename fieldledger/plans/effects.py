"""Calibration, lift and matched effects on the bound tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bands import size_band
from ..functions.stats import shrunk_mean
from ..operators import cohort as C, effects as E, effort, lift
from ..operators.narrate import SUPPORTS, support_summary as summarise
from ..sources.tables import settle
from . import testbed as T
from .registry import query, r6


# --- effort -------------------------------------------------------------------
@query("calibrate_effort", f"""
SELECT n_half, n_all_day, {r6('half_mean')} AS half_mean, {r6('all_day_mean')} AS all_day_mean,
       measured, {r6('ratio')} AS ratio, {r6('all_day_hours')} AS all_day_hours, source
FROM calibration""")
def calibrate_effort(spark, sf):
    return effort.calibrate_effort(T.raw_observations(spark, sf))


@query("restate_rates", f"""
SELECT obs_id, slot, {r6('hours')} AS hours, {r6('rate')} AS rate FROM obs""")
def restate_rates(spark, sf):
    return T.observations(spark, sf).select("obs_id", "slot", "hours", "rate")


@query("effort_rate", f"""
SELECT obs_id, {r6("CASE WHEN slot IN ('AM','PM') THEN 4.0 WHEN slot = 'ALL_DAY' THEN 8.0 END")} AS hours,
  {r6("count_total / CASE WHEN slot IN ('AM','PM') THEN 4.0::DOUBLE WHEN slot = 'ALL_DAY' THEN 8.0::DOUBLE END")} AS rate
FROM raw_obs""")
def effort_rate(spark, sf):
    raw = T.raw_observations(spark, sf)
    hours = effort.effort_hours(F.col("slot"), F.lit(effort.ALL_DAY_FALLBACK))
    return raw.select("obs_id", hours.alias("hours"), F.try_divide("count_total", hours).alias("rate"))


@query("slot_spread", f"""
s AS (SELECT slot, count(*) AS n, avg(rate) AS m FROM scored WHERE slot IS NOT NULL GROUP BY slot)
SELECT slot, n, {r6('m')} AS mean_rate, {r6('((SELECT max(m) FROM s) - (SELECT min(m) FROM s)) / (SELECT min(m) FROM s)')} AS spread FROM s""")
def slot_spread(spark, sf):
    return effort.slot_spread(T.observations(spark, sf))


@query("shrunk_mean", f"""
SELECT unit, {r6('(count(*) * avg(rate) + 8.0 * (SELECT avg(rate) FROM scored)) / (count(*) + 8.0)')} AS shrunk
FROM scored GROUP BY unit""")
def shrunk_mean_query(spark, sf):
    scored = T.scored(spark, sf)
    base = scored.agg(F.avg("rate")).scalar()
    per = scored.groupBy("unit").agg(F.count("*").alias("n"), F.avg("rate").alias("m"))
    return per.select("unit", shrunk_mean(F.col("m"), F.col("n"), base).alias("shrunk"))


# --- lift ---------------------------------------------------------------------
def lift_sql(scored: str, labs: str, level: str, min_n: int, keys: list[str] = ()) -> str:
    """CTE ``lifted``: direct statement of the lift of each level in its slice."""
    k = "".join(f"{x}, " for x in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    on = " AND ".join(f"c.{x} = b.{x}" for x in keys) or "TRUE"
    notnull = " AND ".join(f"{x} IS NOT NULL" for x in keys) or "TRUE"
    return f"""
base AS (SELECT {k}avg(rate) AS baseline, stddev_pop(rate) AS pooled_std, count(*) AS scored_trips
         FROM {scored} WHERE {notnull} {group}),
cell AS (SELECT {k}{level}, count(*) AS n_trips, avg(rate) AS raw_rate, median(rate) AS median_rate
         FROM {scored} JOIN (SELECT DISTINCT obs_id, {level} FROM {labs}) USING (obs_id)
         WHERE {notnull} GROUP BY {k}{level} HAVING count(*) >= {min_n}),
shrunk AS (SELECT c.*, baseline, pooled_std, scored_trips,
             (n_trips * raw_rate + 8.0 * baseline) / (n_trips + 8.0) AS shrunk_rate
           FROM cell c JOIN base b ON {on}),
lifted AS (SELECT *, greatest(0.0, shrunk_rate - pooled_std / sqrt(n_trips)) AS lower_rate FROM shrunk)"""


LIFT_COLS = (f"n_trips, {r6('raw_rate', 'raw_rate')}, {r6('median_rate', 'median_rate')}, "
             f"{r6('shrunk_rate', 'shrunk_rate')}, {r6('lower_rate', 'lower_rate')}, "
             f"{r6('shrunk_rate / baseline', 'lift')}, {r6('lower_rate / baseline', 'lift_lb')}, "
             f"{r6('baseline', 'baseline')}, scored_trips")
LIFT_NAMES = ["n_trips", "raw_rate", "median_rate", "shrunk_rate", "lower_rate", "lift", "lift_lb",
              "baseline", "scored_trips"]


@query("label_lift", f"{lift_sql('scored', 'labs', 'category', 3)} SELECT category, {LIFT_COLS} FROM lifted")
def label_lift(spark, sf):
    out = lift.label_lift(T.observations(spark, sf), T.labels(spark, sf))
    return out.select("category", *LIFT_NAMES).orderBy(F.desc("lift_lb"), "category")


@query("label_lift_slice", f"""
slice AS (SELECT * FROM frame WHERE rate IS NOT NULL AND season = 'summer' AND wind_band = 'windy'
          AND pressure_trend = 'rising' AND date_source = 'reservation' AND acres <= 45),
{lift_sql('slice', 'labs', 'subtype', 2)} SELECT subtype, {LIFT_COLS} FROM lifted""")
def label_lift_slice(spark, sf):
    part = lift.slice_filter(T.frame(spark, sf), season="summer", wind="windy", pressure="rising",
                             max_acres=45)
    return lift.label_lift(part, T.labels(spark, sf), level="subtype", min_n=2).select("subtype", *LIFT_NAMES)


for _key in ("month", "season", "pressure_trend", "cloud_band", "acres_band"):
    _src = "(SELECT * FROM frame WHERE rate IS NOT NULL" + (
        " AND date_source = 'reservation'" if _key in ("pressure_trend", "cloud_band") else "") + ")"

    @query(f"label_lift_by_{_key}",
           f"{lift_sql(_src, 'labs', 'category', 5, [_key])} SELECT {_key}, category, {LIFT_COLS} FROM lifted")
    def _by_group(spark, sf, key=_key):
        frame = T.frame(spark, sf)
        if key in ("pressure_trend", "cloud_band"):
            frame = frame.where(F.col("date_source") == "reservation")
        return lift.label_lift(frame, T.labels(spark, sf), min_n=5, keys=[key]).select(key, "category", *LIFT_NAMES)


@query("label_lift_by_group", f"""
{lift_sql('scored', 'labs', 'category', 3, ['unit', 'season'])}
SELECT unit, season, category, {LIFT_COLS} FROM lifted""")
def label_lift_by_group(spark, sf):
    out = lift.label_lift(T.observations(spark, sf), T.labels(spark, sf), keys=["unit", "season"])
    return out.select("unit", "season", "category", *LIFT_NAMES)


# --- label detail ---------------------------------------------------------------
@query("label_detail_subtypes", """
t AS (SELECT category, subtype, count(*) AS n FROM labs JOIN scored USING (obs_id)
      WHERE subtype <> 'unspecified' GROUP BY category, subtype)
SELECT category, subtype, n FROM t
QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, subtype) <= 4""")
def label_detail_subtypes(spark, sf):
    return lift.label_detail(T.observations(spark, sf), T.labels(spark, sf))["subtypes"]


@query("label_detail_colors", """
t AS (SELECT category, color, count(*) AS n FROM labs JOIN scored USING (obs_id)
      WHERE color IS NOT NULL GROUP BY category, color)
SELECT category, color, n FROM t
QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, color) <= 4""")
def label_detail_colors(spark, sf):
    return lift.label_detail(T.observations(spark, sf), T.labels(spark, sf))["colors"]


@query("label_detail_seasons", f"""
SELECT unit, category, season, count(*) AS n, {r6('avg(rate)')} AS rate
FROM scored JOIN (SELECT DISTINCT obs_id, category FROM labs) USING (obs_id)
GROUP BY unit, category, season HAVING count(*) >= 4""")
def label_detail_seasons(spark, sf):
    return lift.label_detail(T.observations(spark, sf), T.labels(spark, sf), ["unit"])["by_season"]


@query("label_detail", f"""
once AS (SELECT s.*, category FROM scored s JOIN (SELECT DISTINCT obs_id, category FROM labs) USING (obs_id)),
months AS (SELECT category, month, count(*) AS n, avg(rate) AS m FROM once GROUP BY category, month HAVING count(*) >= 3),
best AS (SELECT category, month AS best_month FROM months
         QUALIFY row_number() OVER (PARTITION BY category ORDER BY m DESC, month) = 1),
src AS (SELECT category, count(*) FILTER (WHERE source = 'field') AS from_field,
               count(*) FILTER (WHERE source = 'narrative') AS from_narrative
        FROM labs JOIN scored USING (obs_id) GROUP BY category)
SELECT category, best_month, from_field, from_narrative FROM src LEFT JOIN best USING (category)""")
def label_detail(spark, sf):
    parts = lift.label_detail(T.observations(spark, sf), T.labels(spark, sf))
    return parts["sources"].join(parts["best_month"], "category", "left")


# --- matched effects ------------------------------------------------------------
def effect_base_sql(source: str = "scored", things: str = "labs", column: str = "category",
                    where: str = "TRUE", prefix: str = "", columns: str = "*") -> str:
    """CTE ``flagged``: every scored observation crossed with the vocabulary, with
    a flag for use. Deliberately the naive statement of the comparison."""
    return f"""
{prefix}strata AS (SELECT obs_id, count(DISTINCT category) AS stratum FROM labs GROUP BY obs_id),
{prefix}things AS (SELECT DISTINCT obs_id, {column} AS label FROM {things} WHERE {where}),
{prefix}vocab AS (SELECT DISTINCT label FROM {prefix}things),
{prefix}flagged AS (
  SELECT s.*, coalesce(stratum, 0) AS stratum, v.label, t.obs_id IS NOT NULL AS used
  FROM (SELECT {columns} FROM {source}) s CROSS JOIN {prefix}vocab v
  LEFT JOIN {prefix}strata st ON st.obs_id = s.obs_id
  LEFT JOIN {prefix}things t ON t.obs_id = s.obs_id AND t.label = v.label)"""


def effect_sql(name: str, flagged: str, keys: list[str], min_stratum: int = 4) -> str:
    """CTE ``name``: inverse-variance combination over strata."""
    k = "".join(f"{x}, " for x in keys)
    return f"""
{name} AS (
  SELECT {k}label, sum(d / v) / sum(1.0 / v) AS diff, sqrt(1.0 / sum(1.0 / v)) AS se,
         CAST(sum(nu) AS BIGINT) AS n_used
  FROM (SELECT {k}label, stratum, count(*) FILTER (WHERE used) AS nu, count(*) FILTER (WHERE NOT used) AS no,
               avg(rate) FILTER (WHERE used) - avg(rate) FILTER (WHERE NOT used) AS d,
               var_samp(rate) FILTER (WHERE used) / count(*) FILTER (WHERE used)
               + var_samp(rate) FILTER (WHERE NOT used) / count(*) FILTER (WHERE NOT used) AS v
        FROM {flagged} GROUP BY {k}label, stratum)
  WHERE nu >= {min_stratum} AND no >= {min_stratum} AND v > 0 GROUP BY {k}label)"""


def usage_sql(name: str, flagged: str, keys: list[str]) -> str:
    k = "".join(f"{x}, " for x in keys)
    return f"""
{name} AS (
  SELECT {k}label, count(*) FILTER (WHERE used) AS trips, avg(rate) FILTER (WHERE used) AS rate,
         count(*) AS scored_n, avg(rate) AS baseline, count(*) FILTER (WHERE NOT used) AS other,
         100.0 * count(*) FILTER (WHERE used) / count(*) AS share,
         avg(rate) FILTER (WHERE used) - avg(rate) FILTER (WHERE NOT used) AS naive_diff
  FROM {flagged} GROUP BY {k}label)"""


def years_sql(flagged: str, keys: list[str], pooled: str = "pooled") -> str:
    """CTE ``years``: years measured and agreeing, and the verdict."""
    k = "".join(f"{x}, " for x in keys)
    by = [*keys, "year"]
    using = ", ".join([*keys, "label"])
    return f"""
{effect_sql('year_eff', flagged, by)},
{usage_sql('year_use', flagged, by)},
year_ok AS (SELECT {k}label, year, round(diff, 3) AS yd FROM year_eff JOIN year_use USING ({', '.join(by)}, label)
            WHERE scored_n >= 25 AND trips >= 8),
years AS (SELECT *, CASE WHEN years >= 3 THEN years_agreeing * 1.0 / years >= 2.0 / 3.0 END AS stable FROM (
  SELECT {k}label, count(yd) AS years, count(*) FILTER (WHERE (yd > 0) = (diff > 0)) AS years_agreeing
  FROM {pooled} LEFT JOIN year_ok USING ({using}) GROUP BY {k}label))"""


def support_sql(n: str, min_n: int, sugg: int, backed: int) -> str:
    return (f"CASE WHEN {n} < {min_n} THEN 'thin' WHEN hi < 0 THEN CASE WHEN stable = FALSE THEN 'unstable' ELSE 'below' END"
            f" WHEN lo > 0 THEN CASE WHEN stable = FALSE THEN 'unstable' WHEN {n} >= {backed} THEN 'backed'"
            f" WHEN {n} >= {sugg} THEN 'suggestive' ELSE 'thin' END"
            f" WHEN diff > 0 AND lo > -0.25 AND {n} >= {sugg} THEN 'suggestive' ELSE 'unproven' END")


FRAME_KEYS = ["unit", "year"]


def label_frame(spark, sf, keys):
    make = lambda by: E.strata_label_count(T.scored(spark, sf).select("obs_id", "rate", *by), T.labels(spark, sf))
    if not set(keys) <= set(FRAME_KEYS):
        return make(keys)
    return T.once("label_frame", sf, lambda: make(FRAME_KEYS)).select("obs_id", "rate", *keys, "things", "stratum")


def label_moments(spark, sf, keys):
    return E.moments(label_frame(spark, sf, keys), keys)


def tag_moments(spark, sf, keys):
    if not set(keys) <= set(FRAME_KEYS):
        return E.moments(E.with_tags(label_frame(spark, sf, keys), T.tags(spark, sf)), keys)
    frame = T.once("tag_frame", sf, lambda: E.with_tags(label_frame(spark, sf, FRAME_KEYS), T.tags(spark, sf)))
    return E.moments(frame, keys)


def settled_label_moments(spark, sf, keys):
    return settle(label_moments(spark, sf, keys))


@query("strata_label_count", """
strata AS (SELECT obs_id, count(DISTINCT category) AS n FROM labs GROUP BY obs_id)
SELECT obs.obs_id, coalesce(n, 0) AS stratum FROM obs LEFT JOIN strata USING (obs_id)""")
def strata_label_count(spark, sf):
    return E.strata_label_count(T.observations(spark, sf), T.labels(spark, sf)).select("obs_id", "stratum")


@query("stratified_effect", f"""
{effect_base_sql()}, {effect_sql('pooled', 'flagged', ['unit'])}
SELECT unit, label, {r6('diff', 'diff')}, {r6('se', 'se')}, n_used FROM pooled""")
def stratified_effect(spark, sf):
    return E.effects(label_moments(spark, sf, ["unit"]), ["unit"])


@query("effect_interval", f"""
{effect_base_sql()}, {effect_sql('pooled', 'flagged', [])}
SELECT label, {r6('diff', 'diff')}, {r6('diff - 1.96 * se', 'lo')}, {r6('diff + 1.96 * se', 'hi')} FROM pooled""")
def effect_interval(spark, sf):
    return E.with_interval(E.effects(label_moments(spark, sf, []), [])).select("label", "diff", "lo", "hi")


@query("classify_support", f"""
{effect_base_sql()}, {effect_sql('pooled', 'flagged', ['unit'])}
SELECT unit, label, {support_sql('n_used', 6, 12, 15)} AS support FROM (
  SELECT *, diff - 1.96 * se AS lo, diff + 1.96 * se AS hi, CASE WHEN n_used % 3 = 0 THEN FALSE WHEN n_used % 3 = 1 THEN TRUE END AS stable
  FROM pooled)""")
def classify_support(spark, sf):
    eff = E.with_interval(E.effects(label_moments(spark, sf, ["unit"]), ["unit"]))
    stable = F.when(F.col("n_used") % 3 == 0, False).when(F.col("n_used") % 3 == 1, True)
    return eff.select("unit", "label", E.support_case(
        F.col("diff"), F.col("lo"), F.col("hi"), F.col("n_used"), 6, 12, 15, stable).alias("support"))


@query("year_consistency", f"""
{effect_base_sql()}, {effect_sql('pooled', 'flagged', ['unit'])}, {years_sql('flagged', ['unit'])}
SELECT unit, label, years, years_agreeing, stable FROM years""")
def year_consistency(spark, sf):
    m = settled_label_moments(spark, sf, ["unit", "year"])
    pooled = E.effects(E.merge_moments(m, ["unit", "stratum", "label"]), ["unit"])
    return E.year_consistency(m, pooled, ["unit"]).drop("per_year")


CLUB_SQL = f"""
{effect_base_sql()}, {effect_sql('pooled_all', 'flagged', [])}, {usage_sql('club_use', 'flagged', [])},
pooled AS (SELECT p.* FROM pooled_all p JOIN club_use USING (label) WHERE trips >= 60 AND scored_n >= 200),
{years_sql('flagged', [])}"""


@query("club_stability", f"""{CLUB_SQL}
SELECT label, years, years_agreeing, stable, {r6('diff', 'diff')} FROM years JOIN pooled USING (label)""")
def club_stability(spark, sf):
    return E.club_stability(settled_label_moments(spark, sf, ["year"])).drop("per_year")


@query("naive_effect", f"""
{effect_base_sql()}, {usage_sql('use', 'flagged', ['unit'])}
SELECT unit, label, trips, other, {r6('naive_diff', 'naive_diff')} FROM use WHERE trips > 0""")
def naive_effect(spark, sf):
    return E.usage(label_moments(spark, sf, ["unit"]), ["unit"]).select("unit", "label", "trips", "other", "naive_diff")


EVIDENCE_COLS = ["unit", "label", "trips", "share", "rate", "baseline", "diff", "lo", "hi", "naive_diff",
                 "years", "years_agreeing", "stable", "club_unstable", "support"]
EVIDENCE_SQL = f"""
{effect_base_sql()}, {usage_sql('use', 'flagged', ['unit'])}, {effect_sql('pooled', 'flagged', ['unit'])},
{years_sql('flagged', ['unit'])},
club AS (SELECT label FROM (WITH {CLUB_SQL} SELECT label FROM years WHERE stable = FALSE)),
evidence AS (
  SELECT unit, label, trips, share, rate, baseline, diff, lo, hi, naive_diff, coalesce(years, 0) AS years,
         coalesce(years_agreeing, 0) AS years_agreeing, stable,
         label IN (SELECT label FROM club) AS club_unstable,
         CASE WHEN diff IS NULL THEN 'thin' ELSE {support_sql('trips', 6, 12, 15)} END AS support
  FROM (SELECT *, diff - 1.96 * se AS lo, diff + 1.96 * se AS hi
        FROM use LEFT JOIN pooled USING (unit, label) LEFT JOIN years USING (unit, label)
        WHERE scored_n >= 12 AND trips >= 6 AND other >= 4))"""


def evidence(spark, sf):
    m = settled_label_moments(spark, sf, ["unit", "year"])
    club = E.club_stability(E.merge_moments(m, ["year", "stratum", "label"]))
    return E.label_evidence(m, ["unit"], club).select(*EVIDENCE_COLS)


_EV = ", ".join(r6(c, c) if c in ("share", "rate", "baseline", "diff", "lo", "hi", "naive_diff") else c
                for c in EVIDENCE_COLS)


@query("label_evidence", f"{EVIDENCE_SQL} SELECT {_EV} FROM evidence")
def label_evidence(spark, sf):
    return evidence(spark, sf).orderBy("unit", E.support_rank(E.LABEL_SUPPORT_ORDER), F.desc_nulls_last("diff"))


def summary_sql(source: str, keys: str, noun: str) -> str:
    lists = ",\n  ".join(f"coalesce(string_agg(label, ', ' ORDER BY diff DESC NULLS LAST, label) FILTER (WHERE support = '{s}'), '') AS {s}"
                         for s in SUPPORTS)
    key, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""grp AS (SELECT {key}count(*) AS n_compared, {lists},
  count(*) FILTER (WHERE support = 'backed') AS n_backed, max(trips) FILTER (WHERE support = 'suggestive') AS most,
  arg_min(label, (-trips, -diff, label)) FILTER (WHERE support = 'suggestive') AS closest FROM {source} {group})
SELECT {key}n_compared, {', '.join(SUPPORTS)},
  CASE WHEN n_backed = 1 THEN backed || ' alone holds up in the matched comparison'
       WHEN n_backed > 1 THEN CAST(n_backed AS VARCHAR) || ' {noun}s hold up in the matched comparison: ' || backed
       WHEN closest IS NOT NULL THEN 'No {noun} holds up; nearest is ' || closest || ' with n=' || CAST(most AS VARCHAR)
       ELSE 'No {noun} differs from the rest in the matched comparison' END AS lead FROM grp"""


@query("support_summary", f"{EVIDENCE_SQL},\n{summary_sql('evidence', 'unit', 'label')}")
def support_summary(spark, sf):
    return summarise(evidence(spark, sf), ["unit"])


TAG_COLS = ["label", "trips", "share", "rate", "baseline", "diff", "lo", "hi", "naive_diff", "years",
            "years_agreeing", "stable", "support"]
_TG = ", ".join(r6(c, c) if c in ("share", "rate", "baseline", "diff", "lo", "hi", "naive_diff") else c
                for c in TAG_COLS)
TAG_SQL = f"""
{effect_base_sql(things='tags', column='value', where="kind = 'technique'")},
{usage_sql('use', 'flagged', [])}, {effect_sql('pooled', 'flagged', [])}, {years_sql('flagged', [])},
tag_eff AS (
  SELECT label, trips, share, rate, baseline, diff, lo, hi, naive_diff, years, years_agreeing, stable,
         {support_sql('trips', 25, 40, 60)} AS support
  FROM (SELECT *, diff - 1.96 * se AS lo, diff + 1.96 * se AS hi FROM use JOIN pooled USING (label)
        LEFT JOIN years USING (label) WHERE scored_n >= 40 AND trips >= 25))"""


def tag_rows(spark, sf):
    return E.tag_effects(settle(tag_moments(spark, sf, ["year"])), [])


@query("tag_effects", f"{TAG_SQL} SELECT {_TG} FROM tag_eff")
def tag_effects(spark, sf):
    return tag_rows(spark, sf).select(*TAG_COLS)


@query("tag_effects_per_year", f"""{TAG_SQL}
SELECT label, year, {r6('yd', 'year_diff')} FROM year_ok JOIN tag_eff USING (label)""")
def tag_effects_per_year(spark, sf):
    return tag_rows(spark, sf).select("label", F.explode("per_year").alias("year", "year_diff"))


UNIT_TAG_SQL = f"""
{effect_base_sql(things='tags', column='value', where="kind = 'technique'")},
{usage_sql('use', 'flagged', ['unit'])}, {effect_sql('pooled', 'flagged', ['unit'])},
unit_tag AS (SELECT *, {support_sql('trips', 12, 40, 25)} AS support FROM (
  SELECT *, diff - 1.96 * se AS lo, diff + 1.96 * se AS hi, NULL::BOOLEAN AS stable
  FROM use JOIN pooled USING (unit, label) WHERE scored_n >= 40 AND trips >= 12))"""


@query("unit_tag_effects", f"""{UNIT_TAG_SQL}
SELECT unit, label, trips, {r6('diff', 'diff')}, {r6('lo', 'lo')}, {r6('hi', 'hi')}, support FROM unit_tag""")
def unit_tag_effects(spark, sf):
    return E.unit_tag_effects(settle(tag_moments(spark, sf, ["unit"])), ["unit"]).select(
        "unit", "label", "trips", "diff", "lo", "hi", "support")


@query("tag_support_summary", f"{TAG_SQL},\n{summary_sql('tag_eff', '', 'presentation')}")
def tag_support_summary(spark, sf):
    return summarise(tag_rows(spark, sf), [], "presentation")


@query("unit_tag_support_summary", f"{UNIT_TAG_SQL},\n{summary_sql('unit_tag', 'unit', 'presentation')}")
def unit_tag_support_summary(spark, sf):
    return summarise(E.unit_tag_effects(settle(tag_moments(spark, sf, ["unit"])), ["unit"]), ["unit"], "presentation")


@query("club_tag_panel", f"""{TAG_SQL}
SELECT label, trips, {r6('diff', 'diff')}, support FROM tag_eff WHERE support <> 'thin'""")
def club_tag_panel(spark, sf, top: int | None = None):
    """The whole panel, or its first rows."""
    rows = tag_rows(spark, sf).where(F.col("support") != "thin").orderBy(
        E.support_rank(E.TAG_SUPPORT_ORDER), F.desc("diff"), "label").select("label", "trips", "diff", "support")
    return rows if top is None else rows.limit(top)


# --- size bands -----------------------------------------------------------------
@query("size_band", """
SELECT unit_id, unit, CASE WHEN acres > 0 AND acres <= 15 THEN 'small' WHEN acres > 15 AND acres <= 30 THEN 'mid'
  WHEN acres > 30 THEN 'large' END AS band FROM units""")
def size_band_query(spark, sf):
    return T.units(spark, sf).select("unit_id", "unit", size_band(F.col("acres")).alias("band"))


BANDED = """banded AS (SELECT f.*, CASE WHEN acres <= 15 THEN 'small' WHEN acres <= 30 THEN 'mid' ELSE 'large' END AS band
  FROM (SELECT o.*, u.acres FROM scored o JOIN units u USING (unit_id)) f WHERE acres > 0)"""


def half_sql(source: str, keys: list[str]) -> str:
    p = ", ".join(keys)
    return f"""halved AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {p} ORDER BY obs_date, obs_id)
  <= floor(count(*) OVER (PARTITION BY {p}) / 2) THEN 'early' ELSE 'late' END AS half FROM {source})"""


def band_sql(things: str, column: str, where: str) -> str:
    return f"""{BANDED}, {half_sql('banded', ['band'])},
{effect_base_sql('halved', things, column, where)},
{usage_sql('use', 'flagged', ['band'])}, {effect_sql('pooled', 'flagged', ['band'])},
{effect_sql('half_eff', 'flagged', ['band', 'half'])}, {usage_sql('half_use', 'flagged', ['band', 'half'])},
half_ok AS (SELECT band, label, half, e.diff AS hd FROM half_eff e JOIN half_use h USING (band, half, label)
            WHERE scored_n >= 80 AND trips >= 15 AND band IN (SELECT band FROM halved GROUP BY band HAVING count(*) >= 300)),
stab AS (SELECT band, label, halves, CASE WHEN halves = 2 THEN agree ELSE 0 END AS halves_agreeing,
                CASE WHEN halves = 2 THEN agree = 2 END AS stable FROM (
  SELECT p.band, p.label, count(hd) AS halves, count(*) FILTER (WHERE (hd > 0) = (p.diff > 0)) AS agree
  FROM pooled p LEFT JOIN half_ok h ON h.band = p.band AND h.label = p.label GROUP BY p.band, p.label)),
band_eff AS (SELECT *, {support_sql('trips', 40, 60, 90)} AS support FROM (
  SELECT *, diff - 1.96 * se AS lo, diff + 1.96 * se AS hi FROM use JOIN pooled USING (band, label)
  JOIN stab USING (band, label) WHERE scored_n >= 300 AND trips >= 40))"""


_BAND_OUT = (f"band, label, trips, {r6('diff', 'diff')}, {r6('lo', 'lo')}, {r6('hi', 'hi')}, halves, "
             "halves_agreeing, support")


@query("band_effects", f"{band_sql('labs', 'category', 'TRUE')} SELECT {_BAND_OUT} FROM band_eff")
def band_effects(spark, sf):
    return C.band_effects(banded(spark, sf), T.labels(spark, sf))


@query("band_tag_effects", f"""{band_sql('tags', 'value', "kind = 'technique'")} SELECT {_BAND_OUT} FROM band_eff""")
def band_tag_effects(spark, sf):
    return C.band_effects(banded(spark, sf), T.labels(spark, sf), T.tags(spark, sf))


def banded(spark, sf):
    return C.with_band(T.scored(spark, sf).join(T.units(spark, sf).select("unit_id", "acres"), "unit_id"))


@query("band_summary", f"""{BANDED}
SELECT band, count(DISTINCT unit) AS units, count(*) AS trips, {r6('median(acres)')} AS median_acres,
  {r6('avg(rate)')} AS mean_rate FROM banded GROUP BY band""")
def band_summary(spark, sf):
    return C.band_summary(banded(spark, sf))


@query("half_stability", f"""{band_sql('labs', 'category', 'TRUE')}
SELECT band, label, halves, halves_agreeing, stable FROM stab""")
def half_stability(spark, sf):
    m = C.band_moments(banded(spark, sf), T.labels(spark, sf))
    pooled = E.effects(E.merge_moments(m, ["band", "stratum", "label"]), ["band"])
    return E.half_stability(m, pooled, ["band"])


@query("band_advice", f"""{band_sql('labs', 'category', 'TRUE')},
verdicts AS (SELECT band, label, diff, CASE WHEN support = 'backed' AND diff > 0 THEN 'use'
   WHEN support IN ('backed', 'below') AND diff < 0 THEN 'avoid' END AS advice FROM band_eff),
ranked AS (SELECT *, row_number() OVER (PARTITION BY band, advice ORDER BY abs(diff) DESC, label) AS rank
  FROM verdicts WHERE advice IS NOT NULL)
SELECT unit, r.band, advice, rank, label, {r6('diff', 'diff')} FROM ranked r JOIN (
  SELECT unit, CASE WHEN acres > 0 AND acres <= 15 THEN 'small' WHEN acres > 15 AND acres <= 30 THEN 'mid' WHEN acres > 30 THEN 'large' END AS band
  FROM units) u ON u.band = r.band WHERE rank <= 4""")
def band_advice(spark, sf):
    rows = C.band_effects(banded(spark, sf), T.labels(spark, sf))
    return C.band_advice(rows, T.units(spark, sf))


# --- repeatability ----------------------------------------------------------------
SPLIT_UNITS = """big AS (SELECT unit FROM obs WHERE unit IS NOT NULL GROUP BY unit),
split_src AS (SELECT * FROM scored WHERE unit IN (SELECT unit FROM big)
  AND unit IN (SELECT unit FROM scored GROUP BY unit HAVING count(*) >= 60))"""


def split_sql(things: str, column: str, where: str) -> str:
    return f"""{SPLIT_UNITS}, {half_sql('split_src', ['unit'])},
{effect_base_sql('halved', things, column, where)},
{effect_sql('half_eff', 'flagged', ['unit', 'half'], 3)}, {usage_sql('half_use', 'flagged', ['unit', 'half'])},
half_ok AS (SELECT unit, label, half, e.diff AS hd FROM half_eff e JOIN half_use USING (unit, half, label)
            WHERE scored_n >= 20 AND trips >= 8),
pairs AS (SELECT a.unit, a.label, a.hd AS early, b.hd AS late FROM half_ok a JOIN half_ok b
          ON a.unit = b.unit AND a.label = b.label AND a.half = 'early' AND b.half = 'late'),
summary AS (SELECT count(*) AS cells, count(DISTINCT unit) AS units,
   covar_pop(early, late) / nullif(stddev_pop(early) * stddev_pop(late), 0) AS r,
   avg(CASE WHEN sign(early) = sign(late) THEN 1.0 ELSE 0.0 END) AS agree FROM pairs)"""


def halved_units(spark, sf):
    return T.once("halved_units", sf, lambda: C.halved_units(T.observations(spark, sf)))


def split_pairs(spark, sf, tags=False):
    frame = T.once("halved_label_frame", sf, lambda: E.strata_label_count(halved_units(spark, sf), T.labels(spark, sf)))
    if tags:
        frame = E.with_tags(frame, T.tags(spark, sf))
    return E.split_half(settle(E.moments(frame, ["unit", "half"])))


@query("split_half", f"""{split_sql('labs', 'category', 'TRUE')}
SELECT cells, CASE WHEN cells >= 15 THEN units END AS units, CASE WHEN cells >= 15 THEN {r6('r')} END AS r,
  CASE WHEN cells >= 15 THEN {r6('agree')} END AS sign_agreement, CASE WHEN cells >= 15 THEN r >= 0.25 END AS repeats FROM summary""")
def split_half(spark, sf):
    return E.split_half_summary(split_pairs(spark, sf))


@query("split_half_cells", f"""{split_sql('labs', 'category', 'TRUE')}
SELECT unit, label, {r6('early', 'early')}, {r6('late', 'late')} FROM pairs""")
def split_half_cells(spark, sf):
    return split_pairs(spark, sf)


@query("half_split", f"""{half_sql('obs', ['unit'])} SELECT obs_id, unit, half FROM halved""")
def half_split(spark, sf):
    return E.half_split(T.observations(spark, sf), ["unit"]).select("obs_id", "unit", "half")


RATE_SPLIT_SQL = f"""{SPLIT_UNITS}, {half_sql('split_src', ['unit'])},
unit_halves AS (SELECT unit, avg(rate) FILTER (WHERE half = 'early') AS early, avg(rate) FILTER (WHERE half = 'late') AS late
  FROM halved GROUP BY unit),
rate_r AS (SELECT count(*) AS units, covar_pop(early, late) / nullif(stddev_pop(early) * stddev_pop(late), 0) AS r FROM unit_halves)"""


@query("rate_split_half", f"""{RATE_SPLIT_SQL}
SELECT units, CASE WHEN units >= 10 THEN {r6('r')} END AS r FROM rate_r""")
def rate_split_half(spark, sf):
    return C.rate_split_half(T.observations(spark, sf))


@query("reliability_report", f"""
SELECT 'unit_rate' AS what, * FROM (WITH {RATE_SPLIT_SQL} SELECT units AS cells, CASE WHEN units >= 10 THEN {r6('r')} END AS r, NULL::DOUBLE AS sign_agreement FROM rate_r)
UNION ALL SELECT 'unit_labels', * FROM (WITH {split_sql('labs', 'category', 'TRUE')} SELECT cells, CASE WHEN cells >= 15 THEN {r6('r')} END, CASE WHEN cells >= 15 THEN {r6('agree')} END FROM summary)
UNION ALL SELECT 'unit_tags', * FROM (WITH {split_sql('tags', 'value', "kind = 'technique'")} SELECT cells, CASE WHEN cells >= 15 THEN {r6('r')} END, CASE WHEN cells >= 15 THEN {r6('agree')} END FROM summary)""")
def reliability_report(spark, sf):
    """The units are halved once for all three rows."""
    with T.shared_facts():
        out = C.rate_halves(halved_units(spark, sf)).select(
            F.lit("unit_rate").alias("what"), F.col("units").alias("cells"), "r",
            F.lit(None).cast("double").alias("sign_agreement"))
        for what, tags in (("unit_labels", False), ("unit_tags", True)):
            part = E.split_half_summary(split_pairs(spark, sf, tags))
            out = out.unionByName(part.select(F.lit(what).alias("what"), "cells", "r", "sign_agreement"))
    return out
