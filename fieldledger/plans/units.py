"""Per-unit figures on the bound tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import miles_from_home
from ..operators import units as U
from . import testbed as T
from .registry import query, r6

CONSISTENCY = """cons AS (SELECT *, CASE WHEN cv <= 0.70 THEN 'steady' WHEN cv <= 0.95 THEN 'typical' WHEN cv IS NOT NULL THEN 'swingy' END AS band FROM (
  SELECT unit, count(*) AS trips, median(rate) AS median, avg(rate) AS mean, stddev_samp(rate) / avg(rate) AS cv,
    quantile_cont(rate, 0.1) AS worst_decile, quantile_cont(rate, 0.9) AS best_decile,
    100.0 * avg(CASE WHEN count_total <= 2 THEN 1.0 ELSE 0.0 END) AS bust_rate, count(count_total) AS bust_n,
    median(count_total) AS typical_count
  FROM scored GROUP BY unit HAVING count(*) >= 20)),
club AS (SELECT round(100.0 * avg(CASE WHEN count_total <= 2 THEN 1.0 ELSE 0.0 END), 1) AS bust_rate, count(*) AS n FROM scored)"""

HOME_MILES = ("2 * 3958.8 * asin(sqrt(pow(sin(radians({lat} - 32.7767::DOUBLE) / 2), 2) + cos(radians(32.7767::DOUBLE))"
              " * cos(radians({lat})) * pow(sin(radians({lon} - (-96.7970::DOUBLE)) / 2), 2)))")


def cols(*names):
    return ", ".join(r6(n, n) for n in names)


@query("unit_consistency", f"""{CONSISTENCY}
SELECT unit, trips, band, bust_n, {cols('median', 'mean', 'cv', 'worst_decile', 'best_decile', 'bust_rate', 'typical_count')} FROM cons""")
def unit_consistency(spark, sf):
    return U.unit_consistency(T.observations(spark, sf))


@query("bust_rate", f"{CONSISTENCY} SELECT {cols('bust_rate')}, n FROM club")
def bust_rate(spark, sf):
    return U.bust_rate(T.observations(spark, sf))


@query("consistency_sentence", f"""{CONSISTENCY}
SELECT unit, CASE band WHEN 'steady' THEN 'Low spread: ' WHEN 'typical' THEN 'Its spread is in the middle fifth for the club: '
   WHEN 'swingy' THEN 'High spread: ' ELSE '' END
 || 'median count ' || CAST(CAST(round_even(typical_count, 0) AS BIGINT) AS VARCHAR) || ' fish; tenth percentile '
 || CAST(round(worst_decile, 2) AS VARCHAR) || ' an hour; ' || CAST(CAST(round_even(bust_rate, 0) AS BIGINT) AS VARCHAR)
 || '% of trips landed at most 2'
 || CASE WHEN round_even(bust_rate, 0) < cb THEN ', under the archive''s ' WHEN round_even(bust_rate, 0) > cb THEN ', over the archive''s ' ELSE ', equal to the archive''s ' END
 || CAST(CAST(round_even(cb, 0) AS BIGINT) AS VARCHAR) || '%.' AS sentence
FROM cons CROSS JOIN (SELECT bust_rate AS cb FROM club)""")
def consistency_sentence(spark, sf):
    obs = T.observations(spark, sf)
    return U.consistency_sentence(U.unit_consistency(obs), U.bust_rate(obs).select("bust_rate").scalar())


COHORTS = """per AS (SELECT unit_id, count(*) AS trips, round(count(veg) * 1.0 / count(*), 3) AS veg_rate, median(clarity_ft) AS clarity_ft,
   count(clarity_ft) AS clarity_n FROM obs LEFT JOIN (SELECT DISTINCT obs_id, 1 AS veg FROM tags WHERE kind = 'vegetation') USING (obs_id) GROUP BY unit_id),
cohorts AS (SELECT unit_id, unit, trips, veg_rate, clarity_ft, clarity_n, acres,
  CASE WHEN small AND veg_rate >= 0.25 AND coalesce(clarity_ft >= 2, FALSE) THEN 'small_clear_grassy'
       WHEN small AND veg_rate >= 0.25 THEN 'small_grassy' WHEN small THEN 'small_other'
       WHEN veg_rate >= 0.25 THEN 'larger_grassy' ELSE 'larger_open' END AS cohort
  FROM (SELECT *, coalesce(acres <= 30, FALSE) AS small FROM per JOIN units USING (unit_id)))"""


def cohorts(spark, sf):
    return U.assign_cohorts(T.observations(spark, sf), T.units(spark, sf), T.tags(spark, sf))


@query("assign_cohorts", f"{COHORTS} SELECT unit_id, unit, trips, {cols('veg_rate', 'clarity_ft', 'acres')}, clarity_n, cohort FROM cohorts")
def assign_cohorts(spark, sf):
    return cohorts(spark, sf)


UNIT_TABLE = """tab AS (SELECT u.unit, u.town, count(*) AS trips, u.acres, u.max_depth_ft, u.day_rate, median(rate) AS median_rate,
  max(max_weight) AS best, median(clarity_ft) AS clarity FROM obs JOIN units u USING (unit_id) GROUP BY ALL HAVING count(*) >= 15)"""


@query("unit_table", f"{UNIT_TABLE} SELECT unit, town, trips, {cols('acres', 'max_depth_ft', 'day_rate', 'median_rate', 'best', 'clarity')} FROM tab")
def unit_table(spark, sf):
    return U.unit_table(T.observations(spark, sf), T.units(spark, sf)).orderBy(F.desc("trips"), "unit")


@query("unit_scorecard", f"""
SELECT unit, count(*) AS trips, count(rate) AS scored_trips, CAST(min(obs_date) AS VARCHAR) AS first, CAST(max(obs_date) AS VARCHAR) AS last,
  {r6('median(rate)')} AS median_rate, {r6('max(max_weight)')} AS best, {r6('avg(max_weight)')} AS avg_best, {r6('median(clarity_ft)')} AS clarity_median,
  count(clarity_ft) AS clarity_n, count(water_temp_f) AS water_temp_n, {r6('count(veg) * 1.0 / count(*)')} AS veg_mention_rate,
  {r6('(SELECT median(rate) FROM scored)')} AS club_median
FROM obs LEFT JOIN (SELECT DISTINCT obs_id, 1 AS veg FROM tags WHERE kind = 'vegetation') USING (obs_id) GROUP BY unit""")
def unit_scorecard(spark, sf):
    return U.unit_scorecard(T.observations(spark, sf), T.tags(spark, sf))


@query("species_mix", f"""
per AS (SELECT unit, species, sum(n) AS n FROM obs JOIN catches USING (obs_id) WHERE species <> 'unspecified' GROUP BY unit, species)
SELECT unit, species, CAST(n AS BIGINT) AS n, {r6('100.0 * n / sum(n) OVER (PARTITION BY unit)')} AS pct FROM per""")
def species_mix(spark, sf):
    return U.species_mix(T.observations(spark, sf), T.catches(spark, sf))


@query("value_counts_pct", f"""
per AS (SELECT unit, value, count(*) AS n FROM obs JOIN tags USING (obs_id) WHERE kind = 'structure' GROUP BY unit, value),
total AS (SELECT unit, count(*) AS total FROM obs GROUP BY unit)
SELECT unit, value, n, {r6('100.0 * n / total')} AS pct FROM per JOIN total USING (unit)
QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n DESC, value) <= 4""")
def value_counts_pct(spark, sf):
    obs = T.observations(spark, sf).select("obs_id", "unit")
    named = obs.join(T.tags(spark, sf).where(F.col("kind") == "structure"), "obs_id")
    return U.value_counts_pct(named, "value", obs.groupBy("unit").agg(F.count("*").alias("total")), ["unit"], 4)


@query("rate_summary", f"""
per AS (SELECT unit, median(rate) AS median, avg(rate) AS mean, max(rate) AS best_trip FROM scored GROUP BY unit)
SELECT unit, {cols('median', 'mean', 'best_trip')}, {r6('CASE WHEN (SELECT count(*) FROM per) > 5 THEN 100.0 * (SELECT count(*) FROM per q WHERE q.median < per.median) / (SELECT count(*) FROM per) END')} AS percentile,
  {r6('(SELECT median(rate) FROM scored)')} AS club_median FROM per""")
def rate_summary(spark, sf):
    return U.rate_summary(T.observations(spark, sf))


@query("rate_by_month", f"""
spine AS (SELECT unit, CAST(m AS BIGINT) AS month FROM (SELECT DISTINCT unit FROM scored) CROSS JOIN generate_series(1, 12) g(m)),
per AS (SELECT unit, month, count(*) AS n, median(rate) AS md, avg(rate) AS mn FROM scored GROUP BY unit, month)
SELECT unit, month, coalesce(n, 0) AS n, {r6('md')} AS median, {r6('mn')} AS mean FROM spine LEFT JOIN per USING (unit, month)""")
def rate_by_month(spark, sf):
    return U.rate_by_month(T.observations(spark, sf))


for _name, _col in (("by_slot", "slot"), ("by_year", "year")):
    @query(_name, f"SELECT unit, {_col}, count(*) AS n, {r6('median(rate)')} AS median, {r6('avg(rate)')} AS mean FROM scored GROUP BY unit, {_col}")
    def _rate_by(spark, sf, col=_col):
        return U.rate_by(T.observations(spark, sf), ["unit", col])


@query("water_panel", f"""
k AS (SELECT obs_id, count(*) FILTER (WHERE kind='vegetation') AS v, count(*) FILTER (WHERE kind='structure') AS s, count(*) FILTER (WHERE kind='technique') AS t,
  count(*) FILTER (WHERE detail='heavy') AS dh, count(*) FILTER (WHERE detail='moderate') AS dm, count(*) FILTER (WHERE detail='light') AS dl FROM tags GROUP BY obs_id)
SELECT unit, {r6('median(clarity_ft)')} AS clarity_median, count(clarity_ft) AS clarity_n, {r6('median(water_temp_f)')} AS water_temp_median,
  count(water_temp_f) AS water_temp_n, {r6('median(depth_max_ft)')} AS depth_median, count(depth_max_ft) AS depth_n,
  count(*) FILTER (WHERE clarity_ft <= 1) AS clarity_murky, count(*) FILTER (WHERE clarity_ft > 1 AND clarity_ft <= 3) AS clarity_stained,
  count(*) FILTER (WHERE clarity_ft > 3) AS clarity_clear,
  CAST(coalesce(sum(v),0) AS BIGINT) AS vegetation, CAST(coalesce(sum(s),0) AS BIGINT) AS structure, CAST(coalesce(sum(t),0) AS BIGINT) AS technique,
  CAST(coalesce(sum(dh),0) AS BIGINT) AS density_heavy, CAST(coalesce(sum(dm),0) AS BIGINT) AS density_moderate, CAST(coalesce(sum(dl),0) AS BIGINT) AS density_light,
  {r6('100.0 * count(*) FILTER (WHERE v > 0) / count(*)')} AS veg_mention_rate
FROM obs LEFT JOIN k USING (obs_id) GROUP BY unit""")
def water_panel(spark, sf):
    from ..functions import bands as B
    obs = T.observations(spark, sf).withColumn(
        "clarity_band", B.cut_right(F.col("clarity_ft"), B.CLARITY_EDGES, B.CLARITY_NAMES))
    return U.water_panel(obs, T.tags(spark, sf))


@query("weight_bands", f"""
w AS (SELECT unit, max_weight, CASE WHEN max_weight > 0 AND max_weight <= 2 THEN '<2 lb' WHEN max_weight > 2 AND max_weight <= 3 THEN '2-3'
  WHEN max_weight > 3 AND max_weight <= 5 THEN '3-5' WHEN max_weight > 5 AND max_weight <= 8 THEN '5-8' WHEN max_weight > 8 AND max_weight <= 100 THEN '8+' END AS band
  FROM obs WHERE max_weight IS NOT NULL),
t AS (SELECT unit, count(*) AS total, max(max_weight) AS best, median(max_weight) AS median_best, 100.0 * count(*) FILTER (WHERE max_weight >= 5) / count(*) AS over_5_rate FROM w GROUP BY unit)
SELECT unit, band, count(*) AS n, any_value(total) AS total, {r6('any_value(best)')} AS best, {r6('any_value(median_best)')} AS median_best,
  {r6('any_value(over_5_rate)')} AS over_5_rate, {r6('100.0 * count(*) / any_value(total)')} AS pct FROM w JOIN t USING (unit) WHERE band IS NOT NULL GROUP BY unit, band""")
def weight_bands(spark, sf):
    return U.weight_bands(T.observations(spark, sf))


@query("conditions_panel", f"""
long AS (SELECT unit, rate, 'pressure_trend' AS condition, pressure_trend AS value FROM frame WHERE rate IS NOT NULL
  UNION ALL SELECT unit, rate, 'wind_band', wind_band FROM frame WHERE rate IS NOT NULL
  UNION ALL SELECT unit, rate, 'cloud_band', cloud_band FROM frame WHERE rate IS NOT NULL)
SELECT unit, condition, value, count(*) AS n, {r6('median(rate)')} AS median FROM long WHERE value IS NOT NULL
GROUP BY unit, condition, value HAVING count(*) >= 5""")
def conditions_panel(spark, sf):
    return U.conditions_panel(T.frame(spark, sf))


@query("typical_conditions", f"""
SELECT unit, count(*) AS weather_n, {r6('median(temp_max_f)')} AS temp_max_f, {r6('median(wind_max_mph)')} AS wind_mph, {r6('median(cloud_pct)')} AS cloud_pct
FROM frame WHERE rate IS NOT NULL AND temp_max_f IS NOT NULL GROUP BY unit""")
def typical_conditions(spark, sf):
    return U.typical_conditions(T.frame(spark, sf))


@query("unit_volume", """
SELECT *, CASE WHEN scored >= 80 THEN 'good' WHEN scored >= 30 THEN 'fair' WHEN scored >= 10 THEN 'thin' ELSE 'very thin' END AS confidence FROM (
SELECT unit, count(*) AS reports, count(rate) AS scored, CAST(min(obs_date) AS VARCHAR) AS first, CAST(max(obs_date) AS VARCHAR) AS last,
  count(*) FILTER (WHERE date_source = 'reservation') AS exact_dates FROM obs GROUP BY unit)""")
def unit_volume(spark, sf):
    return U.unit_volume(T.observations(spark, sf))


@query("headline", f"""
SELECT count(*) AS reports, count(DISTINCT unit_id) AS units, count(rate) AS scored, CAST(min(obs_date) AS VARCHAR) AS first, CAST(max(obs_date) AS VARCHAR) AS last,
  min(year) FILTER (WHERE rate IS NOT NULL) AS scored_from, max(year) FILTER (WHERE rate IS NOT NULL) AS scored_to,
  {r6('median(rate)')} AS median_rate, {r6('max(max_weight)')} AS best, {r6('100.0 * avg(CASE WHEN unit_id IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS unit_known_pct FROM obs""")
def headline(spark, sf):
    return U.headline(T.observations(spark, sf))


@query("unit_filter_search", f"""{COHORTS}, pool AS (SELECT c.*, u.town, u.region, u.day_rate, {HOME_MILES.format(lat='u.lat', lon='u.lon')} AS miles FROM cohorts c JOIN units u USING (unit_id))
SELECT unit, town, region, cohort, trips, {cols('miles', 'day_rate')} FROM pool
WHERE coalesce(miles <= 400, TRUE) AND coalesce(trips, 0) >= 10 AND coalesce(day_rate <= 140, TRUE)
  AND contains(lower(concat_ws(' ', unit, town, region, cohort)), 'grassy')""")
def unit_filter_search(spark, sf):
    pool = cohorts(spark, sf).join(T.units(spark, sf).select("unit_id", "town", "region", "day_rate", "lat", "lon"), "unit_id") \
        .withColumn("miles", miles_from_home(F.col("lat"), F.col("lon")))
    out = U.unit_filter_search(pool, max_miles=400, min_trips=10, max_price=140, text="Grassy")
    return out.select("unit", "town", "region", "cohort", "trips", "miles", "day_rate")
