"""Expected rates, rankings, backtests, similar days and the drive question."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recommend as R
from . import testbed as T
from .effects import lift_sql
from .registry import query, r6
from .units import COHORTS, CONSISTENCY, HOME_MILES, cols, cohorts

AS_OF_YEAR, MONTH, DAY = 2001, 7, "2001-07-14"


def expected_sql(src: str = "scored", month: int = MONTH) -> str:
    return f"""
clubm AS (SELECT avg(rate) AS cm, coalesce(avg(rate) FILTER (WHERE month = {month}), avg(rate)) AS cmm FROM {src}),
per_u AS (SELECT unit, count(*) AS n_total, count(*) FILTER (WHERE year >= {AS_OF_YEAR - 3}) AS n_recent, avg(rate) AS am,
  avg(rate) FILTER (WHERE year >= {AS_OF_YEAR - 3}) AS rm, count(*) FILTER (WHERE month = {month}) AS mn,
  count(*) FILTER (WHERE month = {month} AND year >= {AS_OF_YEAR - 3}) AS mrn, avg(rate) FILTER (WHERE month = {month}) AS mm,
  avg(rate) FILTER (WHERE month = {month} AND year >= {AS_OF_YEAR - 3}) AS mrm, stddev_pop(rate) AS sd FROM {src} GROUP BY unit),
lev AS (SELECT *, (n_total * CASE WHEN n_recent >= 5 THEN 0.6 * rm + 0.4 * am ELSE am END + 15.0 * cm) / (n_total + 15.0) AS level FROM per_u CROSS JOIN clubm),
est AS (SELECT *, (n * raw + 12.0 * prior) / (n + 12.0) AS expected,
  sd / sqrt(n_total + 12.0) * CASE WHEN basis = 'unit-month' THEN 1.0 ELSE 1.6 END AS se FROM (
  SELECT *, CASE WHEN mn >= 5 THEN CASE WHEN mrn >= 5 THEN 0.6 * mrm + 0.4 * mm ELSE mm END ELSE level * cmm / cm END AS raw,
    CASE WHEN mn >= 5 THEN level * cmm / cm ELSE cmm END AS prior, CASE WHEN mn >= 5 THEN mn ELSE n_total END AS n,
    CASE WHEN mn >= 5 THEN 'unit-month' ELSE 'unit-year' END AS basis FROM lev WHERE n_total >= 5)),
expect AS (SELECT unit, expected, greatest(0.0, expected - se) AS lower, raw, n, n_total, n_recent, basis, se FROM est)"""


@query("expected_rate", f"{expected_sql()} SELECT unit, {cols('expected', 'lower', 'raw', 'se')}, n, n_total, n_recent, basis FROM expect")
def expected_rate(spark, sf):
    return R.expected_rate(T.observations(spark, sf), MONTH, AS_OF_YEAR)


# customers as units: thin samples, so both fallbacks are exercised
@query("expected_rate_thin", f"""
thin AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS unit, s.rate, s.year, s.month FROM scored s JOIN orders ON o_orderkey = obs_id),
{expected_sql('thin')} SELECT unit, {cols('expected', 'lower', 'raw', 'se')}, n, n_total, n_recent, basis FROM expect""")
def expected_rate_thin(spark, sf):
    orders = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("obs_id"), "o_custkey")
    thin = T.scored(spark, sf).drop("unit").join(orders, "obs_id") \
        .withColumn("unit", F.concat(F.lit("C"), F.col("o_custkey").cast("string")))
    return R.expected_rate(thin, MONTH, AS_OF_YEAR).where(F.col("expected").isNotNull())


FORECAST = f"fc AS (SELECT unit_id, temp_max_f, wind_max_mph, cloud_pct, precip_in, pressure_delta_24h FROM conditions WHERE obs_date = DATE '{DAY}')"
BANDS = """CASE WHEN wind_max_mph IS NULL THEN NULL WHEN wind_max_mph <= 7 THEN 'calm' WHEN wind_max_mph <= 15 THEN 'moderate' ELSE 'windy' END AS wind_band,
 CASE WHEN cloud_pct IS NULL THEN NULL WHEN cloud_pct <= 30 THEN 'clear_sky' WHEN cloud_pct <= 70 THEN 'partly' ELSE 'overcast' END AS cloud_band,
 CASE WHEN pressure_delta_24h >= 2 THEN 'rising' WHEN pressure_delta_24h <= -2 THEN 'falling' WHEN pressure_delta_24h IS NOT NULL THEN 'steady' END AS pressure_trend"""
TOP_LABELS = f"""
use_month AS (SELECT unit, count(*) FILTER (WHERE month = {MONTH}) >= 8 AS um FROM scored GROUP BY unit),
slice AS (SELECT s.* FROM scored s JOIN use_month USING (unit) WHERE NOT um OR month = {MONTH}),
{lift_sql('slice', 'labs', 'category', 3, ['unit'])},
tops AS (SELECT unit, string_agg(category, ',' ORDER BY rn) AS top_labels,
  string_agg(printf('%d %.3f', n_trips, shrunk_rate / baseline), ',' ORDER BY rn) AS label_figures FROM (
  SELECT unit, category, n_trips, shrunk_rate, baseline, row_number() OVER (PARTITION BY unit ORDER BY lower_rate / baseline DESC, category) AS rn FROM lifted) WHERE rn <= 3 GROUP BY unit)"""


def forecast(spark, sf):
    return T.conditions(spark, sf).where(F.col("obs_date") == F.lit(DAY).cast("date")).select(
        "unit_id", "temp_max_f", "wind_max_mph", "cloud_pct", "precip_in", "pressure_delta_24h")


RECOMMEND_COLS = ["unit", "town", "miles", "expected", "score", "n", "n_total", "basis", "confidence",
                  "condition_adj", "wind_band", "cloud_band", "pressure_trend", "top_labels", "acres", "region", "day_rate",
                  "cv", "steadiness", "bust_rate", "worst_decile", "typical_count", "label_figures"]


def recommend_sql(weighted: bool, limit: int = 15, miles: int = 400) -> str:
    adj = ("(CASE wind_band WHEN 'calm' THEN 1.06 WHEN 'windy' THEN 0.96 ELSE 1.0 END * CASE cloud_band WHEN 'clear_sky' THEN 0.96 WHEN 'overcast' THEN 1.02 ELSE 1.0 END"
           " * CASE pressure_trend WHEN 'falling' THEN 0.98 WHEN 'steady' THEN 1.02 ELSE 1.0 END)") if weighted else "1.0"
    return f"""{expected_sql()}, {FORECAST}, {TOP_LABELS}, {CONSISTENCY},
ranked AS (SELECT *, lower * adj AS score FROM (SELECT *, {adj} AS adj FROM (
  SELECT u.unit, u.town, u.acres, u.region, u.day_rate, round({HOME_MILES.format(lat='u.lat', lon='u.lon')}, 0) AS miles, e.*, {BANDS}
  FROM units u JOIN expect e ON e.unit = u.unit LEFT JOIN fc ON fc.unit_id = u.unit_id)) WHERE miles <= {miles}
  ORDER BY score DESC, unit LIMIT {limit})
SELECT r.unit, town, {r6('miles')} AS miles, {r6('expected')} AS expected, {r6('score')} AS score, n, n_total, basis,
  CASE WHEN n_total >= 80 THEN 'good' WHEN n_total >= 30 THEN 'fair' WHEN n_total >= 10 THEN 'thin' ELSE 'very thin' END AS confidence,
  {r6('adj')} AS condition_adj, wind_band, cloud_band, pressure_trend, top_labels, {cols('acres')}, region, {cols('day_rate', 'cv')}, band AS steadiness,
  {cols('bust_rate', 'worst_decile', 'typical_count')}, label_figures FROM ranked r LEFT JOIN tops ON tops.unit = r.unit LEFT JOIN cons ON cons.unit = r.unit"""


def recommended(spark, sf, weighted, limit=15):
    return R.recommend_units(T.observations(spark, sf), T.units(spark, sf), T.labels(spark, sf), MONTH, AS_OF_YEAR,
                             max_miles=400, limit=limit, forecast=forecast(spark, sf), weight_conditions=weighted).withColumn(
        "label_figures", F.array_join(F.transform("label_figures", lambda s: F.format_string("%d %.3f", s["n_trips"], s["lift"])), ","))


@query("recommend_units", recommend_sql(False))
def recommend_units(spark, sf):
    return recommended(spark, sf, False).select(*RECOMMEND_COLS)


@query("recommend_units_weighted", recommend_sql(True))
def recommend_units_weighted(spark, sf):
    return recommended(spark, sf, True).select(*RECOMMEND_COLS)


@query("weekend_panel", f"SELECT unit, town, miles, expected, score, n, n_total, basis, confidence, top_labels, acres, region, day_rate, cv, steadiness, bust_rate, worst_decile, typical_count, label_figures FROM (WITH {recommend_sql(False, 12)})")
def weekend_panel(spark, sf):
    """Ranking for the next Saturday without forecast columns."""
    out = recommended(spark, sf, False, limit=12).select(*RECOMMEND_COLS)
    return out.drop("condition_adj", "wind_band", "cloud_band", "pressure_trend")


TARGETS = [1996, 1997, 1998, 1999, 2000, 2001]
PRED_SQL = """
t AS (SELECT unnest([1996, 1997, 1998, 1999, 2000, 2001]) AS target),
pred AS (SELECT target, unit, avg(rate) FILTER (WHERE year < target) AS pm, count(*) FILTER (WHERE year < target) AS pn,
   avg(rate) FILTER (WHERE year < target AND year >= target - 2) AS rm, count(*) FILTER (WHERE year < target AND year >= target - 2) AS rn,
   avg(rate) FILTER (WHERE year = target) AS nm, count(*) FILTER (WHERE year = target) AS nn FROM scored CROSS JOIN t GROUP BY target, unit)"""
BACKTEST_SQL = f"""{PRED_SQL},
clubs AS (SELECT target, avg(rate) FILTER (WHERE year < target) AS club FROM scored CROSS JOIN t GROUP BY target),
enough AS (SELECT target FROM pred WHERE nn >= 8 GROUP BY target HAVING count(*) >= 12),
bt AS (SELECT target, count(*) AS units, covar_pop(pm, nm) / nullif(stddev_pop(pm) * stddev_pop(nm), 0) AS r,
  avg(abs(pm - nm)) AS mae_model, avg(abs(club - nm)) AS mae_club FROM pred JOIN clubs USING (target) JOIN enough USING (target)
  WHERE pn >= 8 AND nn >= 8 GROUP BY target HAVING count(*) >= 12)"""


@query("rolling_origin_backtest", f"""{BACKTEST_SQL}
SELECT CAST(target AS BIGINT) AS target, units, {cols('r', 'mae_model', 'mae_club')}, mae_model < mae_club AS win FROM bt""")
def rolling_origin_backtest(spark, sf):
    return R.rolling_origin_backtest(T.observations(spark, sf), TARGETS)


@query("rolling_origin_pooled", f"""{BACKTEST_SQL}
SELECT count(*) AS years, {r6('avg(r)')} AS mean_r, count(*) FILTER (WHERE mae_model < mae_club) AS wins,
  {r6('1 - sum(mae_model * units) / sum(mae_club * units)')} AS lift FROM bt""")
def rolling_origin_pooled(spark, sf):
    return R.pooled_lift(R.rolling_origin_backtest(T.observations(spark, sf), TARGETS))


@query("recent_vs_longrun", f"""{PRED_SQL}
SELECT CAST(target AS BIGINT) AS target, count(*) AS units, {r6('covar_pop(pm, nm) / nullif(stddev_pop(pm) * stddev_pop(nm), 0)')} AS r_long,
  {r6('covar_pop(rm, nm) / nullif(stddev_pop(rm) * stddev_pop(nm), 0)')} AS r_recent
FROM pred WHERE pn >= 8 AND rn >= 8 AND nn >= 8 GROUP BY target HAVING count(*) >= 12""")
def recent_vs_longrun(spark, sf):
    return R.recent_vs_longrun(T.observations(spark, sf), TARGETS)


TARGET = {"month": 1, "temp_max_f": 70.0, "wind_max_mph": 9.0, "cloud_pct": 50.0, "pressure_delta_24h": 1.0}
SIMILAR = """sim AS (SELECT *, least(abs(month - 1), 12 - abs(month - 1)) + coalesce(abs(temp_max_f - 70.0), 10.0) / 10.0::DOUBLE
  + coalesce(abs(wind_max_mph - 9.0), 8.0) / 8.0::DOUBLE + coalesce(abs(cloud_pct - 50.0), 40.0) / 40.0::DOUBLE
  + coalesce(abs(pressure_delta_24h - 1.0), 3.0) / 3.0::DOUBLE AS similarity
  FROM (SELECT f.*, cohort FROM frame f JOIN (SELECT unit_id, cohort FROM cohorts) USING (unit_id)) WHERE rate IS NOT NULL)"""


def cohort_frame(spark, sf):
    return T.frame(spark, sf).join(cohorts(spark, sf).select("unit_id", "cohort"), "unit_id")


@query("similar_obs", f"{COHORTS}, {SIMILAR} SELECT obs_id, unit, {r6('similarity')} AS similarity FROM sim")
def similar_obs(spark, sf):
    return R.similar_obs(cohort_frame(spark, sf), TARGET).select("obs_id", "unit", "similarity")


def similar_plan_sql(where: str) -> str:
    return f"""{COHORTS}, {SIMILAR},
scope AS (SELECT * FROM sim WHERE {where} ORDER BY similarity, obs_id LIMIT 40),
{lift_sql('scope', 'labs', 'category', 2)}
SELECT category, n_trips, {r6('raw_rate')} AS raw_rate, {r6('lower_rate / baseline')} AS lift_lb FROM lifted"""


def similar_plan(spark, sf, scope, name):
    out = R.plan_from_similar(cohort_frame(spark, sf), T.labels(spark, sf), TARGET, scope, name)
    return out.select("category", "n_trips", "raw_rate", "lift_lb")


@query("plan_from_similar", similar_plan_sql("lower(unit) = 'nation_7'"))
def plan_from_similar(spark, sf):
    return similar_plan(spark, sf, "unit", "NATION_7")


@query("plan_from_similar_cohort", similar_plan_sql("cohort = 'larger_grassy'"))
def plan_from_similar_cohort(spark, sf):
    return similar_plan(spark, sf, "cohort", "larger_grassy")


PER_UNIT = f"""per AS (SELECT *, {HOME_MILES.format(lat='lat', lon='lon')} AS miles FROM (
  SELECT unit, lat, lon, acres, avg(rate) AS rate, count(*) AS n FROM scored JOIN units USING (unit_id, unit) GROUP BY ALL HAVING count(*) >= 20))"""


def per_unit(spark, sf):
    placed = T.units(spark, sf).select("unit_id", "lat", "lon", "acres")
    return R.unit_means(T.scored(spark, sf).join(placed, "unit_id"))


@query("drive_gradient", f"""{PER_UNIT}, near AS (SELECT * FROM per WHERE miles <= 300), far AS (SELECT * FROM per WHERE miles > 300),
sized AS (SELECT * FROM per WHERE acres > 0),
v AS (SELECT count(*) AS sized_units, var_pop(miles) AS vm, var_pop(acres) AS va, var_pop(rate) AS vr, covar_pop(miles, acres) AS cma,
  covar_pop(miles, rate) AS cmr, covar_pop(acres, rate) AS car FROM sized)
SELECT (SELECT count(*) FROM near) AS near_units, (SELECT count(*) FROM far) AS far_units, {r6('(SELECT avg(rate) FROM near)')} AS near_rate,
  {r6('(SELECT avg(rate) FROM far)')} AS far_rate, {r6('(SELECT median(acres) FROM near)')} AS near_acres, {r6('(SELECT median(acres) FROM far)')} AS far_acres,
  {r6('(SELECT median(n) FROM near)')} AS near_trips, {r6('(SELECT median(n) FROM far)')} AS far_trips,
  {r6('(SELECT avg(rate) FROM far) - (SELECT avg(rate) FROM near)')} AS raw_gap,
  {r6('CASE WHEN sized_units >= 20 THEN 100 * (cmr * va - car * cma) / (vm * va - cma * cma) END')} AS per_100_miles,
  {r6('CASE WHEN sized_units >= 20 THEN (car * vm - cmr * cma) / (vm * va - cma * cma) END')} AS per_acre, sized_units,
  {r6('(SELECT corr(miles, rate) FROM per)')} AS corr_miles_rate, {r6('(SELECT corr(n, rate) FROM per)')} AS corr_trips_rate,
  {r6('(SELECT corr(miles, n) FROM per)')} AS corr_miles_trips, {r6('car / sqrt(va * vr)')} AS corr_acres_rate, {r6('cma / sqrt(vm * va)')} AS corr_miles_acres FROM v""")
def drive_gradient(spark, sf):
    """The bound units lie farther out, so the split is 300 miles here."""
    return R.drive_gradient(per_unit(spark, sf), split=300.0)


@query("split_scan", f"""{PER_UNIT}, c AS (SELECT unnest([40, 60, 80, 100, 120]) AS cut),
s AS (SELECT cut, count(*) FILTER (WHERE m <= cut) AS near_units, count(*) FILTER (WHERE m > cut) AS far_units,
  avg(rate) FILTER (WHERE m <= cut) AS nr, avg(rate) FILTER (WHERE m > cut) AS fr FROM (SELECT miles / 4.0::DOUBLE AS m, rate FROM per) CROSS JOIN c GROUP BY cut)
SELECT CAST(cut AS BIGINT) AS cut, near_units, far_units, {r6('nr')} AS near_rate, {r6('fr')} AS far_rate, {r6('fr - nr')} AS gap FROM s WHERE near_units >= 5 AND far_units >= 5""")
def split_scan(spark, sf):
    """Distances are quartered, because the bound units lie farther out."""
    return R.split_scan(per_unit(spark, sf).withColumn("miles", F.col("miles") / 4.0))


@query("evidence_rows", """
r AS (SELECT unit, category, obs_id, CAST(obs_date AS VARCHAR) AS obs_date, count_total, row_number() OVER (PARTITION BY unit, category ORDER BY s.obs_date DESC, obs_id DESC) AS rank
  FROM scored s JOIN (SELECT DISTINCT obs_id, category FROM labs) USING (obs_id))
SELECT * FROM r WHERE rank <= 10""")
def evidence_rows(spark, sf):
    return R.evidence_rows(T.observations(spark, sf), T.labels(spark, sf), ["unit"])


@query("label_share", f"""
u AS (SELECT unit, category, count(*) AS trips FROM scored JOIN (SELECT DISTINCT obs_id, category FROM labs) USING (obs_id) GROUP BY unit, category HAVING count(*) >= 3),
n AS (SELECT unit, count(*) AS total FROM scored GROUP BY unit)
SELECT unit, category, trips, {r6('100.0 * trips / total')} AS share FROM u JOIN n USING (unit)
QUALIFY row_number() OVER (PARTITION BY unit ORDER BY trips DESC, category) <= 6""")
def label_share(spark, sf):
    return R.label_share(T.observations(spark, sf), T.labels(spark, sf))


@query("band_of", f"SELECT unit_id, CAST(obs_date AS VARCHAR) AS obs_date, {BANDS} FROM conditions")
def band_of_query(spark, sf):
    return R.describe_forecast(T.conditions(spark, sf).drop("pressure_trend")).select(
        "unit_id", "obs_date", "wind_band", "cloud_band", "pressure_trend")


@query("cut_bands", "SELECT obs_id, cloud_band, wind_band, clarity_band, acres_band FROM frame")
def cut_bands(spark, sf):
    return T.frame(spark, sf).select("obs_id", "cloud_band", "wind_band", "clarity_band", "acres_band")


@query("condition_note", """
c AS (SELECT unit_id, CAST(obs_date AS VARCHAR) AS obs_date,
 CASE WHEN temp_max_f >= 95 THEN CAST(CAST(round_even(temp_max_f, 0) AS BIGINT) AS VARCHAR) || '°F maximum: hot; start at dawn, then look for shade and depth'
      WHEN temp_max_f <= 50 THEN CAST(CAST(round_even(temp_max_f, 0) AS BIGINT) AS VARCHAR) || '°F maximum: cold; plan for midday and slow presentations' END AS a,
 CASE WHEN wind_max_mph >= 18 THEN CAST(CAST(round_even(wind_max_mph, 0) AS BIGINT) AS VARCHAR) || ' mph wind: choose sheltered banks'
      WHEN wind_max_mph <= 6 THEN 'hardly any wind: keep a distance in clear water' END AS b,
 CASE WHEN precip_in >= 0.25 THEN printf('%.2f', precip_in) || ' in of rain expected' END AS c, cloud_pct FROM conditions),
t AS (SELECT unit_id, obs_date, coalesce(nullif(concat_ws('; ', a, b, c), ''), CASE WHEN cloud_pct <= 15 THEN 'clear sky' END) AS s FROM c)
SELECT unit_id, obs_date, upper(s[1]) || s[2:] || '.' AS note FROM t""")
def condition_note(spark, sf):
    return R.condition_note(T.conditions(spark, sf)).select("unit_id", "obs_date", "note")
