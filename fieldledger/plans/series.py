"""Daily series, astronomy, intervals and calendar helpers on the bound tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import astro, dates, geo
from ..operators import series as S
from ..sources.tables import spread
from . import testbed as T
from .registry import query, r6
from .units import cols


@query("lag_delta", f"""
SELECT unit_id, CAST(obs_date AS VARCHAR) AS obs_date, {cols('pressure_delta_24h', 'pressure_delta_48h')} FROM conditions""")
def lag_delta(spark, sf):
    out = S.lag_delta(T.series(spark, sf), ["unit_id"], "obs_date", "pressure_hpa", 1, "pressure_delta_24h")
    out = S.lag_delta(out, ["unit_id"], "obs_date", "pressure_hpa", 2, "pressure_delta_48h")
    return out.select("unit_id", "obs_date", "pressure_delta_24h", "pressure_delta_48h")


# events: nullable series of five types
@query("lag_delta_events", f"""
d AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) FILTER (WHERE value > 3) AS v FROM events GROUP BY 1, 2)
SELECT event_type, CAST(day AS VARCHAR) AS day, {r6('v - lag(v, 1) OVER w')} AS d1, {r6('v - lag(v, 2) OVER w')} AS d2,
  {r6('avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS mean7 FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)""")
def lag_delta_events(spark, sf):
    daily = T.table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.sum(F.when(F.col("value") > 3, F.col("value"))).alias("v"))
    out = S.lag_delta(daily, ["event_type"], "day", "v", 1, "d1")
    out = S.lag_delta(out, ["event_type"], "day", "v", 2, "d2")
    return S.trailing_mean(out, ["event_type"], "day", "v", "mean7").drop("v")


@query("trailing_mean_7", f"SELECT unit_id, CAST(obs_date AS VARCHAR) AS obs_date, {cols('temp_7d_mean_f')} FROM conditions")
def trailing_mean_7(spark, sf):
    return S.trailing_mean(T.series(spark, sf), ["unit_id"], "obs_date", "temp_mean_f", "temp_7d_mean_f").select(
        "unit_id", "obs_date", "temp_7d_mean_f")


@query("trend_class", "SELECT unit_id, CAST(obs_date AS VARCHAR) AS obs_date, pressure_trend FROM conditions")
def trend_class(spark, sf):
    return T.conditions(spark, sf).select("unit_id", "obs_date", "pressure_trend")


@query("conditions_equi_join", f"""
SELECT obs_id, {cols('temp_max_f', 'wind_max_mph', 'pressure_hpa')} FROM frame""")
def conditions_equi_join(spark, sf):
    return T.frame(spark, sf).select("obs_id", "temp_max_f", "wind_max_mph", "pressure_hpa")


MOON = """moons AS (SELECT unit_id, obs_date, (days - floor(days / 29.53058867::DOUBLE) * 29.53058867::DOUBLE) / 29.53058867::DOUBLE AS p FROM (
  SELECT unit_id, obs_date, date_diff('day', DATE '2000-01-06', obs_date) - (6.0::DOUBLE + 14.0::DOUBLE / 60) / 24 AS days FROM series)),
named AS (SELECT unit_id, obs_date, round(p, 4) AS phase, round((1 - cos(2 * pi() * p)) / 2, 4) AS illum FROM moons)"""


@query("moon_phase", f"""{MOON} SELECT unit_id, CAST(obs_date AS VARCHAR) AS obs_date, {cols('phase', 'illum')},
  CASE WHEN phase < 0.033 THEN 'new' WHEN phase < 0.217 THEN 'waxing_crescent' WHEN phase < 0.283 THEN 'first_quarter' WHEN phase < 0.467 THEN 'waxing_gibbous'
       WHEN phase < 0.533 THEN 'full' WHEN phase < 0.717 THEN 'waning_gibbous' WHEN phase < 0.783 THEN 'last_quarter' WHEN phase < 0.967 THEN 'waning_crescent' ELSE 'new' END AS name FROM named""")
def moon_phase(spark, sf):
    day = F.col("obs_date")
    out = T.series(spark, sf).select("unit_id", "obs_date", astro.moon_phase(day).alias("phase"),
                                     astro.moon_illumination(day).alias("illum"))
    return out.withColumn("name", astro.moon_name(F.col("phase")))


DST = ("((month({d}) BETWEEN 4 AND 10) OR (month({d}) = 3 AND day({d}) - dayofweek({d}) >= 8)"
       " OR (month({d}) = 11 AND day({d}) - dayofweek({d}) < 1))")


@query("us_dst", f"SELECT obs_id, {DST.format(d='obs_date')} AS dst FROM raw_obs")
def us_dst(spark, sf):
    return T.raw_observations(spark, sf).select("obs_id", dates.us_dst(F.col("obs_date")).alias("dst"))


SUN = f"""sun1 AS (SELECT s.*, lat, lon, CASE WHEN {DST.format(d='s.obs_date')} THEN -5.0::DOUBLE ELSE -6.0::DOUBLE END AS tz,
  date_diff('day', DATE '2000-01-01', s.obs_date) + 0.0008::DOUBLE - lon / 360.0::DOUBLE AS n FROM conditions s JOIN units USING (unit_id)),
sun2 AS (SELECT *, (357.5291::DOUBLE + 0.98560028::DOUBLE * n) - floor((357.5291::DOUBLE + 0.98560028::DOUBLE * n) / 360) * 360 AS m FROM sun1),
sun3 AS (SELECT *, m + (1.9148::DOUBLE * sin(radians(m)) + 0.02::DOUBLE * sin(radians(2 * m)) + 0.0003::DOUBLE * sin(radians(3 * m))) + 180 + 102.9372::DOUBLE AS l FROM sun2),
sun4 AS (SELECT *, radians(l - floor(l / 360) * 360) AS lam FROM sun3),
sun5 AS (SELECT *, n + 0.0053::DOUBLE * sin(radians(m)) - 0.0069::DOUBLE * sin(2 * lam) AS tr, asin(sin(lam) * sin(radians(23.44::DOUBLE))) AS decl FROM sun4),
sun6 AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, (sin(radians(-0.833::DOUBLE)) - sin(radians(lat)) * sin(decl)) / (cos(radians(lat)) * cos(decl)))))) AS w FROM sun5),
sun7 AS (SELECT *, (tr - w / 360 + 0.5) - floor(tr - w / 360 + 0.5) AS fr, (tr + w / 360 + 0.5) - floor(tr + w / 360 + 0.5) AS fs FROM sun6),
sun8 AS (SELECT *, (fr * 24 + tz) - floor((fr * 24 + tz) / 24) * 24 AS hr, (fs * 24 + tz) - floor((fs * 24 + tz) / 24) * 24 AS hs FROM sun7),
sun AS (SELECT *, lpad(CAST(CAST(floor(hr) AS INT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor((hr - floor(hr)) * 60) AS INT) AS VARCHAR), 2, '0') AS sunrise,
  lpad(CAST(CAST(floor(hs) AS INT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor((hs - floor(hs)) * 60) AS INT) AS VARCHAR), 2, '0') AS sunset,
  round(2 * w / 360 * 24, 2) AS day_length_h FROM sun8)"""


@query("sun_times", f"{SUN} SELECT unit_id, CAST(obs_date AS VARCHAR) AS obs_date, sunrise, sunset, {cols('day_length_h')} FROM sun")
def sun_times(spark, sf):
    placed = T.series(spark, sf).select("unit_id", "obs_date").join(
        T.units(spark, sf).select("unit_id", "lat", "lon"), "unit_id")
    sun = astro.sun_columns(F.col("obs_date"), F.col("lat"), F.col("lon"))
    return placed.select("unit_id", "obs_date", *[c.alias(n) for n, c in sun.items()])


COND_NUM = ["temp_max_f", "temp_min_f", "temp_mean_f", "temp_7d_mean_f", "precip_in", "wind_max_mph", "wind_dir_deg",
            "cloud_pct", "pressure_hpa", "pressure_delta_24h", "pressure_delta_48h", "moon_phase", "moon_illum", "day_length_h"]


@query("conditions_rows", f"""{SUN}, {MOON}
SELECT unit_id, CAST(obs_date AS VARCHAR) AS obs_date, {cols(*COND_NUM)}, pressure_trend, sunrise, sunset
FROM (SELECT sun.*, phase AS moon_phase, illum AS moon_illum FROM sun JOIN named USING (unit_id, obs_date))""")
def conditions_rows(spark, sf):
    return S.conditions_rows(T.series(spark, sf), T.units(spark, sf))


@query("next_saturday", """
SELECT obs_id, CAST(obs_date + CAST(CASE WHEN dayofweek(obs_date) = 6 THEN 7 ELSE 6 - dayofweek(obs_date) END AS INT) AS VARCHAR) AS saturday,
  CAST(obs_date + CAST(CASE WHEN dayofweek(obs_date) = 6 THEN 7 ELSE 6 - dayofweek(obs_date) END AS INT) + 1 AS VARCHAR) AS sunday FROM raw_obs""")
def next_saturday(spark, sf):
    sat = dates.next_saturday(F.col("obs_date"))
    return T.raw_observations(spark, sf).select("obs_id", sat.alias("saturday"), F.date_add(sat, 1).alias("sunday"))


@query("calendar_parts", "SELECT obs_id, CAST(obs_date AS VARCHAR) AS obs_date, year, month, season FROM raw_obs")
def calendar_parts(spark, sf):
    return T.raw_observations(spark, sf).select("obs_id", "obs_date", "year", "month", "season")


# Suppliers as grid members: position from the key.
PLACED = """placed AS (SELECT s_suppkey AS unit_id, CAST(s_nationkey AS BIGINT) AS nation, 25.8::DOUBLE + ((s_suppkey * 37) % 113) / 10.0::DOUBLE AS lat,
  -103.1::DOUBLE + ((s_suppkey * 53) % 96) / 10.0::DOUBLE AS lon FROM supplier),
snapped AS (SELECT *, round_even(lat / 0.25, 0) * 0.25 AS cell_lat, round_even(lon / 0.25, 0) * 0.25 AS cell_lon FROM placed)"""


def placed(spark, sf):
    k = F.col("s_suppkey")
    return T.table(spark, sf, "supplier").select(
        k.alias("unit_id"), F.col("s_nationkey").cast("long").alias("nation"),
        (25.8 + ((k * 37) % 113) / 10.0).alias("lat"), (-103.1 + ((k * 53) % 96) / 10.0).alias("lon"))


@query("grid_snap", f"{PLACED} SELECT unit_id, {cols('cell_lat', 'cell_lon')} FROM snapped")
def grid_snap(spark, sf):
    return placed(spark, sf).select("unit_id", geo.grid_snap(F.col("lat")).alias("cell_lat"),
                                    geo.grid_snap(F.col("lon")).alias("cell_lon"))


@query("cell_fanout_join", f"""{PLACED},
cellseries AS (SELECT cell_lat, cell_lon, day, sum(q) AS q FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
  JOIN snapped ON unit_id = l_suppkey GROUP BY 1, 2, 3)
SELECT unit_id, {cols('cell_lat', 'cell_lon')}, CAST(day AS VARCHAR) AS day, {r6('q')} AS q FROM snapped JOIN cellseries USING (cell_lat, cell_lon)""")
def cell_fanout_join(spark, sf):
    lines = T.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("unit_id"), F.to_date("l_shipdate").alias("day")) \
        .agg(F.sum("l_quantity").alias("q"))
    per_cell = lines.join(placed(spark, sf), "unit_id").groupBy(
        geo.grid_snap(F.col("lat")).alias("cell_lat"), geo.grid_snap(F.col("lon")).alias("cell_lon"), "day").agg(F.sum("q").alias("q"))
    return S.cell_fanout_join(per_cell, placed(spark, sf)).select("unit_id", "cell_lat", "cell_lon", "day", "q")


@query("coverage_gap_plan", f"""{PLACED},
m AS (SELECT cell_lat || '/' || cell_lon AS cell, unit_id, min(CAST(l_shipdate AS DATE)) AS first, max(CAST(l_shipdate AS DATE)) AS last
  FROM snapped JOIN lineitem ON l_suppkey = unit_id GROUP BY 1, 2),
have AS (SELECT unit_id, first - 3 AS lo, CASE WHEN unit_id % 2 = 0 THEN last ELSE last - 30 END AS hi FROM m WHERE unit_id % 5 <> 0),
sp AS (SELECT cell, min(first) - 3 AS s, least(max(last), DATE '2001-10-31') AS e, count(*) AS members FROM m GROUP BY cell),
st AS (SELECT cell, bool_and(coalesce(lo <= s AND hi >= e, FALSE)) AS covered FROM m LEFT JOIN have USING (unit_id) JOIN sp USING (cell) GROUP BY cell)
SELECT cell, CAST(CAST(s AS DATE) AS VARCHAR) AS start, CAST(CAST(e AS DATE) AS VARCHAR) AS "end", members FROM sp JOIN st USING (cell) WHERE NOT covered AND e >= s""")
def coverage_gap_plan(spark, sf):
    lines = T.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("unit_id")).agg(
        F.min(F.to_date("l_shipdate")).alias("first"), F.max(F.to_date("l_shipdate")).alias("last"))
    members = placed(spark, sf).join(lines, "unit_id").select(
        F.concat(geo.grid_snap(F.col("lat")).cast("string"), F.lit("/"), geo.grid_snap(F.col("lon")).cast("string")).alias("cell"),
        "unit_id", "first", "last")
    stored = members.where(F.col("unit_id") % 5 != 0).select(
        "unit_id", F.date_sub("first", 3).alias("lo"),
        F.when(F.col("unit_id") % 2 == 0, F.col("last")).otherwise(F.date_sub("last", 30)).alias("hi"))
    return S.coverage_gap_plan(members, stored, "2001-11-01")


# Interval values built from events: one interval per event, its length from the payload.
INTERVALS = """iv AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS cell, event_id AS seq,
  CASE event_type WHEN 'click' THEN 'maxTemperature' WHEN 'view' THEN 'minTemperature' WHEN 'purchase' THEN 'skyCover' WHEN 'signup' THEN 'windSpeed'
       ELSE CASE WHEN event_id % 2 = 0 THEN 'windDirection' ELSE 'quantitativePrecipitation' END END AS field,
  CAST(ts AS DATE) AS start_day, hour(ts) AS start_hour, value,
  1 + CAST(regexp_extract(props, '(\\d+)', 1) AS INT) % 30 AS hours FROM events),
hourly AS (SELECT cell, seq, field, value, hours, start_day, start_hour, h, start_day + CAST(floor((start_hour + h) / 24) AS INT) AS day
  FROM iv, generate_series(0, hours - 1) g(h)),
wd AS (SELECT cell, day, list(value ORDER BY start_day, start_hour, seq, h) AS l FROM hourly WHERE field = 'windDirection' GROUP BY cell, day),
days AS (SELECT cell, day, max(value) FILTER (WHERE field='maxTemperature') * 9 / 5 + 32 AS temp_max_f, min(value) FILTER (WHERE field='minTemperature') * 9 / 5 + 32 AS temp_min_f,
  avg(value) FILTER (WHERE field='skyCover') AS cloud_pct, max(value) FILTER (WHERE field='windSpeed') * 0.621371::DOUBLE AS wind_max_mph,
  sum({amount}) FILTER (WHERE field='quantitativePrecipitation') / 25.4::DOUBLE AS precip_in FROM hourly GROUP BY cell, day)
SELECT cell, CAST(CAST(day AS DATE) AS VARCHAR) AS day, {columns} FROM (SELECT d.*, (temp_max_f + temp_min_f) / 2 AS temp_mean_f, l[len(l) // 2 + 1] AS wind_dir_deg
  FROM days d LEFT JOIN wd USING (cell, day) WHERE temp_max_f IS NOT NULL OR temp_min_f IS NOT NULL)"""
_IV = cols("temp_max_f", "temp_min_f", "precip_in", "wind_max_mph", "wind_dir_deg", "cloud_pct", "temp_mean_f")


def intervals(spark, sf):
    kind = F.col("event_type")
    hours = 1 + F.get_json_object("props", "$.k").cast("int") % 30
    odd = F.when(F.col("event_id") % 2 == 0, "windDirection").otherwise("quantitativePrecipitation")
    duration = F.concat(F.lit("P"), F.when(hours >= 24, F.concat(F.floor(hours / 24).cast("string"), F.lit("D"))).otherwise(""),
                        F.lit("T"), F.when(hours % 24 > 0, F.concat((hours % 24).cast("string"), F.lit("H"))).otherwise(""))
    return T.table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("cell"), F.col("event_id").alias("seq"),
        F.when(kind == "click", "maxTemperature").when(kind == "view", "minTemperature").when(kind == "purchase", "skyCover")
         .when(kind == "signup", "windSpeed").otherwise(odd).alias("field"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:00:00+00:00"), F.lit("/"), duration).alias("valid_time"), "value")


@query("interval_expand_daily", INTERVALS.format(amount="value", columns=_IV))
def interval_expand_daily(spark, sf):
    return S.interval_daily_columns(S.interval_expand_daily(intervals(spark, sf)))


@query("interval_expand_daily_spread", INTERVALS.format(amount="value / hours", columns=_IV))
def interval_expand_daily_spread(spark, sf):
    return S.interval_daily_columns(S.interval_expand_daily(intervals(spark, sf), spread=True))


@query("json_series_unpivot", f"""
d AS (SELECT event_type AS cell, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS s FROM events GROUP BY 1, 2)
SELECT cell, CAST(day AS VARCHAR) AS day, {r6('s')} AS pressure_msl_mean, {r6('n')} AS cloud_cover_mean, CAST(NULL AS DOUBLE) AS wind_speed_10m_max FROM d""")
def json_series_unpivot(spark, sf):
    """Blocks are assembled per event type from daily totals, then taken apart again."""
    daily = T.table(spark, sf, "events").groupBy(F.col("event_type").alias("cell"), F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.sum("value").alias("s"))
    rows = F.array_sort(F.collect_list(F.struct("day", "s", "n")))
    blocks = daily.groupBy("cell").agg(rows.alias("r")).select("cell", F.to_json(F.struct(F.struct(
        F.transform("r", lambda x: F.date_format(x["day"], "yyyy-MM-dd")).alias("time"),
        F.transform("r", lambda x: x["s"]).alias("pressure_msl_mean"),
        F.transform("r", lambda x: x["n"]).alias("cloud_cover_mean")).alias("daily"))).alias("block"))
    return S.json_series_unpivot(blocks, ["pressure_msl_mean", "cloud_cover_mean", "wind_speed_10m_max"])


@query("stale_fallback_join", f"""
cells AS (SELECT DISTINCT user_id AS cell FROM events),
pick AS (SELECT user_id AS cell, event_type, arg_max(value, event_id) AS v, max(ts) AS ts FROM events GROUP BY 1, 2),
l AS (SELECT cell, v FROM pick WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-29'), c AS (SELECT cell, v FROM pick WHERE event_type = 'view' AND date_diff('minute', ts, TIMESTAMP '2024-01-31') / 60.0 <= 48),
s AS (SELECT cell, v FROM pick WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-29')
SELECT cell, CASE WHEN l.v IS NOT NULL THEN 'live' WHEN c.v IS NOT NULL THEN 'cached' WHEN s.v IS NOT NULL THEN 'second' END AS source, {r6('coalesce(l.v, c.v, s.v)')} AS value
FROM cells LEFT JOIN l USING (cell) LEFT JOIN c USING (cell) LEFT JOIN s USING (cell)""")
def stale_fallback_join(spark, sf):
    events = T.table(spark, sf, "events").withColumn("cell", F.col("user_id"))
    latest = events.groupBy("cell", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("ts").alias("ts"))
    kind = lambda k: latest.where(F.col("event_type") == k)
    recent = F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz")
    age = F.floor((F.unix_timestamp(F.lit("2024-01-31").cast("timestamp")) - F.unix_timestamp(F.date_trunc("minute", F.col("ts").cast("timestamp")))) / 60) / 60.0
    return S.stale_fallback_join(
        events.select("cell").dropDuplicates(), kind("click").where(recent).select("cell", "value"),
        kind("view").select("cell", "value", age.alias("age_hours")),
        kind("purchase").where(recent).select("cell", "value"), max_age_hours=48)


# --- geometry -------------------------------------------------------------------
GEO_PTS = """pts AS (SELECT c_custkey, 25.8::DOUBLE + ((c_custkey * 37) % 113) / 10.0::DOUBLE AS lat, -103.1::DOUBLE + ((c_custkey * 53) % 96) / 10.0::DOUBLE AS lon FROM customer)"""
BEARING = ("degrees(atan2(sin(radians(lon + 96.797::DOUBLE)) * cos(radians(lat)), cos(radians(32.7767::DOUBLE)) * sin(radians(lat))"
           " - sin(radians(32.7767::DOUBLE)) * cos(radians(lat)) * cos(radians(lon + 96.797::DOUBLE))))")


def points(spark, sf):
    k = F.col("c_custkey")
    return spread(T.table(spark, sf, "customer")).select(
        k, (25.8 + ((k * 37) % 113) / 10.0).alias("lat"), (-103.1 + ((k * 53) % 96) / 10.0).alias("lon"))


@query("haversine_miles", f"""{GEO_PTS} SELECT c_custkey, {r6("2 * 3958.8::DOUBLE * asin(sqrt(pow(sin(radians(lat - 32.7767::DOUBLE) / 2), 2) + cos(radians(32.7767::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lon + 96.797::DOUBLE) / 2), 2)))")} AS miles FROM pts""")
def haversine_miles(spark, sf):
    return points(spark, sf).select("c_custkey", geo.miles_from_home(F.col("lat"), F.col("lon")).alias("miles"))


@query("bearing_deg", f"{GEO_PTS} SELECT c_custkey, {r6(f'CASE WHEN {BEARING} < 0 THEN {BEARING} + 360 ELSE {BEARING} END')} AS bearing FROM pts")
def bearing_deg(spark, sf):
    return points(spark, sf).select("c_custkey", geo.bearing_deg(geo.HOME_LAT, geo.HOME_LON, F.col("lat"), F.col("lon")).alias("bearing"))


@query("angle_gap", f"""{GEO_PTS}, b AS (SELECT c_custkey, CASE WHEN {BEARING} < 0 THEN {BEARING} + 360 ELSE {BEARING} END AS b FROM pts)
SELECT c_custkey, {r6('least(abs(b - 315), 360 - abs(b - 315))')} AS gap FROM b""")
def angle_gap(spark, sf):
    b = geo.bearing_deg(geo.HOME_LAT, geo.HOME_LON, F.col("lat"), F.col("lon"))
    return points(spark, sf).select("c_custkey", geo.angle_gap(b, F.lit(315.0)).alias("gap"))


@query("compass16", f"""{GEO_PTS}, b AS (SELECT c_custkey, CASE WHEN {BEARING} < 0 THEN {BEARING} + 360 ELSE {BEARING} END AS b FROM pts)
SELECT c_custkey, ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][CAST(floor((CASE WHEN b + 11.25 >= 360 THEN b + 11.25 - 360 ELSE b + 11.25 END) / 22.5) AS INT) + 1] AS dir FROM b""")
def compass16(spark, sf):
    b = geo.bearing_deg(geo.HOME_LAT, geo.HOME_LON, F.col("lat"), F.col("lon"))
    return points(spark, sf).select("c_custkey", geo.compass16(b).alias("dir"))


@query("unit_conversions", f"""
SELECT event_id, {r6('value / 12.0::DOUBLE')} AS feet, {r6('value * 9 / 5 + 32')} AS fahrenheit, {r6('value * 0.621371::DOUBLE')} AS mph, {r6('value / 25.4::DOUBLE')} AS inches, {r6('value / 60.0::DOUBLE * 55.0')} AS miles FROM events""")
def unit_conversions(spark, sf):
    v = F.col("value")
    return T.table(spark, sf, "events").select(
        "event_id", (v / 12.0).alias("feet"), (v * 9 / 5 + 32).alias("fahrenheit"), (v * 0.621371).alias("mph"),
        (v / 25.4).alias("inches"), (v / 60.0 * 55.0).alias("miles"))
