"""SQL form of the bound tables; the DataFrame form is in ``testbed``."""

SEASON_SQL = ("CASE WHEN {m} IN (12,1,2) THEN 'winter' WHEN {m} IN (3,4,5) THEN 'spring'"
              " WHEN {m} IN (6,7,8) THEN 'summer' WHEN {m} IN (9,10,11) THEN 'fall' END")

BASE_CTES = f"""
line_facts AS (
  SELECT l_orderkey, sum(l_quantity) AS qty, max(l_extendedprice) AS price,
         max(l_tax) AS tax, max(l_linenumber) AS line_no
  FROM lineitem GROUP BY l_orderkey),
raw_obs AS (
  SELECT o_orderkey AS obs_id, CAST(n_nationkey AS BIGINT) AS unit_id, n_name AS unit,
         CAST(o_orderdate AS DATE) AS obs_date,
         CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month,
         {SEASON_SQL.format(m='month(o_orderdate)')} AS season,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'AM' WHEN '2-HIGH' THEN 'PM'
              WHEN '3-MEDIUM' THEN 'ALL_DAY' END AS slot,
         CASE WHEN o_orderstatus = 'P' THEN 'posted_estimate' ELSE 'reservation' END AS date_source,
         qty AS count_total, price / 10000.0::DOUBLE AS max_weight,
         CASE WHEN tax > 0 THEN tax * 50.0::DOUBLE END AS clarity_ft,
         CASE WHEN line_no >= 4 THEN 40.0::DOUBLE + (qty % 50) END AS water_temp_f,
         line_no * 3.0::DOUBLE AS depth_max_ft
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN line_facts ON o_orderkey = l_orderkey),
effort_sides AS (
  SELECT count(*) FILTER (WHERE slot IN ('AM','PM')) AS n_half,
         count(*) FILTER (WHERE slot = 'ALL_DAY') AS n_all_day,
         avg(count_total) FILTER (WHERE slot IN ('AM','PM')) AS half_mean,
         avg(count_total) FILTER (WHERE slot = 'ALL_DAY') AS all_day_mean
  FROM raw_obs WHERE count_total IS NOT NULL AND slot IS NOT NULL),
calibration AS (
  SELECT *, CASE WHEN measured THEN all_day_mean / half_mean END AS ratio,
         CASE WHEN measured THEN round(4.0::DOUBLE * (all_day_mean / half_mean), 2)
              ELSE 8.0::DOUBLE END AS all_day_hours,
         CASE WHEN measured THEN 'measured' ELSE 'fallback' END AS source
  FROM (SELECT *, coalesce(n_half >= 100 AND n_all_day >= 100 AND half_mean > 0
                  AND all_day_mean / half_mean BETWEEN 1.0 AND 2.0, FALSE) AS measured
        FROM effort_sides)),
obs AS (
  SELECT r.*, CASE WHEN slot IN ('AM','PM') THEN 4.0::DOUBLE WHEN slot = 'ALL_DAY' THEN all_day_hours END AS hours,
         count_total / CASE WHEN slot IN ('AM','PM') THEN 4.0::DOUBLE WHEN slot = 'ALL_DAY' THEN all_day_hours END AS rate
  FROM raw_obs r CROSS JOIN calibration),
scored AS (SELECT * FROM obs WHERE rate IS NOT NULL),
units AS (
  SELECT CAST(n_nationkey AS BIGINT) AS unit_id, n_name AS unit, r_name AS region,
         'Town_' || CAST(n_nationkey % 9 AS VARCHAR) AS town,
         CASE WHEN n_nationkey % 12 <> 11 THEN CAST(5 + (n_nationkey * 7) % 50 AS DOUBLE) END AS acres,
         CAST(60 + (n_nationkey * 13) % 90 AS DOUBLE) AS day_rate,
         CAST(8 + n_nationkey % 20 AS DOUBLE) AS max_depth_ft,
         25.8::DOUBLE + ((n_nationkey * 37) % 113) / 10.0::DOUBLE AS lat,
         -103.1::DOUBLE + ((n_nationkey * 53) % 96) / 10.0::DOUBLE AS lon,
         (n_nationkey % 5 = 3) AS geo_uncertain
  FROM nation JOIN region ON n_regionkey = r_regionkey),
labs AS (
  SELECT l_orderkey AS obs_id, p_brand AS category,
         CASE WHEN p_type = 'STANDARD' THEN 'unspecified' ELSE p_type END AS subtype,
         l_returnflag AS color,
         CASE WHEN l_linestatus = 'O' THEN 'field' ELSE 'narrative' END AS source
  FROM lineitem JOIN part ON l_partkey = p_partkey),
tags AS (
  SELECT l_orderkey AS obs_id,
         CASE l_returnflag WHEN 'A' THEN 'vegetation' WHEN 'N' THEN 'structure' ELSE 'technique' END AS kind,
         'v' || CAST(l_suppkey % 7 AS VARCHAR) AS value,
         CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN
              CASE WHEN l_linenumber <= 2 THEN 'heavy' WHEN l_linenumber <= 4 THEN 'moderate' ELSE 'light' END
         END AS detail
  FROM lineitem),
catches AS (
  SELECT l_orderkey AS obs_id,
         CASE WHEN p_size <= 10 THEN 'unspecified' WHEN p_size <= 30 THEN 'largemouth'
              WHEN p_size <= 40 THEN 'crappie' ELSE 'catfish' END AS species,
         CAST(l_quantity AS BIGINT) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey),
series AS (
  SELECT CAST(s_nationkey AS BIGINT) AS unit_id, CAST(l_shipdate AS DATE) AS obs_date,
         40.0::DOUBLE + q % 60 AS temp_max_f, 30.0::DOUBLE + q % 60 AS temp_mean_f,
         20.0::DOUBLE + q % 60 AS temp_min_f,
         (q % 5) / 10.0::DOUBLE AS precip_in, 3.0::DOUBLE + q % 17 AS wind_max_mph,
         (q * 11) % 360 AS wind_dir_deg, (q * 7) % 101 AS cloud_pct,
         1000.0::DOUBLE + ((q * 3) % 40) / 2.0::DOUBLE AS pressure_hpa
  FROM (SELECT s_nationkey, l_shipdate, sum(l_quantity) AS q
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, l_shipdate)),
conditions AS (
  SELECT *, CASE WHEN pressure_delta_24h >= 2 THEN 'rising' WHEN pressure_delta_24h <= -2 THEN 'falling'
                 WHEN pressure_delta_24h IS NOT NULL THEN 'steady' END AS pressure_trend
  FROM (SELECT *, pressure_hpa - lag(pressure_hpa, 1) OVER w AS pressure_delta_24h,
               pressure_hpa - lag(pressure_hpa, 2) OVER w AS pressure_delta_48h,
               avg(temp_mean_f) OVER (PARTITION BY unit_id ORDER BY obs_date
                                      ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS temp_7d_mean_f
        FROM series WINDOW w AS (PARTITION BY unit_id ORDER BY obs_date))),
frame AS (
  SELECT o.*, u.region, u.town, u.acres, u.day_rate, u.max_depth_ft, u.lat, u.lon, u.geo_uncertain,
         c.temp_max_f, c.temp_mean_f, c.temp_7d_mean_f, c.precip_in, c.wind_max_mph, c.cloud_pct,
         c.pressure_hpa, c.pressure_delta_24h, c.pressure_trend,
         CASE WHEN clarity_ft <= 1 THEN 'murky' WHEN clarity_ft <= 3 THEN 'stained'
              WHEN clarity_ft <= 100 THEN 'clear' END AS clarity_band,
         CASE WHEN cloud_pct > -1 AND cloud_pct <= 30 THEN 'clear_sky' WHEN cloud_pct > 30 AND cloud_pct <= 70 THEN 'partly'
              WHEN cloud_pct > 70 AND cloud_pct <= 101 THEN 'overcast' END AS cloud_band,
         CASE WHEN wind_max_mph > -1 AND wind_max_mph <= 7 THEN 'calm' WHEN wind_max_mph > 7 AND wind_max_mph <= 15 THEN 'moderate'
              WHEN wind_max_mph > 15 AND wind_max_mph <= 200 THEN 'windy' END AS wind_band,
         CASE WHEN acres > -1 AND acres <= 12 THEN 'small' WHEN acres > 12 AND acres <= 30 THEN 'medium'
              WHEN acres > 30 AND acres <= 100000 THEN 'large' END AS acres_band
  FROM obs o LEFT JOIN units u ON u.unit_id = o.unit_id
       LEFT JOIN conditions c ON c.unit_id = o.unit_id AND c.obs_date = o.obs_date)
""".strip()
