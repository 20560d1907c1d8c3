"""Names, pages, aliases and positions on the bound tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import directions as D
from ..functions.geo import bearing_deg, haversine_miles
from ..operators import entities as N, geo as G, ingest as I
from . import testbed as T
from .registry import query, r6
from .series import points
from .text import snippets_sql
from .testbed_sql import SEASON_SQL
from .units import cols

# --- names ---------------------------------------------------------------------------------
NAMES = """idx AS (SELECT o_orderkey AS obs_id, CASE o_orderkey % 10 WHEN 0 THEN upper(base) WHEN 1 THEN ' ' || replace(base, ' ', '  ') || ' .' WHEN 3 THEN NULL ELSE base END AS name,
  CASE WHEN o_orderkey % 10 = 4 AND k < 20 THEN 'Other ' || (k % 3) WHEN o_orderkey % 10 = 5 THEN NULL ELSE ' Town ' || (k % 7) END AS town, k, CAST(o_orderdate AS DATE) + 1 AS posted_date
  FROM (SELECT *, o_custkey % 60 AS k, 'Lake' || (o_custkey % 60) || ' : West ' AS base FROM orders)),
rep AS (SELECT o_orderkey AS obs_id, CASE WHEN o_orderstatus <> 'P' THEN 'Lake' || (o_custkey % 60) || ' : West ' END AS name, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS trip_date,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 2 END AS posted_date FROM orders)"""
NORM = "nullif(regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g'), ' .,-'), '\\s*:\\s*', ': ', 'g'), '')"


def index(spark, sf):
    k, o = F.col("o_custkey") % 60, F.col("o_orderkey") % 10
    base = F.format_string("Lake%d : West ", k)
    name = F.when(o == 0, F.upper(base)).when(o == 1, F.concat(F.lit(" "), F.replace(base, F.lit(" "), F.lit("  ")), F.lit(" ."))) \
        .when(o != 3, base)
    town = F.when((o == 4) & (k < 20), F.format_string("Other %d", k % 3)).when(o != 5, F.format_string(" Town %d", k % 7))
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("obs_id"), name.alias("name"), town.alias("town"), k.alias("k"),
                                               F.date_add(F.to_date("o_orderdate"), 1).alias("posted_date"))


def named_reports(spark, sf):
    exact, day = F.col("o_orderstatus") != "P", F.to_date("o_orderdate")
    return T.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("obs_id"), F.when(exact, F.format_string("Lake%d : West ", F.col("o_custkey") % 60)).alias("name"),
        F.when(exact, day).alias("trip_date"), F.when(F.col("o_orderkey") % 3 == 0, F.date_add(day, 2)).alias("posted_date"))


@query("normalize_unit_name", f"{NAMES} SELECT obs_id, {NORM.format(c='name')} AS name FROM idx")
def normalize_unit_name(spark, sf):
    return index(spark, sf).select("obs_id", N.normalize_unit_name(F.col("name")).alias("name"))


UNITS_BUILT = f"""allnames AS (SELECT obs_id, {NORM.format(c='name')} AS name, nullif(trim(regexp_replace(town, '\\s+', ' ', 'g'), ' .,-'), '') AS town FROM idx
  UNION ALL SELECT obs_id, {NORM.format(c='name')}, NULL FROM rep),
nn AS (SELECT *, lower(name) AS key FROM allnames WHERE name IS NOT NULL),
spell AS (SELECT key, name, count(DISTINCT obs_id) AS n FROM nn GROUP BY key, name),
built AS (SELECT s.name AS unit, t.town, c.report_count FROM (SELECT * FROM spell QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, name) = 1) s
  JOIN (SELECT key, count(DISTINCT obs_id) AS report_count FROM nn GROUP BY key) c USING (key) LEFT JOIN (SELECT key, arg_min(town, obs_id) AS town FROM nn WHERE town IS NOT NULL GROUP BY key) t USING (key))"""


def built_units(spark, sf):
    return N.build_units(index(spark, sf).withColumn("seq", F.col("obs_id")), named_reports(spark, sf))


@query("build_units", f"{NAMES}, {UNITS_BUILT} SELECT unit, town, report_count FROM built")
def build_units(spark, sf):
    return built_units(spark, sf)


# a unit's number is the number in its name
UID = "CAST(regexp_extract(unit, '(\\d+)', 1) AS BIGINT)"


def dim(spark, sf):
    return built_units(spark, sf).withColumn("unit_id", F.regexp_extract("unit", r"(\d+)", 1).cast("long"))


def normalised(df):
    return df.withColumn("name", N.normalize_unit_name(F.col("name")))


def joined_reports(spark, sf):
    rep = normalised(named_reports(spark, sf)).withColumnRenamed("name", "property_name")
    idx = normalised(index(spark, sf)).select("obs_id", F.col("name").alias("lake_name"), "posted_date")
    return rep, idx


LOOKED = f"""looked AS (SELECT r.obs_id, r.trip_date, r.posted_date, i.posted_date AS index_posted, u.unit, {UID.replace('unit', 'u.unit')} AS unit_id FROM rep r JOIN idx i USING (obs_id)
  LEFT JOIN built u ON u.unit = coalesce({NORM.format(c='r.name')}, {NORM.format(c='i.name')}))"""


@query("lookup_join", f"{NAMES}, {UNITS_BUILT}, {LOOKED} SELECT obs_id, unit_id FROM looked")
def lookup_join(spark, sf):
    rep, idx = joined_reports(spark, sf)
    return N.lookup_join(rep, idx, dim(spark, sf)).select("obs_id", "unit_id")


@query("trip_date_resolve", f"""{NAMES}
SELECT r.obs_id, CAST(CAST(coalesce(trip_date, coalesce(r.posted_date, i.posted_date) - 1) AS DATE) AS VARCHAR) AS obs_date, CASE WHEN trip_date IS NOT NULL THEN 'reservation' ELSE 'posted_estimate' END AS date_source FROM rep r JOIN idx i USING (obs_id)""")
def trip_date_resolve(spark, sf):
    both = named_reports(spark, sf).join(index(spark, sf).select("obs_id", F.col("posted_date").alias("index_posted")), "obs_id")
    return N.trip_date_resolve(both, "trip_date", "posted_date", "index_posted").select("obs_id", "obs_date", "date_source")


TRIPS = f"""{NAMES}, {UNITS_BUILT}, {LOOKED},
facts AS (SELECT l.obs_id, l.unit_id, CAST(coalesce(trip_date, coalesce(posted_date, index_posted) - 1) AS DATE) AS d, CASE WHEN trip_date IS NOT NULL THEN 'reservation' ELSE 'posted_estimate' END AS date_source,
  o.slot, o.hours, o.count_total, o.rate, o.max_weight FROM looked l JOIN obs o USING (obs_id))"""


def trips(spark, sf):
    rep, idx = joined_reports(spark, sf)
    facts = T.raw_observations(spark, sf).select("obs_id", "slot", "count_total", "max_weight")
    return N.build_trips(rep.join(facts, "obs_id"), idx, dim(spark, sf))


@query("build_trips", f"""{TRIPS} SELECT obs_id, unit_id, unit_id IS NOT NULL AS unit_known, CAST(d AS VARCHAR) AS obs_date, CAST(year(d) AS BIGINT) AS year, CAST(month(d) AS BIGINT) AS month,
  {SEASON_SQL.format(m='month(d)')} AS season, slot, date_source, {cols('hours', 'count_total', 'rate', 'max_weight')} FROM facts""")
def build_trips(spark, sf):
    return trips(spark, sf)


@query("build_trips_stats", f"""{TRIPS} SELECT count(*) AS total, count(unit_id) AS unit_known, count(*) FILTER (WHERE date_source = 'reservation') AS date_exact, count(count_total) AS with_count FROM facts""")
def build_trips_stats(spark, sf):
    return N.trip_stats(trips(spark, sf))


@query("recount_units", f"""{TRIPS} SELECT {UID} AS unit_id, unit, coalesce(n, 0) AS report_count FROM built LEFT JOIN (SELECT unit_id, count(DISTINCT obs_id) AS n FROM facts GROUP BY 1) t ON t.unit_id = {UID}""")
def recount_units(spark, sf):
    return N.recount_units(dim(spark, sf), trips(spark, sf)).select("unit_id", "unit", "report_count")


SLUG = "trim(regexp_replace(replace(lower({c}), '&', ' and '), '[^a-z0-9]+', '_', 'g'), '_')"


@query("slugify", f"SELECT p_partkey, {SLUG.format(c=chr(39).join(['p_name || ', ' & ', ' || p_brand || ', ' Lake', '']))} AS slug FROM part")
def slugify(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", N.slugify(F.concat("p_name", F.lit(" & "), "p_brand", F.lit(" Lake"))).alias("slug"))


@query("slug_variants", f"""{NAMES}, {UNITS_BUILT},
known AS (SELECT regexp_replace(lower(unit), '[^a-z0-9]', '', 'g') AS key, 'site_' || {UID} AS s FROM built WHERE {UID} % 4 = 0),
b AS (SELECT unit || ' Lake' AS name, unit, {SLUG.format(c="unit || ' Lake'")} AS base, {SLUG.format(c="split_part(unit || ' Lake', ':', 2)")} AS tail, {SLUG.format(c="split_part(unit || ' Lake', ':', 1)")} AS head FROM built)
SELECT name, concat_ws(',', s, base, tail, head, left(base, length(base) - 5)) AS variants FROM b LEFT JOIN known ON key = regexp_replace(lower(name), '[^a-z0-9]', '', 'g')""")
def slug_variants(spark, sf):
    built = built_units(spark, sf)
    number = F.regexp_extract("unit", r"(\d+)", 1)
    known = I.slug_dim(built.where(number.cast("int") % 4 == 0).select(F.col("unit").alias("name"), F.concat(F.lit("site_"), number).alias("slug")))
    out = N.slug_variants(built.select(F.concat("unit", F.lit(" Lake")).alias("name")), "name", known)
    return out.select("name", F.array_join("variants", ",").alias("variants"))


@query("match_unit_page", f"""{NAMES}, {UNITS_BUILT},
p AS (SELECT {UID} AS k, unit, CASE {UID} % 4 WHEN 0 THEN {SLUG.format(c='unit')} WHEN 1 THEN 'odd_' || {UID} WHEN 2 THEN 'zzz_' || {UID} ELSE 'yyy_' || {UID} END AS slug,
  CASE {UID} % 4 WHEN 2 THEN 'Town, ' || unit ELSE 'Town, Nowhere' END AS name FROM built)
SELECT slug, name, CASE WHEN k % 4 <> 3 THEN unit END AS unit, CASE k % 4 WHEN 0 THEN 'slug' WHEN 1 THEN 'published' WHEN 2 THEN 'title' ELSE 'unmatched' END AS matched_by FROM p""")
def match_unit_page(spark, sf):
    units = dim(spark, sf)
    k = F.col("unit_id")
    slug = F.when(k % 4 == 0, N.slugify(F.col("unit"))).when(k % 4 == 1, F.format_string("odd_%d", k)).when(k % 4 == 2, F.format_string("zzz_%d", k)) \
        .otherwise(F.format_string("yyy_%d", k))
    pages = units.select(slug.alias("slug"), F.when(k % 4 == 2, F.concat(F.lit("Town, "), "unit")).otherwise("Town, Nowhere").alias("name"))
    slugs = units.where(k % 4 == 1).select(F.col("unit").alias("name"), F.format_string("odd_%d", k).alias("slug"))
    return N.match_unit_page(pages, units, slugs)


ALIAS = "CASE WHEN unit_id % 4 = 1 THEN 'NATION_' || (unit_id - 1) ELSE unit END"


def aliases(spark, sf):
    k = F.col("unit_id")
    return T.units(spark, sf).where(k % 4 == 1).select(F.col("unit").alias("variant"), F.format_string("NATION_%d", k - 1).alias("canonical"))


def merged(spark, sf):
    series = T.series(spark, sf).join(T.units(spark, sf).select("unit_id", "unit"), "unit_id").select("unit", "obs_date", "pressure_hpa")
    return N.merge_aliases(T.observations(spark, sf).select("obs_id", "unit"), series, aliases(spark, sf))


@query("merge_aliases", f"SELECT {ALIAS} AS unit, count(DISTINCT obs_id) AS trips FROM obs GROUP BY 1")
def merge_aliases(spark, sf):
    facts, _ = merged(spark, sf)
    return facts.groupBy("unit").agg(F.count_distinct("obs_id").alias("trips"))


@query("merge_aliases_conditions", f"""
c AS (SELECT {ALIAS} AS unit, unit AS src, obs_date, pressure_hpa FROM series JOIN units USING (unit_id))
SELECT unit, CAST(obs_date AS VARCHAR) AS obs_date, {cols('pressure_hpa')} FROM c QUALIFY row_number() OVER (PARTITION BY unit, obs_date ORDER BY src <> unit, src) = 1""")
def merge_aliases_conditions(spark, sf):
    return merged(spark, sf)[1]


def hav(a, b, c, d):
    return (f"(2 * 3958.8::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2)))))")


SPLIT = f"""{NAMES},
u AS (SELECT DISTINCT 'Lake' || k AS unit, 26.0::DOUBLE + k / 10.0::DOUBLE AS lat, -100.0::DOUBLE + k / 20.0::DOUBLE AS lon FROM idx),
props AS (SELECT DISTINCT CASE WHEN i < 7 THEN 'Town ' || i || ' Texas' ELSE 'Other ' || (i - 7) || ' Texas Dallas' END AS place, 27.0::DOUBLE + i / 2.0::DOUBLE AS lat, -99.0::DOUBLE + i / 3.0::DOUBLE AS lon, i FROM (SELECT DISTINCT o_custkey % 9 AS i FROM orders)),
towns AS (SELECT 'Lake' || k AS unit, trim(town) AS town, count(*) AS n FROM idx WHERE town IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5),
cand AS (SELECT t.*, p.lat AS plat, p.lon AS plon, coalesce({hav('u.lat', 'u.lon', 'p.lat', 'p.lon')}, 9e9) AS miles FROM towns t JOIN u USING (unit) LEFT JOIN props p ON starts_with(lower(p.place), lower(t.town))
  WHERE unit IN (SELECT unit FROM towns GROUP BY unit HAVING count(*) >= 2)),
plan AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY miles, town) = 1 AS keeps FROM cand)"""


def split_plan(spark, sf):
    k = F.col("k")
    idx = index(spark, sf).select("obs_id", F.format_string("Lake%d", k).alias("name"), F.trim("town").alias("town"), "k")
    units = idx.select(F.col("name").alias("unit"), (26.0 + k / 10.0).alias("lat"), (-100.0 + k / 20.0).alias("lon")).dropDuplicates()
    i = F.col("i")
    props = T.table(spark, sf, "orders").select((F.col("o_custkey") % 9).alias("i")).dropDuplicates().select(
        F.when(i < 7, F.format_string("Town %d Texas", i)).otherwise(F.format_string("Other %d Texas Dallas", i - 7)).alias("place"),
        (27.0 + i / 2.0).alias("lat"), (-99.0 + i / 3.0).alias("lon"))
    return idx, N.split_name_collisions(idx, units, props)


@query("split_name_collisions", f"{SPLIT} SELECT unit, town, n, keeps, CASE WHEN keeps THEN unit ELSE unit || ' (' || town || ')' END AS new_name, {r6('plat')} AS lat, {r6('plon')} AS lon FROM plan")
def split_name_collisions(spark, sf):
    return split_plan(spark, sf)[1]


@query("split_name_moved", f"""{SPLIT} SELECT CASE WHEN p.keeps = FALSE THEN p.unit || ' (' || p.town || ')' ELSE 'Lake' || k END AS unit, count(*) AS trips
FROM idx LEFT JOIN plan p ON p.unit = 'Lake' || k AND p.town = trim(idx.town) GROUP BY 1""")
def split_name_moved(spark, sf):
    idx, plan = split_plan(spark, sf)
    return N.apply_name_split(idx.withColumnRenamed("name", "unit"), plan).groupBy("unit").agg(F.count("*").alias("trips"))


@query("club_town", "SELECT DISTINCT c_mktsegment || ' Springs' AS town FROM customer")
def club_town(spark, sf):
    place = F.concat(F.lit("  "), "c_mktsegment", F.lit(" Springs East Texas Dallas"))
    return T.table(spark, sf, "customer").select(G.club_town(place).alias("town")).distinct()


# --- directions -----------------------------------------------------------------------------------
@query("direction_claims", f"""
p AS (SELECT s_suppkey AS k, 5 + s_suppkey % 90 AS m, 1 + s_suppkey % 3 AS h, s_suppkey % 60 AS mi, ['NE', 'south west', 'north', 'ESE'][s_suppkey % 4 + 1] AS dir, [45.0, 225.0, 0.0, 112.5][s_suppkey % 4 + 1] AS deg FROM supplier)
SELECT k, 'dallas' AS city, {r6('m')} AS miles, {r6('deg')} AS bearing, FALSE AS from_time FROM p
UNION ALL SELECT k, 'houston', {r6('(h + mi / 60.0::DOUBLE) * 55')}, CAST(NULL AS DOUBLE), TRUE FROM p
UNION ALL SELECT k, 'fort worth', {r6('2.5 * 55')}, CAST(NULL AS DOUBLE), TRUE FROM p
UNION ALL SELECT k, 'beaumont', {r6('14')}, 0.0, FALSE FROM p""")
def direction_claims(spark, sf):
    k = F.col("s_suppkey")
    word = F.element_at(F.array(*[F.lit(w) for w in ("NE", "south west", "north", "ESE")]), (k % 4 + 1).cast("int"))
    html = F.format_string(
        "<html><head><title>60 miles from Tyler</title></head><p>General Directions</p> %d miles, around 20 minutes %s of Downtown Dallas. <b>%d hours and %d minutes</b> from downtown Houston. 2.5 from Ft. Worth. "
        "North of Beaumont, approximately 14 miles. Then Waco. Property Pricing 9 miles from Paris</html>", 5 + k % 90, word, 1 + k % 3, k % 60)
    return D.direction_claims(T.table(spark, sf, "supplier").select(k.alias("k"), html.alias("html")), "k").drop("pos")


# --- positions: customers as units ------------------------------------------------------------------
CITY3 = "['dallas', 'houston', 'austin'][k % 3 + 1]"
CLAT, CLON = "[32.7767, 29.7604, 30.2672][k % 3 + 1]::DOUBLE", "[-96.7970, -95.3698, -97.7431][k % 3 + 1]::DOUBLE"


def brg(a, b, c, d):
    raw = (f"degrees(atan2(sin(radians(({d}) - ({b}))) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians(({d}) - ({b})))))")
    return f"(({raw} + 360) - floor(({raw} + 360) / 360) * 360)"


GAZ = "gaz(city, clat, clon) AS (VALUES " + ", ".join(f"('{c}', {a}::DOUBLE, {o}::DOUBLE)" for c, (a, o) in D.CITIES.items()) + ")"
PLACES = f"""pt AS (SELECT c_custkey AS k, 25.8::DOUBLE + ((c_custkey * 37) % 113) / 10.0::DOUBLE AS lat, -103.1::DOUBLE + ((c_custkey * 53) % 96) / 10.0::DOUBLE AS lon FROM customer),
gu AS (SELECT pt.*, 'U' || k AS unit, 'Town ' || (k % 50) AS town, k % 5 = 3 AS geo_uncertain, (SELECT count(*) FROM orders WHERE o_custkey = k) AS reports FROM pt),
cl AS (SELECT unit, {CITY3} AS city, round({hav(CLAT, CLON, 'lat', 'lon')}, 0) * CASE WHEN k % 5 = 0 THEN 2.0 ELSE 1.0 END AS miles,
  CASE WHEN k % 2 = 0 THEN (round({brg(CLAT, CLON, 'lat', 'lon')} / 22.5, 0) * 22.5 + CASE WHEN k % 7 = 0 THEN 180.0 ELSE 0.0 END) % 360 END AS bearing, k % 2 = 1 AS from_time FROM gu WHERE k % 4 <> 3
  UNION ALL SELECT unit, 'tyler', 60.0 + k % 200, NULL, TRUE FROM gu WHERE k % 6 = 0
  UNION ALL SELECT unit, 'atlantis', 10.0, NULL, TRUE FROM gu WHERE k % 6 = 1), {GAZ}"""


def score_sql(name: str, points: str, keys: str) -> str:
    return f"""{name} AS (SELECT {keys}, round(max(CASE WHEN bg > 70 THEN greatest(gap, actual * 0.5) ELSE gap END), 1) AS miss, count(*) AS claims FROM (
  SELECT {keys}, actual, greatest(0.0, abs(actual - miles) - greatest(22.0, miles * CASE WHEN from_time THEN 0.55 ELSE 0.45 END)) AS gap, CASE WHEN bearing IS NOT NULL THEN least(abs(head - bearing), 360 - abs(head - bearing)) END AS bg FROM (
  SELECT {', '.join('p.' + x.strip() for x in keys.split(','))}, c.miles, c.bearing, c.from_time, {hav('clat', 'clon', 'p.lat', 'p.lon')} AS actual, {brg('clat', 'clon', 'p.lat', 'p.lon')} AS head FROM {points} p JOIN cl c ON c.unit = p.unit JOIN gaz USING (city))) GROUP BY {keys})"""


def geo_units(spark, sf):
    counts = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("reports"))
    k = F.col("c_custkey")
    return points(spark, sf).join(counts, "c_custkey", "left").select(
        k.alias("k"), F.concat(F.lit("U"), k.cast("string")).alias("unit"), F.format_string("Town %d", k % 50).alias("town"), "lat", "lon",
        (k % 5 == 3).alias("geo_uncertain"), F.coalesce("reports", F.lit(0)).alias("reports"))


def geo_claims(spark, sf):
    k, units = F.col("k"), geo_units(spark, sf)
    three = ["dallas", "houston", "austin"]
    pick = lambda i: F.element_at(F.array(*[F.lit(D.CITIES[c][i]) for c in three]), (k % 3 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(c) for c in three]), (k % 3 + 1).cast("int"))
    lat, lon = F.col("lat"), F.col("lon")
    heading = F.round(bearing_deg(pick(0), pick(1), lat, lon) / 22.5, 0) * 22.5 + F.when(k % 7 == 0, 180.0).otherwise(0.0)
    first = units.where(k % 4 != 3).select(
        "unit", name.alias("city"), (F.round(haversine_miles(pick(0), pick(1), lat, lon), 0) * F.when(k % 5 == 0, 2.0).otherwise(1.0)).alias("miles"),
        F.when(k % 2 == 0, heading % 360).alias("bearing"), (k % 2 == 1).alias("from_time"))
    none = F.lit(None).cast("double").alias("bearing")
    second = units.where(k % 6 == 0).select("unit", F.lit("tyler").alias("city"), (60.0 + k % 200).alias("miles"), none, F.lit(True).alias("from_time"))
    third = units.where(k % 6 == 1).select("unit", F.lit("atlantis").alias("city"), F.lit(10.0).alias("miles"), none, F.lit(True).alias("from_time"))
    return first.unionByName(second).unionByName(third)


@query("geo_score", f"{PLACES}, {score_sql('sc', 'gu', 'unit')} SELECT unit, {cols('miss')}, claims FROM sc")
def geo_score(spark, sf):
    return G.geo_score(geo_units(spark, sf), geo_claims(spark, sf), ["unit"], ["unit"])


VERIFY = f"""{PLACES}, {score_sql('sc', 'gu', 'unit')},
ver AS (SELECT gu.*, miss, coalesce(claims, 0) AS claims, k % 10 = 0 AS confirmed, CASE WHEN miss IS NULL THEN 'no claim' WHEN miss <= 0 THEN 'ok' WHEN k % 10 = 0 THEN 'settled' ELSE 'suspect' END AS verdict FROM gu LEFT JOIN sc USING (unit))"""


def verified(spark, sf):
    units = geo_units(spark, sf)
    return G.geo_verify(units, geo_claims(spark, sf), units.where(F.col("k") % 10 == 0).select("unit"))


@query("geo_verify", f"{VERIFY} SELECT unit, {cols('miss')}, claims, confirmed, verdict FROM ver")
def geo_verify(spark, sf):
    return verified(spark, sf).select("unit", "miss", "claims", "confirmed", "verdict")


@query("geo_verify_counts", f"{VERIFY} SELECT verdict, count(*) AS n FROM ver GROUP BY verdict")
def geo_verify_counts(spark, sf):
    return G.verdict_counts(verified(spark, sf))


@query("settled_anchors", f"{PLACES} SELECT unit, {cols('lat', 'lon')} FROM gu WHERE NOT geo_uncertain")
def settled_anchors(spark, sf):
    return G.settled_anchors(geo_units(spark, sf))


CANDS = f"""{PLACES},
ca AS (SELECT unit, 'c' || i AS cand, i, k, 25.8::DOUBLE + ((k * 37 + i * 41) % 113) / 10.0::DOUBLE AS lat, -103.1::DOUBLE + ((k * 53 + i * 29) % 96) / 10.0::DOUBLE AS lon, (k + i) % 2 AS state_rank,
  CASE (k + i) % 4 WHEN 1 THEN 800 WHEN 2 THEN 20000 WHEN 3 THEN 90000 END AS population FROM gu, (VALUES (0), (1), (2)) t(i) WHERE k % 3 <> 0 OR i = 0),
rg AS (SELECT unit, CASE WHEN k % 5 <> 0 THEN [32.78, 29.76, 30.27, 29.42, 35.47, 32.35, 32.45][k % 7 + 1]::DOUBLE END AS rlat, CASE WHEN k % 5 <> 0 THEN [-96.80, -95.37, -97.74, -98.49, -97.52, -95.30, -99.73][k % 7 + 1]::DOUBLE END AS rlon FROM gu),
{score_sql('cs', 'ca', 'unit, cand, lat, lon')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY miss, cand) AS rn, lead(miss) OVER (PARTITION BY unit ORDER BY miss, cand) AS runner_up FROM cs),
best AS (SELECT * FROM ranked WHERE rn = 1 AND miss <= 22 AND coalesce(runner_up - miss >= 10, TRUE))"""


def candidates(spark, sf):
    k, i = F.col("k"), F.col("i")
    fanned = geo_units(spark, sf).select("unit", "k", F.explode(F.when(k % 3 != 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))).alias("i"))
    m = (k + i) % 4
    return fanned.select("unit", F.concat(F.lit("c"), i.cast("string")).alias("cand"), (25.8 + ((k * 37 + i * 41) % 113) / 10.0).alias("lat"),
                         (-103.1 + ((k * 53 + i * 29) % 96) / 10.0).alias("lon"), ((k + i) % 2).alias("state_rank"),
                         F.when(m == 1, 800).when(m == 2, 20000).when(m == 3, 90000).alias("population"))


def regions(spark, sf):
    k = F.col("k")
    centres = list(G.REGION_CENTRES.values())
    pick = lambda j: F.when(k % 5 != 0, F.element_at(F.array(*[F.lit(c[j]) for c in centres]), (k % 7 + 1).cast("int")))
    return geo_units(spark, sf).select("unit", pick(0).alias("region_lat"), pick(1).alias("region_lon"))


@query("geo_best_candidate", f"{CANDS} SELECT unit, cand, {cols('lat', 'lon', 'miss', 'runner_up')}, claims FROM best")
def geo_best_candidate(spark, sf):
    return G.geo_best_candidate(candidates(spark, sf), geo_claims(spark, sf))


@query("geo_pick_candidate", f"""{CANDS},
o AS (SELECT c.*, rlat, rlon, row_number() OVER (PARTITION BY c.unit ORDER BY state_rank, CASE WHEN rlat IS NOT NULL THEN {hav('rlat', 'rlon', 'c.lat', 'c.lon')} ELSE -coalesce(population, 0) END, cand) AS rn, count(*) OVER (PARTITION BY c.unit) AS n FROM ca c JOIN rg USING (unit)),
f AS (SELECT o.*, (SELECT max({hav('o.lat', 'o.lon', 'z.lat', 'z.lon')}) FROM ca z WHERE z.unit = o.unit) AS spread, s.miss AS fm FROM o LEFT JOIN cs s ON s.unit = o.unit AND s.cand = o.cand WHERE rn = 1)
SELECT f.unit, coalesce(b.cand, f.cand) AS cand, {r6('coalesce(b.lat, f.lat)')} AS lat, {r6('coalesce(b.lon, f.lon)')} AS lon, n AS candidates, CASE WHEN b.cand IS NOT NULL THEN 'directions' WHEN rlat IS NOT NULL THEN 'region' ELSE 'population' END AS source,
  {r6('CASE WHEN b.cand IS NOT NULL THEN b.miss ELSE fm END')} AS miss, CASE WHEN b.cand IS NOT NULL THEN FALSE ELSE (rlat IS NULL AND n > 1 AND spread > 25) OR coalesce(fm > 0, FALSE) END AS uncertain FROM f LEFT JOIN best b ON b.unit = f.unit""")
def geo_pick_candidate(spark, sf):
    return G.geo_pick_candidate(regions(spark, sf), candidates(spark, sf), geo_claims(spark, sf))


RANKED = f"""{CANDS},
nr AS (SELECT c.unit, c.cand, min({hav('c.lat', 'c.lon', 'a.lat', 'a.lon')}) AS near FROM ca c, (SELECT DISTINCT lat, lon FROM gu WHERE NOT geo_uncertain) a GROUP BY 1, 2),
rk AS (SELECT c.*, near, CASE WHEN c.unit IN (SELECT unit FROM cl) THEN 'directions' WHEN rlat IS NOT NULL THEN 'club region' ELSE 'real town, then club cluster' END AS basis,
  row_number() OVER (PARTITION BY c.unit ORDER BY CASE WHEN c.unit IN (SELECT unit FROM cl) THEN coalesce(s.miss, 0) WHEN rlat IS NOT NULL THEN {hav('rlat', 'rlon', 'c.lat', 'c.lon')} ELSE 0 END, population IS NULL,
    near + CASE WHEN population > 50000 THEN 12 WHEN population > 15000 THEN 6 ELSE 0 END, cand) AS rank
  FROM ca c JOIN nr USING (unit, cand) JOIN rg USING (unit) LEFT JOIN cs s ON s.unit = c.unit AND s.cand = c.cand)"""


def ranked(spark, sf):
    return G.geo_rank_candidates(candidates(spark, sf), G.settled_anchors(geo_units(spark, sf)), geo_claims(spark, sf), regions(spark, sf))


@query("geo_rank_candidates", f"{RANKED} SELECT unit, cand, {cols('lat', 'lon', 'near')}, population, basis, rank FROM rk")
def geo_rank_candidates(spark, sf):
    return ranked(spark, sf)


@query("geo_pending", f"{PLACES} SELECT unit, town, reports FROM gu WHERE geo_uncertain")
def geo_pending(spark, sf):
    return G.geo_pending(geo_units(spark, sf)).select("unit", "town", "reports")


@query("geo_context", f"""{RANKED}, sp AS (SELECT 'U' || o_custkey AS unit, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1),
ch AS (SELECT unit, string_agg(cand, ',' ORDER BY rank) AS choices, max(basis) AS basis FROM rk WHERE rank <= 5 GROUP BY unit),
nt AS (SELECT unit, string_agg(sentence, ' / ' ORDER BY rank) AS notes FROM (WITH {snippets_sql("'U' || o_custkey")}) GROUP BY unit)
SELECT gu.unit, gu.town, reports, CAST(a AS VARCHAR) AS first, CAST(b AS VARCHAR) AS last, choices, basis, notes FROM gu LEFT JOIN sp USING (unit) LEFT JOIN ch USING (unit) LEFT JOIN nt USING (unit) WHERE geo_uncertain""")
def geo_context(spark, sf):
    from ..operators.rules import snippets
    from .text import reports
    obs = T.table(spark, sf, "orders").select(F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("unit"), F.to_date("o_orderdate").alias("obs_date"))
    notes = snippets(reports(spark, sf).withColumn("unit", F.concat(F.lit("U"), F.col("o_custkey").cast("string"))))
    out = G.geo_context(G.geo_pending(geo_units(spark, sf)), obs, ranked(spark, sf), notes)
    return out.select("unit", "town", "reports", "first", "last", F.array_join(F.transform("choices", lambda c: c["cand"]), ",").alias("choices"), "basis",
                      F.array_join(F.transform("notes", lambda n: n["sentence"]), " / ").alias("notes"))


@query("sibling_propagate", f"""{VERIFY},
pin AS (SELECT lower(town) AS t, lat AS plat, lon AS plon FROM ver WHERE verdict = 'ok' QUALIFY row_number() OVER (PARTITION BY lower(town) ORDER BY reports DESC, unit) = 1)
SELECT unit, town, reports, {r6('plat')} AS new_lat, {r6('plon')} AS new_lon, {r6(hav('lat', 'lon', 'plat', 'plon'))} AS moved FROM ver JOIN pin ON t = lower(town) WHERE geo_uncertain""")
def sibling_propagate(spark, sf):
    return G.sibling_propagate(verified(spark, sf), geo_units(spark, sf))


@query("geo_repair_targets", f"""{VERIFY},
af AS (SELECT unit, CASE WHEN k % 3 = 0 THEN lat + 0.2 ELSE lat END AS tl, lon AS tn FROM gu)
SELECT unit, verdict, {r6(hav('lat', 'lon', 'tl', 'tn'))} AS miles, {hav('lat', 'lon', 'tl', 'tn')} > 5 AS moved FROM ver JOIN af USING (unit) WHERE verdict = 'suspect' OR geo_uncertain""")
def geo_repair_targets(spark, sf):
    after = geo_units(spark, sf).select("unit", F.when(F.col("k") % 3 == 0, F.col("lat") + 0.2).otherwise(F.col("lat")).alias("lat"), "lon")
    return G.geo_repair_targets(verified(spark, sf), after)


@query("unit_facts", f"SELECT unit, region, town, {cols('acres', 'day_rate', 'max_depth_ft')}, {r6('round(' + hav('32.7767', '-96.7970', 'lat', 'lon') + ', 0)')} AS miles FROM units")
def unit_facts(spark, sf):
    return G.unit_facts(T.units(spark, sf)).select("unit", "region", "town", "acres", "day_rate", "max_depth_ft", "miles")


# --- surveyed points -------------------------------------------------------------------------------------
@query("waypoint_match", f"""{PLACES},
wu AS (SELECT k AS unit_id, c_name AS unit, CASE WHEN k % 3 = 0 THEN 's_' || k END AS slug, lat, lon FROM gu JOIN customer ON c_custkey = k),
wp AS (SELECT k AS prop_id, CASE WHEN k % 12 = 3 THEN prev ELSE CASE WHEN k % 6 = 3 THEN 'Nowhere ' || k ELSE name END END AS title, CASE k % 6 WHEN 0 THEN 's_' || k WHEN 1 THEN {SLUG.format(c='name')} WHEN 4 THEN 'nope_' || k END AS slug, lat + 0.1 AS lat, lon AS lon
  FROM (SELECT k, lat, lon, c_name AS name, (SELECT c_name FROM customer z WHERE z.c_custkey = k - 1) AS prev FROM gu JOIN customer ON c_custkey = k) WHERE k % 6 <> 5),
res AS (SELECT prop_id, CASE WHEN prop_id % 6 = 0 THEN 'slug' WHEN prop_id % 6 = 1 THEN 'name' WHEN prop_id % 12 = 3 THEN 'ambiguous' WHEN prop_id % 6 = 3 THEN 'unmatched'
   WHEN prop_id % 12 = 2 AND prop_id + 1 IN (SELECT prop_id FROM wp) THEN 'ambiguous' ELSE 'title' END AS how FROM wp)
SELECT wp.prop_id, how, wu.unit_id, wu.unit, {r6('wp.lat')} AS lat, {r6('wp.lon')} AS lon, 'Coalgate' AS town, {r6(hav('wu.lat', 'wu.lon', 'wp.lat', 'wp.lon'))} AS moved FROM wp JOIN res USING (prop_id) LEFT JOIN wu ON wu.unit_id = prop_id AND how IN ('slug', 'name', 'title')""")
def waypoint_match(spark, sf):
    props, units = waypoints(spark, sf)
    return G.waypoint_match(props, units)


def waypoints(spark, sf):
    k = F.col("k")
    names = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    before = names.select((k + 1).alias("k"), F.col("c_name").alias("prev"))
    base = geo_units(spark, sf).drop("unit").join(names, "k").join(before, "k", "left")
    units = base.select(k.alias("unit_id"), F.col("c_name").alias("unit"), F.when(k % 3 == 0, F.format_string("s_%d", k)).alias("slug"), "lat", "lon", "reports")
    title = F.when(k % 12 == 3, F.col("prev")).when(k % 6 == 3, F.format_string("Nowhere %d", k)).otherwise(F.col("c_name"))
    slug = F.when(k % 6 == 0, F.format_string("s_%d", k)).when(k % 6 == 1, N.slugify(F.col("c_name"))).when(k % 6 == 4, F.format_string("nope_%d", k))
    props = base.where(k % 6 != 5).select(k.alias("prop_id"), title.alias("title"), slug.alias("slug"), (F.col("lat") + 0.1).alias("lat"), "lon",
                                          F.lit("Coalgate Oklahoma Area").alias("place"))
    return props, units


@query("coord_source", """
SELECT CASE WHEN c_custkey % 6 IN (0, 1, 4) OR (c_custkey % 12 = 8) OR (c_custkey % 12 = 2 AND c_custkey = (SELECT max(c_custkey) FROM customer)) THEN 'waypoint' ELSE 'inferred' END AS coord_source, count(*) AS n FROM customer GROUP BY 1""")
def coord_source(spark, sf):
    props, units = waypoints(spark, sf)
    return G.coord_source(units, G.waypoint_match(props, units)).groupBy("coord_source").agg(F.count("*").alias("n"))
