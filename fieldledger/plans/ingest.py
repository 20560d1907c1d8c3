"""Ingest bookkeeping on the pages and events tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I, pages as P
from . import testbed as T
from .registry import query, r6
from .units import cols

KIND = "CASE WHEN contains(url, '/en/') THEN 'report' WHEN contains(url, '/fr/') THEN 'index' ELSE 'lake' END"
STORE = f"store AS (SELECT page_id, url, {KIND} AS kind, page_id % 7 = 3 AS is_missing, CASE WHEN page_id % 11 <> 5 THEN html END AS html FROM pages)"


def store(spark, sf):
    url, k = F.col("url"), F.col("page_id")
    return T.table(spark, sf, "pages").select(
        k, url, F.when(url.contains("/en/"), "report").when(url.contains("/fr/"), "index").otherwise("lake").alias("kind"),
        (k % 7 == 3).alias("is_missing"), F.when(k % 11 != 5, F.col("html")).alias("html"))


@query("page_scan", f"{STORE} SELECT page_id, length(html) AS n FROM store WHERE kind = 'report' AND NOT is_missing AND html IS NOT NULL")
def page_scan(spark, sf):
    return P.page_scan(store(spark, sf), "report").select("page_id", F.length("html").alias("n"))


@query("page_scan_all", f"{STORE} SELECT page_id, is_missing, length(html) AS n FROM store WHERE kind = 'index'")
def page_scan_all(spark, sf):
    return P.page_scan(store(spark, sf), "index", include_missing=True).select("page_id", "is_missing", F.length("html").alias("n"))


@query("upsert_latest", f"""SELECT user_id, event_type, event_id, {cols('value')}, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def upsert_latest(spark, sf):
    out = I.upsert_latest(T.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id", "value", "props")


@query("upsert_prefer_populated", f"""v AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN props END AS attr FROM events)
SELECT user_id, event_id, attr FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY attr IS NULL, event_id) = 1""")
def upsert_prefer_populated(spark, sf):
    rows = T.table(spark, sf, "events").select(
        "user_id", "event_id", F.when(F.col("event_type").isin("click", "view"), F.col("props")).alias("attr"))
    return I.upsert_prefer_populated(rows, ["user_id"], "attr", "event_id")


@query("upsert_coalesce", f"""
d AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS acres, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS town FROM customer),
u AS (SELECT o_custkey AS c_custkey, CASE WHEN count(*) % 2 = 0 THEN sum(o_totalprice) END AS acres, max(o_orderpriority) AS town FROM orders GROUP BY 1)
SELECT c_custkey, {r6('coalesce(u.acres, d.acres)')} AS acres, coalesce(d.town, u.town) AS town FROM d LEFT JOIN u USING (c_custkey)""")
def upsert_coalesce(spark, sf):
    k = F.col("c_custkey")
    dim = T.table(spark, sf, "customer").select(k, F.when(k % 3 != 0, F.col("c_acctbal")).alias("acres"),
                                                F.when(k % 4 != 0, F.col("c_mktsegment")).alias("town"))
    upd = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.when(F.count("*") % 2 == 0, F.sum("o_totalprice")).alias("acres"), F.max("o_orderpriority").alias("town"))
    return I.upsert_coalesce(dim, upd, "c_custkey", new_wins=["acres"], old_wins=["town"])


@query("insert_or_ignore", """
SELECT unit_id, CAST(obs_date AS VARCHAR) AS obs_date, 'own' AS source FROM series
UNION ALL SELECT unit_id + 1, CAST(obs_date AS VARCHAR), 'other' FROM series s WHERE NOT EXISTS (SELECT 1 FROM series t WHERE t.unit_id = s.unit_id + 1 AND t.obs_date = s.obs_date)""")
def insert_or_ignore(spark, sf):
    days = T.series(spark, sf).select("unit_id", "obs_date")
    own = days.withColumn("source", F.lit("own"))
    other = days.select((F.col("unit_id") + 1).alias("unit_id"), "obs_date", F.lit("other").alias("source"))
    return I.insert_or_ignore(own, other, ["unit_id", "obs_date"])


TRACK = r"track\((\d+)\)"


@query("distinct_ids", r"SELECT DISTINCT CAST(unnest(regexp_extract_all(html, 'track\((\d+)\)', 1)) AS BIGINT) AS id FROM pages")
def distinct_ids(spark, sf):
    return I.distinct_ids(T.table(spark, sf, "pages"), TRACK)


@query("discover_max_id", r"SELECT max(CAST(x AS BIGINT)) AS max_id FROM (SELECT unnest(regexp_extract_all(html, 'track\((\d+)\)', 1)) AS x FROM pages)")
def discover_max_id(spark, sf):
    return I.discover_max_id(T.table(spark, sf, "pages"), TRACK)


@query("crawl_frontier", f"""{STORE}
SELECT CAST(g AS BIGINT) AS id FROM generate_series(2, (SELECT max(CAST(x AS BIGINT)) FROM (SELECT unnest(regexp_extract_all(html, 'track\\((\\d+)\\)', 1)) AS x FROM pages))) t(g) WHERE g NOT IN (SELECT page_id FROM store WHERE kind = 'report')""")
def crawl_frontier(spark, sf):
    top = I.discover_max_id(T.table(spark, sf, "pages"), TRACK)
    cached = store(spark, sf).where(F.col("kind") == "report").select(F.col("page_id").alias("id"))
    return I.crawl_frontier(top, cached)


@query("crawl_frontier_limited", f"""{STORE}
SELECT CAST(g AS BIGINT) AS id FROM generate_series(2, (SELECT max(CAST(x AS BIGINT)) FROM (SELECT unnest(regexp_extract_all(html, 'track\\((\\d+)\\)', 1)) AS x FROM pages))) t(g) WHERE g NOT IN (SELECT page_id FROM store WHERE kind = 'report') ORDER BY g LIMIT 25""")
def crawl_frontier_limited(spark, sf):
    top = I.discover_max_id(T.table(spark, sf, "pages"), TRACK)
    cached = store(spark, sf).where(F.col("kind") == "report").select(F.col("page_id").alias("id"))
    return I.crawl_frontier(top, cached, limit=25)


@query("failure_rate_guard", f"SELECT count(*) AS attempted, count(*) FILTER (WHERE event_type = 'error') AS failed, {r6(chr(39).join(['count(*) FILTER (WHERE event_type = ', 'error', ') * 1.0 / count(*)']))} AS rate FROM events")
def failure_rate_guard(spark, sf):
    return I.failure_rate_guard(T.table(spark, sf, "events"), F.col("event_type") == "error")


@query("progress_stats", """SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'purchase', 'signup')) AS ok, count(*) FILTER (WHERE event_type = 'view') AS missing,
  count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY user_id""")
def progress_stats(spark, sf):
    kind = F.col("event_type")
    return I.progress_stats(T.table(spark, sf, "events"), "user_id", kind.isin("click", "purchase", "signup"), kind == "view", kind == "error")


OVERRIDES = """ov AS (SELECT ' ' || c_name || ' ' AS unit, CASE WHEN c_custkey % 13 = 0 THEN 'n/a' ELSE CAST(25.8::DOUBLE + ((c_custkey * 37) % 113) / 10.0::DOUBLE AS VARCHAR) END AS lat,
  CAST(-103.1::DOUBLE + ((c_custkey * 53) % 96) / 10.0::DOUBLE AS VARCHAR) AS lon, CASE c_custkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN ' Y ' WHEN 2 THEN 'no' WHEN 3 THEN NULL WHEN 4 THEN 'TRUE' ELSE '' END AS confirmed FROM customer),
conf AS (SELECT trim(unit) AS unit, TRY_CAST(lat AS DOUBLE) AS lat, TRY_CAST(lon AS DOUBLE) AS lon FROM ov WHERE lower(trim(coalesce(confirmed, ''))) IN ('1', 'y', 'yes', 'true', 't') AND TRY_CAST(lat AS DOUBLE) IS NOT NULL)"""


def override_rows(spark, sf):
    k = F.col("c_custkey")
    word = (F.when(k % 6 == 0, "yes").when(k % 6 == 1, " Y ").when(k % 6 == 2, "no").when(k % 6 == 4, "TRUE").when(k % 6 == 5, ""))
    return T.table(spark, sf, "customer").select(
        F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("unit"),
        F.when(k % 13 == 0, "n/a").otherwise((25.8 + ((k * 37) % 113) / 10.0).cast("string")).alias("lat"),
        (-103.1 + ((k * 53) % 96) / 10.0).cast("string").alias("lon"), word.alias("confirmed"))


@query("load_overrides", f"{OVERRIDES} SELECT unit, {cols('lat', 'lon')} FROM conf")
def load_overrides(spark, sf):
    return I.confirmed_overrides(override_rows(spark, sf))


@query("override_template", f"""{OVERRIDES}, u AS (SELECT c_name AS unit, c_mktsegment AS town, 30.0::DOUBLE AS lat, -97.0::DOUBLE AS lon, count(o_orderkey) AS reports, c_custkey % 5 = 3 AS geo_uncertain FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT unit, town, {r6('coalesce(c.lat, u.lat)')} AS lat, {r6('coalesce(c.lon, u.lon)')} AS lon, reports, CAST(geo_uncertain AS BIGINT) AS uncertain,
  CASE WHEN c.lat IS NOT NULL THEN 'yes' ELSE '' END AS confirmed, CASE WHEN c.lat IS NOT NULL THEN 'hand-confirmed' ELSE '' END AS note FROM u LEFT JOIN conf c USING (unit)""")
def override_template(spark, sf):
    counts = T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("reports"))
    cust = T.table(spark, sf, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_name").alias("unit"), F.col("c_mktsegment").alias("town"), F.lit(30.0).alias("lat"), F.lit(-97.0).alias("lon"),
        F.coalesce("reports", F.lit(0)).alias("reports"), (F.col("c_custkey") % 5 == 3).alias("geo_uncertain"))
    return I.override_template(cust, I.confirmed_overrides(override_rows(spark, sf)))


@query("alias_dim", "SELECT obs_id, CASE WHEN unit_id % 4 = 1 THEN 'NATION_' || (unit_id - 1) ELSE unit END AS unit FROM obs")
def alias_dim(spark, sf):
    unit = F.col("unit_id")
    aliases = T.units(spark, sf).where(unit % 4 == 1).select(
        F.col("unit").alias("variant"), F.concat(F.lit("NATION_"), (unit - 1).cast("string")).alias("canonical"))
    return I.alias_fold(T.observations(spark, sf).select("obs_id", "unit"), "unit", aliases)


@query("slug_dim", """SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, string_agg(DISTINCT lower(p_brand), ',' ORDER BY lower(p_brand)) AS slugs FROM part GROUP BY 1""")
def slug_dim(spark, sf):
    pairs = T.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.lower("p_brand").alias("slug"))
    return I.slug_dim(pairs).select("key", F.array_join("slugs", ",").alias("slugs"))


@query("sql_escape_hatch", f"SELECT unit, slot, count(*) AS n, {r6('avg(count_total)')} AS mean FROM obs WHERE slot IS NOT NULL GROUP BY unit, slot ORDER BY unit, slot")
def sql_escape_hatch(spark, sf):
    return I.sql_escape_hatch(spark, {"trips": T.observations(spark, sf)},
                              "SELECT unit, slot, count(*) AS n, avg(count_total) AS mean FROM trips WHERE slot IS NOT NULL GROUP BY unit, slot ORDER BY unit, slot")


# --- projections and joins with a name of their own ---------------------------------------------------
@query("labels_view", "SELECT obs_id, category, subtype, color, source FROM labs")
def labels_view(spark, sf):
    from ..operators.frames import labels_view as view
    return view(T.labels(spark, sf))


@query("tags_view", "SELECT obs_id, kind, value, detail FROM tags WHERE kind = 'vegetation'")
def tags_view(spark, sf):
    from ..operators.frames import tags_view as view
    return view(T.tags(spark, sf), "vegetation")


FRAME_NUM = ["count_total", "hours", "rate", "max_weight", "acres", "day_rate", "temp_max_f", "temp_7d_mean_f", "wind_max_mph", "cloud_pct",
             "pressure_delta_24h", "clarity_ft", "water_temp_f"]


@query("trips_frame", f"SELECT obs_id, unit, CAST(obs_date AS VARCHAR) AS obs_date, season, slot, region, town, {cols(*FRAME_NUM)}, pressure_trend, clarity_band, cloud_band, wind_band, acres_band FROM frame")
def trips_frame(spark, sf):
    return T.frame(spark, sf).select("obs_id", "unit", "obs_date", "season", "slot", "region", "town", *FRAME_NUM,
                                     "pressure_trend", "clarity_band", "cloud_band", "wind_band", "acres_band")


@query("inner_join_obs_unit", f"SELECT obs_id, unit, {cols('rate', 'acres')} FROM scored JOIN units USING (unit_id, unit) WHERE acres IS NOT NULL")
def inner_join_obs_unit(spark, sf):
    sized = T.units(spark, sf).where(F.col("acres").isNotNull()).select("unit_id", "acres")
    return T.scored(spark, sf).join(sized, "unit_id").select("obs_id", "unit", "rate", "acres")


@query("semi_join_ids", f"SELECT obs_id, unit, {cols('rate')} FROM scored WHERE obs_id IN (SELECT obs_id FROM tags WHERE kind = 'vegetation')")
def semi_join_ids(spark, sf):
    ids = T.tags(spark, sf).where(F.col("kind") == "vegetation").select("obs_id")
    return T.scored(spark, sf).join(ids, "obs_id", "left_semi").select("obs_id", "unit", "rate")


@query("anti_join_ids", f"SELECT obs_id, unit, {cols('rate')} FROM scored WHERE obs_id NOT IN (SELECT obs_id FROM tags WHERE kind = 'vegetation')")
def anti_join_ids(spark, sf):
    ids = T.tags(spark, sf).where(F.col("kind") == "vegetation").select("obs_id")
    return T.scored(spark, sf).join(ids, "obs_id", "left_anti").select("obs_id", "unit", "rate")


# --- set operations and orders --------------------------------------------------------------------------
@query("order_nulls_last", f"SELECT unit, {cols('acres')} FROM units")
def order_nulls_last(spark, sf):
    from ..operators.ranking import order_nulls_last as ordered
    return ordered(T.units(spark, sf), "acres").select("unit", "acres")


@query("order_limit", "SELECT category, count(*) AS n FROM labs GROUP BY category ORDER BY n DESC, category LIMIT 10")
def order_limit(spark, sf):
    return T.labels(spark, sf).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(10)


@query("topk_per_group", f"SELECT unit, obs_id, {cols('rate')} FROM scored QUALIFY row_number() OVER (PARTITION BY unit ORDER BY scored.rate DESC, obs_id) <= 8")
def topk_per_group(spark, sf):
    from ..operators.ranking import topk_per_group as topk
    return topk(T.scored(spark, sf).select("unit", "obs_id", "rate"), ["unit"], [F.desc("rate"), F.asc("obs_id")], 8)


@query("order_by_category_then_value", f"""
s AS (SELECT slot, season, avg(rate) AS m FROM scored GROUP BY slot, season)
SELECT slot, season, {r6('m')} AS mean, row_number() OVER (ORDER BY CASE slot WHEN 'AM' THEN 0 WHEN 'PM' THEN 1 WHEN 'ALL_DAY' THEN 2 ELSE 3 END, m DESC, season) AS position FROM s""")
def order_by_category_then_value(spark, sf):
    from pyspark.sql import Window
    from ..operators.ranking import category_rank
    small = T.scored(spark, sf).groupBy("slot", "season").agg(F.avg("rate").alias("mean"))
    order = [category_rank("slot", ["AM", "PM", "ALL_DAY"]), F.desc("mean"), F.asc("season")]
    return small.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


@query("lexicographic_rank", """SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_size DESC, p_name, p_partkey) AS rank FROM part""")
def lexicographic_rank(spark, sf):
    from ..operators.ranking import row_number_by
    order = [F.desc("p_size"), F.col("p_name"), F.col("p_partkey")]
    return row_number_by(T.table(spark, sf, "part"), ["p_brand"], ["p_type"], order, "rank").select("p_partkey", "p_brand", "rank")


@query("distinct", "SELECT DISTINCT category, subtype FROM labs")
def distinct(spark, sf):
    return T.labels(spark, sf).select("category", "subtype").distinct()


@query("dedupe_by_keys", "SELECT obs_id, category, count(*) AS one FROM (SELECT DISTINCT obs_id, category FROM labs) GROUP BY ALL")
def dedupe_by_keys(spark, sf):
    return T.labels(spark, sf).dropDuplicates(["obs_id", "category"]).select("obs_id", "category", F.lit(1).alias("one"))


@query("union_sources", "SELECT name, count(DISTINCT id) AS n FROM (SELECT c_mktsegment AS name, c_custkey AS id FROM customer UNION ALL SELECT o_orderpriority, o_custkey FROM orders) GROUP BY name")
def union_sources(spark, sf):
    a = T.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("id"))
    b = T.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("id"))
    return a.unionByName(b).groupBy("name").agg(F.count_distinct("id").alias("n"))


@query("set_intersect", "SELECT obs_id FROM labs WHERE category = 'Brand#1' INTERSECT SELECT obs_id FROM scored")
def set_intersect(spark, sf):
    return T.labels(spark, sf).where(F.col("category") == "Brand#1").select("obs_id").intersect(T.scored(spark, sf).select("obs_id"))


@query("set_difference", "SELECT obs_id FROM scored EXCEPT SELECT obs_id FROM labs WHERE category = 'Brand#1'")
def set_difference(spark, sf):
    return T.scored(spark, sf).select("obs_id").subtract(T.labels(spark, sf).where(F.col("category") == "Brand#1").select("obs_id"))


# Reader-facing names of codes.
DISPLAY = {"small_clear_grassy": "Small, clear, grassy", "small_grassy": "Small and grassy", "small_other": "Small, other",
           "larger_grassy": "Larger and grassy", "larger_open": "Larger, open"}


@query("display_label_dim", """
k AS (SELECT unit, CASE WHEN acres <= 30 THEN 'small_grassy' WHEN acres > 30 THEN 'larger_open' ELSE 'odd_code' END AS code FROM units)
SELECT unit, CASE code WHEN 'small_grassy' THEN 'Small and grassy' WHEN 'larger_open' THEN 'Larger, open' ELSE replace(code, '_', ' ') END AS label FROM k""")
def display_label_dim(spark, sf):
    """Codes without an entry are shown with their underscores as blanks."""
    names = F.create_map(*[F.lit(x) for kv in DISPLAY.items() for x in kv])
    acres = F.col("acres")
    coded = T.units(spark, sf).withColumn("code", F.when(acres <= 30, "small_grassy").when(acres > 30, "larger_open").otherwise("odd_code"))
    return coded.select("unit", F.coalesce(F.try_element_at(names, F.col("code")), F.replace(F.col("code"), F.lit("_"), F.lit(" "))).alias("label"))
