"""Entity resolution by name: units from two sources, pages, aliases, collisions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import haversine_miles
from .ingest import alias_fold, insert_or_ignore, norm_title

POST_LAG_DAYS = 1
MIN_SPLIT = 5


def normalize_unit_name(name: Column) -> Column:
    """Whitespace collapsed, ends stripped of ' .,-', 'a : b' as 'a: b'."""
    squeezed = F.btrim(F.regexp_replace(name, r"\s+", " "), F.lit(" .,-"))
    return F.nullif(F.regexp_replace(squeezed, r"\s*:\s*", ": "), F.lit(""))


def slugify(name: Column) -> Column:
    s = F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "_")
    return F.btrim(s, F.lit("_"))


def slug_variants(df: DataFrame, name: str, known: DataFrame) -> DataFrame:
    """Ordered candidate slugs in ``variants``: published ones, the plain slug, the
    parts around a colon, the plain slug without a generic last word."""
    c = F.col(name)
    base = slugify(c)
    colon = c.contains(":")
    head = slugify(F.substring_index(c, ":", 1))
    tail = slugify(F.substr(c, F.locate(":", c) + 1))
    empty = F.expr("cast(array() as array<string>)")
    dropped = F.filter(F.array(*[F.when(base.endswith(s), F.substr(base, F.lit(1), F.length(base) - len(s)))
                                 for s in ("_lake", "_lakes", "_ranch", "_farms")]), lambda x: x.isNotNull())
    out = df.withColumn("_key", norm_title(c)).join(known.withColumnRenamed("key", "_key"), "_key", "left")
    parts = F.concat(F.coalesce("slugs", empty), F.array(base), F.when(colon, F.array(tail, head)).otherwise(empty), dropped)
    return out.withColumn("variants", F.filter(parts, lambda v: v != "")).drop("_key", "slugs")


def trip_date_resolve(df: DataFrame, reserved: str, *posted: str) -> DataFrame:
    """Reservation date, else the first posted date less the usual lag, with its source."""
    estimate = F.date_sub(F.coalesce(*posted), POST_LAG_DAYS)
    return df.withColumn("obs_date", F.coalesce(F.col(reserved), estimate)).withColumn(
        "date_source", F.when(F.col(reserved).isNotNull(), "reservation").when(estimate.isNotNull(), "posted_estimate"))


def lookup_join(reports: DataFrame, index: DataFrame, units: DataFrame) -> DataFrame:
    """Unit of each report: the name on its own page before the listing's name."""
    listed = index.select("obs_id", F.col("lake_name").alias("_listed"), F.col("posted_date").alias("index_posted"))
    named = reports.join(listed, "obs_id", "left").withColumn("name", F.coalesce("property_name", "_listed")).drop("_listed")
    return named.join(units.select(F.col("unit").alias("name"), "unit_id"), "name", "left")


def build_units(index: DataFrame, reports: DataFrame) -> DataFrame:
    """Units from the names in both sources, counted by distinct report and not by
    sighting; names equal but for case fold onto the spelling seen most.

    index: obs_id, name, town, seq; reports: obs_id, name.
    """
    both = index.select("obs_id", "name", "town", "seq").unionByName(
        reports.select("obs_id", "name", F.lit(None).cast("string").alias("town"), F.lit(None).cast("long").alias("seq")))
    named = both.withColumn("name", normalize_unit_name(F.col("name"))).where(F.col("name").isNotNull())
    town = F.nullif(F.btrim(F.regexp_replace("town", r"\s+", " "), F.lit(" .,-")), F.lit(""))
    named = named.withColumns({"town": town, "key": F.lower("name")})
    # one row per (name, report): sightings collapse before anything is counted
    once = named.groupBy("key", "name", "obs_id").agg(
        F.min(F.when(F.col("town").isNotNull(), F.struct("seq", "town"))).alias("t"))
    per_name = once.groupBy("key", "name").agg(F.count("*").alias("n"), F.min("t").alias("t"))
    best = per_name.groupBy("key").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("unit"),
                                       F.min("t").alias("t"))
    reports_per_key = once.select("key", "obs_id").dropDuplicates().groupBy("key").agg(F.count("*").alias("report_count"))
    return best.join(reports_per_key, "key").select("unit", F.col("t.town").alias("town"), "report_count")


def match_unit_page(pages: DataFrame, units: DataFrame, slugs: DataFrame) -> DataFrame:
    """Unit of each parsed page: exact slug, then published slug, then the tail of the
    title. Never a substring. pages: slug, name; slugs: name, slug."""
    named = units.select("unit", slugify(F.col("unit")).alias("s"), norm_title(F.col("unit")).alias("k"), F.lower("unit").alias("l"))
    first = lambda key, by: named.groupBy(F.col(by).alias(key)).agg(F.min("unit").alias(f"by_{key}"))
    published = slugs.select(norm_title(F.col("name")).alias("k"), F.col("slug").alias("known")).dropDuplicates() \
        .join(named.select("k", "unit"), "k").groupBy("known").agg(F.min("unit").alias("by_known"))
    tail = F.lower(F.trim(F.substring_index("name", ",", -1)))
    out = (pages.withColumn("tail", tail)
           .join(first("slug", "s"), "slug", "left")
           .join(published.withColumnRenamed("known", "slug"), "slug", "left")
           .join(first("tail", "l"), "tail", "left"))
    return out.select("slug", "name", F.coalesce("by_slug", "by_known", "by_tail").alias("unit"),
                      F.when(F.col("by_slug").isNotNull(), "slug").when(F.col("by_known").isNotNull(), "published")
                       .when(F.col("by_tail").isNotNull(), "title").otherwise("unmatched").alias("matched_by"))


def recount_units(units: DataFrame, obs: DataFrame) -> DataFrame:
    counts = obs.select("unit_id", "obs_id").dropDuplicates().groupBy("unit_id").agg(F.count("*").alias("report_count"))
    return units.drop("report_count").join(counts, "unit_id", "left").withColumn(
        "report_count", F.coalesce("report_count", F.lit(0)))


def merge_aliases(obs: DataFrame, conditions: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts re-keyed from variant to canonical; the canonical's own daily rows win,
    missing days are filled from its variants."""
    facts = alias_fold(obs, "unit", aliases)
    is_variant = aliases.select(F.col("variant").alias("unit")).dropDuplicates()
    own = conditions.join(is_variant, "unit", "left_anti")
    other = alias_fold(conditions.join(is_variant, "unit", "left_semi").withColumn("_from", F.col("unit")), "unit", aliases)
    rest = [c for c in conditions.columns if c not in ("unit", "obs_date")]
    moved = other.groupBy("unit", "obs_date").agg(F.min_by(F.struct(*rest), "_from").alias("r")).select("unit", "obs_date", "r.*")
    return facts, insert_or_ignore(own, moved.select(*conditions.columns), ["unit", "obs_date"])


def split_name_collisions(index: DataFrame, units: DataFrame, props: DataFrame, min_reports: int = MIN_SPLIT) -> DataFrame:
    """Plan for names that are several units: (unit, town, n, keeps, new_name).

    A name with two or more towns of enough reports is split; the town whose
    property lies nearest to the unit keeps the name. props: place, lat, lon.
    """
    towns = index.where(F.col("name").isNotNull() & (F.col("town") != "")).groupBy(F.col("name").alias("unit"), "town") \
        .agg(F.count("*").alias("n")).where(F.col("n") >= min_reports)
    several = towns.groupBy("unit").agg(F.count("*").alias("towns")).where(F.col("towns") >= 2)
    placed = towns.join(several.select("unit"), "unit", "left_semi").join(units.select("unit", "lat", "lon"), "unit")
    # a town's property: the first place starting with the town's name
    wanted = placed.select(F.lower("town").alias("t")).dropDuplicates()
    words = props.withColumn("w", F.split(F.lower("place"), " "))
    starts = words.select("place", F.col("lat").alias("plat"), F.col("lon").alias("plon"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", 1, i), " "))).alias("t"))
    hit = starts.join(wanted, "t", "left_semi").groupBy("t").agg(F.min_by(F.struct("plat", "plon"), "place").alias("p"))
    joined = placed.join(hit, F.lower("town") == F.col("t"), "left")
    away = F.coalesce(haversine_miles(F.col("lat"), F.col("lon"), F.col("p.plat"), F.col("p.plon")), F.lit(9e9))
    joined = joined.withColumn("miles", away)
    keep = joined.groupBy("unit").agg(F.min_by("town", F.struct("miles", "town")).alias("keep"))
    out = joined.join(keep, "unit")
    keeps = F.col("town") == F.col("keep")
    return out.select("unit", "town", "n", keeps.alias("keeps"), F.when(keeps, F.col("unit")).otherwise(
        F.concat("unit", F.lit(" ("), "town", F.lit(")"))).alias("new_name"),
        F.col("p.plat").alias("lat"), F.col("p.plon").alias("lon"))


def apply_name_split(obs: DataFrame, plan: DataFrame) -> DataFrame:
    """Facts (unit, town) moved onto the units of a split plan."""
    moves = plan.where(~F.col("keeps")).select("unit", "town", "new_name")
    return obs.join(moves, ["unit", "town"], "left").withColumn("unit", F.coalesce("new_name", "unit")).drop("new_name")


def build_trips(reports: DataFrame, index: DataFrame, units: DataFrame) -> DataFrame:
    """The fact table: unit, date and effort of each report, with measured hours.
    reports: obs_id, property_name, trip_date, posted_date, slot, count_total, max_weight."""
    from ..functions.dates import calendar_parts
    from .effort import calibrate_effort, restate_rates
    joined = trip_date_resolve(lookup_join(reports, index, units), "trip_date", "posted_date", "index_posted")
    facts = calendar_parts(joined.withColumn("unit_known", F.col("unit_id").isNotNull()), "obs_date")
    out = restate_rates(facts, calibrate_effort(facts))
    return out.select("obs_id", "unit_id", "unit_known", "obs_date", "year", "month", "season", "slot", "date_source",
                      "hours", "count_total", "rate", "max_weight")


def trip_stats(trips: DataFrame) -> DataFrame:
    return trips.agg(F.count("*").alias("total"), F.count_if("unit_known").alias("unit_known"),
                     F.count_if(F.col("date_source") == "reservation").alias("date_exact"),
                     F.count("count_total").alias("with_count"))
