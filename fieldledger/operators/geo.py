"""Checking, choosing and propagating positions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.directions import gazetteer
from ..functions.geo import EARTH_MILES, angle_gap, bearing_deg, compass16, haversine_miles, miles_from_home, HOME_LAT, HOME_LON
from .entities import slugify
from .ingest import norm_title
from ..sources.tables import settle
from .ranking import topk_per_group

DISTANCE_TOLERANCE, MIN_TOLERANCE, TIME_TOLERANCE, BEARING_TOLERANCE = 0.45, 22.0, 0.55, 70.0
CLEAR_LEAD, SPREAD_MILES = 10.0, 25.0
# Centres of the published regions; region words ending a place text.
REGION_CENTRES = {"Dallas / Fort Worth Area": (32.78, -96.80), "Houston Area": (29.76, -95.37), "Austin Area": (30.27, -97.74),
                  "San Antonio Area": (29.42, -98.49), "Oklahoma Area": (35.47, -97.52), "East Texas": (32.35, -95.30),
                  "West Texas": (32.45, -99.73)}
REGION_WORDS = r"\s+(?:Dallas|Houston|Austin|San Antonio|Oklahoma|East|West)\b"
ANCHOR_CELL = 1 / 64          # degrees, about a mile


def geo_score(points: DataFrame, claims: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Worst disagreement of each position with its claims, in miles past tolerance.

    points: keys + lat, lon; claims: on + city, miles, bearing, from_time, where
    ``on`` is the part of the keys the claims are about.
    """
    known = claims.where(F.col("miles").isNotNull()).join(F.broadcast(gazetteer(points.sparkSession)), "city")
    pairs = points.join(known, on)
    actual = haversine_miles(F.col("city_lat"), F.col("city_lon"), F.col("lat"), F.col("lon"))
    heading = bearing_deg(F.col("city_lat"), F.col("city_lon"), F.col("lat"), F.col("lon"))
    share = F.when(F.col("from_time"), max(TIME_TOLERANCE, DISTANCE_TOLERANCE)).otherwise(DISTANCE_TOLERANCE)
    tolerance = F.greatest(F.lit(MIN_TOLERANCE), F.col("miles") * share)
    gap = F.greatest(F.lit(0.0), F.abs(actual - F.col("miles")) - tolerance)
    astray = angle_gap(heading, F.col("bearing")) > BEARING_TOLERANCE
    excess = F.when(astray, F.greatest(gap, actual * 0.5)).otherwise(gap)
    return pairs.withColumn("excess", excess).groupBy(*keys).agg(
        F.round(F.max("excess"), 1).alias("miss"), F.count("*").alias("claims"))


def geo_verify(units: DataFrame, claims: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Verdict per unit: ok, suspect, settled (suspect but confirmed), no claim."""
    scores = geo_score(units.select("unit", "lat", "lon"), claims, ["unit"], ["unit"])
    mine = confirmed.select("unit", F.lit(True).alias("confirmed"))
    out = units.join(scores, "unit", "left").join(mine, "unit", "left")
    settled = F.coalesce("confirmed", F.lit(False))
    verdict = (F.when(F.col("miss").isNull(), "no claim").when(F.col("miss") <= 0, "ok")
               .when(settled, "settled").otherwise("suspect"))
    return out.withColumns({"verdict": verdict, "confirmed": settled, "claims": F.coalesce("claims", F.lit(0))})


def verdict_counts(verified: DataFrame) -> DataFrame:
    return verified.groupBy("verdict").agg(F.count("*").alias("n"))


def geo_best_candidate(candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """The candidate the claims single out, where they do: a fitting best one and a
    clearly worse runner-up. candidates: unit, cand, lat, lon."""
    scored = geo_score(candidates, claims, ["unit", "cand", "lat", "lon"], ["unit"])
    two = topk_per_group(scored, ["unit"], [F.asc("miss"), F.asc("cand")], 2, rank="rank")
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c))).alias(c)
    out = two.groupBy("unit").agg(first("cand"), first("lat"), first("lon"), first("miss"), first("claims"),
                                  F.max(F.when(F.col("rank") == 2, F.col("miss"))).alias("runner_up"))
    clear = F.coalesce(F.col("runner_up") - F.col("miss") >= CLEAR_LEAD, F.lit(True))
    return out.where((F.col("miss") <= MIN_TOLERANCE) & clear)


def geo_pick_candidate(units: DataFrame, candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """One candidate per unit: by directions where they decide, else nearest to the
    published region, else the most populous, flagged when the choices lie far apart
    or the claims contradict it.

    units: unit, region_lat, region_lon; candidates: unit, cand, lat, lon,
    state_rank, population.
    """
    by_claims = geo_best_candidate(candidates, claims).select("unit", F.struct("cand", "lat", "lon", "miss").alias("d"))
    placed = candidates.join(units.select("unit", "region_lat", "region_lon"), "unit")
    has_region = F.col("region_lat").isNotNull()
    away = F.when(has_region, haversine_miles(F.col("region_lat"), F.col("region_lon"), F.col("lat"), F.col("lon")))
    order = F.struct("state_rank", F.when(has_region, away).otherwise(-F.coalesce("population", F.lit(0)).cast("double")).alias("second"), "cand")
    fallback = placed.groupBy("unit").agg(F.min_by(F.struct("cand", "lat", "lon"), order).alias("f"),
                                          F.count("*").alias("candidates"), F.first(has_region).alias("has_region"))
    spread = candidates.join(fallback, "unit").groupBy("unit").agg(F.max(haversine_miles(
        F.col("f.lat"), F.col("f.lon"), F.col("lat"), F.col("lon"))).alias("spread"))
    chosen = fallback.join(spread, "unit").join(by_claims, "unit", "left")
    point = chosen.select("unit", F.col("f.lat").alias("lat"), F.col("f.lon").alias("lon"))
    contradicted = geo_score(point, claims, ["unit"], ["unit"]).select("unit", F.col("miss").alias("f_miss"))
    joined = chosen.join(contradicted, "unit", "left")
    decided = F.col("d").isNotNull()
    wide = ~F.col("has_region") & (F.col("candidates") > 1) & (F.col("spread") > SPREAD_MILES)
    return joined.select(
        "unit", F.coalesce("d.cand", "f.cand").alias("cand"), F.coalesce("d.lat", "f.lat").alias("lat"),
        F.coalesce("d.lon", "f.lon").alias("lon"), "candidates",
        F.when(decided, "directions").when(F.col("has_region"), "region").otherwise("population").alias("source"),
        F.when(decided, F.col("d.miss")).otherwise(F.col("f_miss")).alias("miss"),
        F.when(decided, False).otherwise(wide | F.coalesce(F.col("f_miss") > 0, F.lit(False))).alias("uncertain"))


def settled_anchors(units: DataFrame) -> DataFrame:
    return units.where(F.col("lat").isNotNull() & ~F.col("geo_uncertain")).select("unit", "lat", "lon")


def nearest_anchor(points: DataFrame, anchors: DataFrame, keys: list[str], finest: float = ANCHOR_CELL,
                   levels: int = 6, fan: int = 4) -> DataFrame:
    """Exact distance of each point to its nearest anchor, without pairing all of them.

    Points and distinct anchor positions lie in pyramids of cells, each level `fan` times as wide as the one below; a
    cell knows the box around what it holds, and one of its anchors. Cells of points go down together, level by level,
    by equality of cells: the named anchors bound the distance from above for the whole box, and an anchor cell whose box
    is beyond the bound is left out with all that lies below it. Points that lie close share these steps; only what is
    left at the finest level is compared point by point with every anchor of the cell. Points without a position (null,
    NaN, infinite) and an empty set of anchors give no row.
    """
    lat, lon, far = F.col("lat"), F.col("lon"), F.lit(float("inf"))
    cell = lambda c: F.floor(F.col(c) / finest).cast("long")                                # noqa: E731
    has = lambda c: F.abs(F.col(c)) < far                                                   # noqa: E731
    spots = settle(anchors.where(has("lat") & has("lon")).select(lat.alias("alat"), lon.alias("alon")).dropDuplicates()
                   .select("*", cell("alat").alias("pa"), cell("alon").alias("po")))        # read by every level
    placed = settle(points.where(has("lat") & has("lon")).select(*keys, "lat", "lon", cell("lat").alias("qa"), cell("lon").alias("qo")))

    def boxes(rows: DataFrame, a: str, o: str, y: str, x: str, side: str) -> DataFrame:
        """Occupied cells of the finest level with the box around their positions, and one of these."""
        return settle(rows.groupBy(F.col(a).alias(f"{side}a"), F.col(o).alias(f"{side}o")).agg(
            F.min(y).alias(f"{side}s"), F.max(y).alias(f"{side}n"), F.min(x).alias(f"{side}w"), F.max(x).alias(f"{side}e"),
            F.min(F.struct(F.col(y).alias("y"), F.col(x).alias("x"))).alias(f"{side}rep")))

    def level(cells: DataFrame, k: int, side: str) -> DataFrame:
        """The cells of a level, and the cell above each."""
        up = lambda c, n: F.floor(F.col(c) / fan ** n).cast("long")                         # noqa: E731
        a, o, fold = f"{side}a", f"{side}o", [F.min(f"{side}s"), F.max(f"{side}n"), F.min(f"{side}w"), F.max(f"{side}e"), F.min(f"{side}rep")]
        out = cells if not k else cells.groupBy(up(a, k).alias(a), up(o, k).alias(o)).agg(
            *[f.alias(f"{side}{name}") for f, name in zip(fold, ("s", "n", "w", "e", "rep"))])
        return out.withColumns({f"{side}pa": up(a, 1), f"{side}po": up(o, 1)})

    mid_lat, mid_lon = (F.col("qs") + F.col("qn")) / 2, (F.col("qw") + F.col("qe")) / 2
    radius = EARTH_MILES * F.radians(F.sqrt(F.pow(F.col("qn") - F.col("qs"), F.lit(2)) + F.pow(F.col("qe") - F.col("qw"), F.lit(2))) / 2)
    at_most = haversine_miles(mid_lat, mid_lon, F.col("crep.y"), F.col("crep.x")) + radius
    north = F.greatest(F.col("cs") - F.col("qn"), F.col("qs") - F.col("cn"), F.lit(0.0))
    around_back = 360 - (F.greatest("ce", "qe") - F.least("cw", "qw"))
    east = F.greatest(F.least(F.greatest(F.col("cw") - F.col("qe"), F.col("qw") - F.col("ce")), around_back), F.lit(0.0))
    steepest = F.cos(F.radians(F.least(F.greatest(F.abs("qs"), F.abs("qn")), F.lit(90.0))))
    at_least = EARTH_MILES * F.greatest(F.radians(north), F.asin(steepest * F.sin(F.radians(F.least(east, F.lit(90.0))))))

    near_points, near_spots = boxes(placed, "qa", "qo", "lat", "lon", "q"), boxes(spots, "pa", "po", "alat", "alon", "c")
    top = finest * fan ** levels
    around = lambda reach: F.explode(F.sequence(F.lit(int(-reach // top)), F.lit(int(reach // top))))
    front = (level(near_points, levels - 1, "q").select("qpa", "qpo").dropDuplicates()
             .select("*", around(90).alias("cpa")).select("*", around(180).alias("cpo")))
    for k in range(levels - 1, -1, -1):
        met = (front.join(level(near_points, k, "q").drop("qrep"), ["qpa", "qpo"]).join(level(near_spots, k, "c"), ["cpa", "cpo"])
               .select("qa", "qo", "ca", "co", at_most.alias("most"), at_least.alias("least")))
        bound = F.min("most").over(Window.partitionBy("qa", "qo"))
        front = met.withColumn("bound", bound).where(F.col("least") <= F.col("bound") + 1e-3).select(
            F.col("qa").alias("qpa"), F.col("qo").alias("qpo"), F.col("ca").alias("cpa"), F.col("co").alias("cpo"))
    left = front.withColumnsRenamed({"qpa": "qa", "qpo": "qo", "cpa": "pa", "cpo": "po"}).join(spots, ["pa", "po"]).drop("pa", "po")
    return placed.join(left, ["qa", "qo"]).groupBy(*keys).agg(
        F.min(haversine_miles(lat, lon, F.col("alat"), F.col("alon"))).alias("near"))


def geo_rank_candidates(candidates: DataFrame, anchors: DataFrame, claims: DataFrame, regions: DataFrame) -> DataFrame:
    """Candidates of each unit in order of the strongest evidence at hand: its
    directions, else its region; then being a real town; then company and size.
    candidates: unit, cand, lat, lon, population; regions: unit, region_lat, region_lon."""
    near = nearest_anchor(candidates, anchors, ["unit", "cand"])
    scores = geo_score(candidates, claims, ["unit", "cand"], ["unit"]).select("unit", "cand", "miss")
    claimed = claims.select("unit").dropDuplicates().withColumn("has_claims", F.lit(True))
    out = (candidates.join(near, ["unit", "cand"], "left").join(scores, ["unit", "cand"], "left")
           .join(claimed, "unit", "left").join(regions.select("unit", "region_lat", "region_lon"), "unit", "left"))
    population = F.coalesce("population", F.lit(0))
    penalty = F.when(population > 50000, 12.0).when(population > 15000, 6.0).otherwise(0.0)
    by_claims, by_region = F.col("has_claims").isNotNull(), F.col("region_lat").isNotNull()
    region_miles = haversine_miles(F.col("region_lat"), F.col("region_lon"), F.col("lat"), F.col("lon"))
    key = F.struct(F.when(by_claims, 0).when(by_region, 1).otherwise(2).alias("a"),
                   F.when(by_claims, F.coalesce("miss", F.lit(0.0))).when(by_region, region_miles).otherwise(0.0).alias("b"),
                   F.when(population > 0, 0).otherwise(1).alias("c"),
                   (F.coalesce("near", F.lit(0.0)) + penalty).alias("d"), F.col("cand").alias("e"))
    basis = F.when(by_claims, "directions").when(by_region, "club region").otherwise("real town, then club cluster")
    rank = F.row_number().over(Window.partitionBy("unit").orderBy(key))
    return out.select("unit", "cand", "lat", "lon", "population", "near", basis.alias("basis"), rank.alias("rank"))


def describe_candidates(ranked: DataFrame) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    return ranked.withColumns({"miles": miles_from_home(lat, lon), "dir": compass16(bearing_deg(HOME_LAT, HOME_LON, lat, lon))})


def geo_pending(units: DataFrame) -> DataFrame:
    return units.where("geo_uncertain").orderBy(F.desc("reports"), "unit")


def geo_context(pending: DataFrame, obs: DataFrame, ranked: DataFrame, notes: DataFrame, top: int = 5) -> DataFrame:
    """Everything known about each unresolved unit: span, best candidates, notes."""
    span = obs.where(F.col("obs_date").isNotNull()).groupBy("unit").agg(F.min("obs_date").alias("first"), F.max("obs_date").alias("last"))
    best = describe_candidates(ranked.where(F.col("rank") <= top)).groupBy("unit").agg(
        F.array_sort(F.collect_list(F.struct("rank", "cand", "miles", "dir"))).alias("choices"), F.max("basis").alias("basis"))
    said = notes.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("rank", "sentence"))).alias("notes"))
    return (pending.join(span, "unit", "left").join(best, "unit", "left").join(said, "unit", "left"))


def sibling_propagate(verified: DataFrame, units: DataFrame) -> DataFrame:
    """Unresolved units take the position of a verified unit in the same town, the one
    with the most reports; tells how far each moved. verified: unit, town, lat, lon,
    reports, verdict."""
    town = F.lower(F.trim(F.coalesce("town", F.lit(""))))
    pinned = verified.where(F.col("verdict") == "ok").groupBy(town.alias("t")).agg(
        F.min_by(F.struct("lat", "lon"), F.struct(-F.col("reports"), "unit")).alias("p"))
    open_units = units.where(F.col("geo_uncertain") | F.col("lat").isNull()).withColumn("t", town)
    return open_units.join(pinned, "t").select(
        "unit", "town", "reports", F.col("p.lat").alias("new_lat"), F.col("p.lon").alias("new_lon"),
        haversine_miles(F.col("lat"), F.col("lon"), F.col("p.lat"), F.col("p.lon")).alias("moved"))


def geo_repair_targets(verified: DataFrame, after: DataFrame, min_miles: float = 5.0) -> DataFrame:
    """Suspect or uncertain units, and whether the new position moved them."""
    targets = verified.where((F.col("verdict") == "suspect") | F.col("geo_uncertain")).select("unit", "verdict", "lat", "lon")
    moved = targets.join(after.select("unit", F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon")), "unit", "left")
    miles = haversine_miles(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon"))
    return moved.select("unit", "verdict", miles.alias("miles"), F.coalesce(miles > min_miles, F.lit(False)).alias("moved"))


def club_town(place: Column) -> Column:
    """The town of a place text: trailing region words cut off."""
    return F.nullif(F.trim(F.get(F.split(F.trim(place), REGION_WORDS), F.lit(0))), F.lit(""))


def waypoint_match(props: DataFrame, units: DataFrame) -> DataFrame:
    """Surveyed points matched to units in stages, each on what the earlier ones left:
    slug, then a slug spelling out exactly one unclaimed name, then a title unique on
    both sides. What stays is ambiguous (some unit has the title) or unmatched.
    props: prop_id, title, slug, lat, lon, place; units: unit_id, unit, slug, lat, lon, reports."""
    by_slug = props.join(units.where(F.col("slug").isNotNull()).select("slug", "unit_id"), "slug") \
        .select("prop_id", "unit_id", F.lit("slug").alias("how"))
    named = units.select("unit_id", slugify(F.col("unit")).alias("slug"), norm_title(F.col("unit")).alias("title_key"))

    free = named.join(by_slug, "unit_id", "left_anti")
    left = props.join(by_slug, "prop_id", "left_anti")
    single = free.groupBy("slug").agg(F.min("unit_id").alias("unit_id"), F.count("*").alias("n")).where(F.col("n") == 1)
    by_name = left.join(single, "slug").select("prop_id", "unit_id", F.lit("name").alias("how"))

    free = free.join(by_name, "unit_id", "left_anti")
    left = left.join(by_name, "prop_id", "left_anti").withColumn("title_key", norm_title(F.col("title")))
    wanted = left.groupBy("title_key").agg(F.count("*").alias("wanted"))
    holders = free.groupBy("title_key").agg(F.min("unit_id").alias("unit_id"), F.count("*").alias("holders"))
    titled = left.join(wanted, "title_key").join(holders, "title_key", "left")
    unique = (F.col("wanted") == 1) & (F.col("holders") == 1)
    by_title = titled.select("prop_id", F.when(unique, F.col("unit_id")).alias("unit_id"),
                             F.when(unique, "title").when(F.col("holders") > 0, "ambiguous").otherwise("unmatched").alias("how"))
    pairs = by_slug.unionByName(by_name).unionByName(by_title)
    return pairs.join(props, "prop_id").join(
        units.select("unit_id", "unit", F.col("lat").alias("old_lat"), F.col("lon").alias("old_lon"), "reports"), "unit_id", "left") \
        .select("prop_id", "how", "unit_id", "unit", "lat", "lon", club_town(F.col("place")).alias("town"),
                haversine_miles(F.col("old_lat"), F.col("old_lon"), F.col("lat"), F.col("lon")).alias("moved"))


def coord_source(units: DataFrame, matched: DataFrame) -> DataFrame:
    """'waypoint' for surveyed units, 'inferred' for other placed ones."""
    surveyed = matched.where(F.col("how").isin("slug", "name", "title")).select("unit_id", F.lit(True).alias("s"))
    return units.join(surveyed, "unit_id", "left").withColumn(
        "coord_source", F.when(F.col("s"), "waypoint").when(F.col("lat").isNotNull(), "inferred")).drop("s")


def unit_facts(units: DataFrame) -> DataFrame:
    return units.withColumn("miles", F.round(miles_from_home(F.col("lat"), F.col("lon")), 0))
