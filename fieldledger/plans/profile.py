"""Profiles, briefs, plans and payload on the bound tables."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.dates import next_saturday
from ..operators import cohort as C, effects as E, ingest as I, narrate as W, profile as P, recommend as R, units as U
from ..session import ensure_checkpoint_dir
from ..sources.tables import settle
from . import effects as PE, testbed as T, text  # noqa: F401  (text registers the coverage section)
from .recommend import AS_OF_YEAR, DAY, MONTH, expected_sql, lift_sql
from .registry import ORACLES, QUERIES, query, r6
from .units import CONSISTENCY, HOME_MILES, cols


def unit_evidence(spark, sf):
    return settle(PE.evidence(spark, sf))


def profiles(spark, sf, frame=None, evidence=None):
    """The fact frame and the evidence feed many sections, so both are settled first."""
    frame = settle(T.frame(spark, sf)) if frame is None else frame
    evidence = unit_evidence(spark, sf) if evidence is None else evidence
    return P.profiles_all(frame, T.units(spark, sf), T.labels(spark, sf), T.tags(spark, sf), T.catches(spark, sf), evidence)


PROFILE_SQL = f"""{CONSISTENCY}, {lift_sql('scored', 'labs', 'category', 3, ['unit'])},
vol AS (SELECT unit, count(*) AS reports, count(rate) AS scored_n, median(rate) AS median FROM obs GROUP BY unit HAVING count(*) >= 8),
mon AS (SELECT unit, count(DISTINCT month) AS months FROM scored GROUP BY unit),
yr AS (SELECT unit, count(DISTINCT year) AS years FROM scored GROUP BY unit),
top AS (SELECT unit, category AS top_label FROM lifted QUALIFY row_number() OVER (PARTITION BY unit ORDER BY lower_rate / baseline DESC, category) = 1),
spc AS (SELECT unit, string_agg(species, ',' ORDER BY n DESC, species) AS species FROM (SELECT unit, species, sum(n) AS n FROM obs JOIN catches USING (obs_id) WHERE species <> 'unspecified' GROUP BY 1, 2) GROUP BY unit),
vg AS (SELECT unit, string_agg(value, ',' ORDER BY n DESC, value) AS veg FROM (SELECT unit, value, count(*) AS n FROM obs JOIN tags USING (obs_id) WHERE kind = 'vegetation' GROUP BY 1, 2) GROUP BY unit)"""


@query("profiles_all", f"""{PROFILE_SQL}
SELECT unit, reports, scored_n AS scored, {r6('median')} AS median, CAST(12 AS BIGINT) AS months, years, CAST(3 AS BIGINT) AS slots, top_label, species, veg, {r6('cv')} AS cv
FROM vol JOIN yr USING (unit) JOIN top USING (unit) JOIN spc USING (unit) JOIN vg USING (unit) LEFT JOIN (SELECT unit, cv FROM cons) USING (unit)""")
def profiles_all(spark, sf):
    """Key figures of the nested profiles, so that SQL can check them."""
    names = lambda c, f: F.array_join(F.transform(c, lambda s: s[f]), ",")
    return profiles(spark, sf).select(
        "unit", "reports", "scored", "median", F.size("by_month").alias("months"), F.size("by_year").alias("years"), F.size("by_slot").alias("slots"),
        F.get("labels", F.lit(0))["category"].alias("top_label"), names("species", "species").alias("species"), F.array_join("veg_top", ",").alias("veg"), "cv")


@query("slim_sections", f"""{PROFILE_SQL}, ev AS (SELECT * FROM (WITH {PE.EVIDENCE_SQL} SELECT unit, label FROM evidence))
SELECT unit, months, least(years, 8) AS years, (SELECT least(count(*), 8) FROM lifted l WHERE l.unit = vol.unit) AS labels, (SELECT least(count(*), 12) FROM ev WHERE ev.unit = vol.unit) AS evidence,
  CAST(3 AS BIGINT) AS species, CAST(6 AS BIGINT) AS veg FROM vol JOIN mon USING (unit) JOIN yr USING (unit)""")
def slim_sections(spark, sf):
    slim = P.slim_sections(profiles(spark, sf))
    return slim.select("unit", F.size("by_month").alias("months"), F.size("by_year").alias("years"), F.size("labels").alias("labels"),
                       F.size("evidence").alias("evidence"), F.size("species").alias("species"), F.size("veg_top").alias("veg"))


MONTH_SQL = "['January','February','March','April','May','June','July','August','September','October','November','December'][{m}]"
WHOLE = "CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def top_sql(name: str, kind: str, k: int) -> str:
    return f"""{name} AS (SELECT unit, list(replace(value, '_', ' ') ORDER BY n DESC, value) AS l FROM (SELECT unit, value, count(*) AS n FROM obs JOIN tags USING (obs_id) WHERE kind = '{kind}' GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY unit ORDER BY count(*) DESC, value) <= {k}) GROUP BY unit)"""


NARRATE_SQL = f"""{CONSISTENCY},
ev AS (SELECT * FROM (WITH {PE.EVIDENCE_SQL} SELECT unit, label, trips, diff, support FROM evidence)),
evl AS (SELECT unit, count(*) AS compared, list(replace(label, '_', ' ') || ' (' || CASE WHEN diff >= 0 THEN '+' ELSE '-' END || printf('%.2f', abs(diff)) || ' fish an hour over ' || trips || ' trips)' ORDER BY diff DESC) FILTER (WHERE support = 'backed') AS b,
  list(replace(label, '_', ' ') ORDER BY diff DESC) FILTER (WHERE support = 'below') AS w FROM ev GROUP BY unit),
lab_line AS (SELECT unit, CASE WHEN len(b) > 0 THEN 'Within matched strata, ' || array_to_string(b[1:2], ' and ') || CASE WHEN len(b) = 1 THEN ' leads.' ELSE ' lead.' END
   ELSE 'Within matched strata no label differs from the rest (' || compared || ' compared, all intervals include zero).' END
   || CASE WHEN len(w) > 0 THEN ' Trailing: ' || array_to_string(w[1:2], ', ') || '.' ELSE '' END AS label_line FROM evl),
med AS (SELECT unit, median(rate) AS md FROM scored GROUP BY unit),
rs AS (SELECT unit, md, 100.0 * (SELECT count(*) FROM med q WHERE q.md < med.md) / (SELECT count(*) FROM med) AS pct, (SELECT median(rate) FROM scored) AS cmd, (SELECT count(*) FROM scored z WHERE z.unit = med.unit) AS sc FROM med),
mm AS (SELECT unit, month, count(*) AS n, median(rate) AS md FROM scored GROUP BY unit, month HAVING count(*) >= 5 AND median(rate) > 0),
ma AS (SELECT mm.*, med.md AS overall, (n * mm.md + 8.0 * med.md) / (n + 8.0) AS adj FROM mm JOIN med USING (unit)),
mr AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY adj DESC, month) AS r, count(*) OVER (PARTITION BY unit) AS k FROM ma),
ml AS (SELECT unit, max(month) FILTER (WHERE r = 1) AS bm, max(md) FILTER (WHERE r = 1) AS bmd, max(n) FILTER (WHERE r = 1) AS bn, max(month) FILTER (WHERE r = k) AS wm, max(md) FILTER (WHERE r = k) AS wmd, max(n) FILTER (WHERE r = k) AS wn,
  list({MONTH_SQL.format(m='month')} ORDER BY r) FILTER (WHERE r IN (2, 3) AND adj > overall) AS runners FROM mr WHERE k >= 4 GROUP BY unit),
month_line AS (SELECT unit, 'Highest monthly median: ' || {MONTH_SQL.format(m='bm')} || ' — ' || round(bmd, 2) || ' per hour, n=' || bn || ' trips; lowest: ' || {MONTH_SQL.format(m='wm')} || ' at ' || round(wmd, 2) || ' over ' || wn || '.'
  || CASE WHEN len(runners) > 0 THEN ' ' || array_to_string(runners, ' and ') || CASE WHEN len(runners) > 1 THEN ' follow' ELSE ' follows' END || '.' ELSE '' END AS month_line FROM ml),
sp AS (SELECT unit, list(species ORDER BY n DESC, species) AS names, list(pct ORDER BY n DESC, species) AS pcts FROM (SELECT unit, species, sum(n) AS n, 100.0 * sum(n) / sum(sum(n)) OVER (PARTITION BY unit) AS pct
  FROM obs JOIN catches USING (obs_id) WHERE species <> 'unspecified' GROUP BY unit, species) GROUP BY unit),
wt AS (SELECT unit, max(max_weight) AS best, 100.0 * count(*) FILTER (WHERE max_weight >= 5) / count(max_weight) AS over5 FROM obs WHERE max_weight IS NOT NULL GROUP BY unit),
wa AS (SELECT unit, median(clarity_ft) AS cl, count(clarity_ft) AS cn, 100.0 * count(veg) / count(*) AS vr FROM obs LEFT JOIN (SELECT DISTINCT obs_id, 1 AS veg FROM tags WHERE kind = 'vegetation') USING (obs_id) GROUP BY unit),
{top_sql('tv', 'vegetation', 8)}, {top_sql('ts', 'structure', 10)}, {top_sql('tt', 'technique', 8)},
oth AS (SELECT unit, names, pcts, list_transform(list_filter([2, 3], lambda i: i <= len(names) AND pcts[i] >= 5), lambda i: replace(names[i], '_', ' ') || ' ' || {WHOLE.format(x='pcts[i]')} || '%') AS o FROM sp),
told AS (SELECT rs.unit, 'From ' || sc || ' trips scored, median rate ' || round(md, 2) || ' per hour; all units: ' || round(cmd, 2) || ', ranked '
    || CASE WHEN pct >= 80 THEN 'in the top fifth' WHEN pct >= 60 THEN 'in the second fifth' WHEN pct >= 40 THEN 'in the middle fifth' ELSE 'in the lower two fifths' END || '.' AS p1, month_line AS p2,
  concat_ws('; ', CASE WHEN typical_count > 0 THEN 'Median count per trip: ' || {WHOLE.format(x='typical_count')} || ' fish' END, CASE WHEN best > 0 THEN 'largest recorded weight ' || round(best, 1) || ' lb'
    || CASE WHEN over5 > 0 THEN ', and ' || {WHOLE.format(x='over5')} || '% of sized trips reach five pounds' ELSE '' END END) || '.'
    || CASE WHEN len(names) > 1 AND pcts[1] < 90 AND len(o) > 0 THEN ' Other species: ' || array_to_string(o, ' and ') || ' of identified fish.' ELSE '' END AS p3,
  'Water: ' || concat_ws('; ', CASE WHEN cl IS NOT NULL THEN 'median clarity ' || round(cl, 1) || ' ft (n=' || cn || ' reports)' END,
    CASE WHEN vr > 0 THEN 'plants named in ' || {WHOLE.format(x='vr')} || '% of reports, chiefly ' || tv.l[1] END) || '. Leading cover: ' || array_to_string(ts.l[1:3], ', ') || '.' AS p4,
  label_line AS p5, 'Most used presentations: ' || array_to_string(tt.l[1:3], ', ') || '.' AS p6,
  CASE WHEN sc < 30 THEN 'Small sample: ' || sc || ' trips scored; treat every figure as provisional.' END AS caveat
  FROM rs LEFT JOIN month_line USING (unit) LEFT JOIN cons USING (unit) LEFT JOIN wt USING (unit) LEFT JOIN oth USING (unit) LEFT JOIN wa USING (unit) LEFT JOIN tv USING (unit) LEFT JOIN ts USING (unit) LEFT JOIN tt USING (unit) LEFT JOIN lab_line USING (unit))"""


@query("narrate_unit", f"""{NARRATE_SQL} SELECT unit, concat_ws(chr(10), p1, p2, p3, p4, p5, p6) AS text, caveat FROM told""")
def narrate_unit(spark, sf):
    frame, evidence = settle(T.frame(spark, sf)), unit_evidence(spark, sf)
    ranking = W.month_ranking(U.rate_by_month(frame), U.rate_summary(frame))
    told = W.narrate_units(profiles(spark, sf, frame, evidence), W.month_sentence(ranking), W.label_line(evidence))
    return told.select("unit", F.array_join("paragraphs", "\n").alias("text"), "caveat")


@query("month_ranking", f"""
o AS (SELECT unit, median(rate) AS overall FROM scored GROUP BY unit),
m AS (SELECT unit, month, count(*) AS n, median(rate) AS md FROM scored GROUP BY unit, month HAVING count(*) >= 5 AND median(rate) > 0),
a AS (SELECT m.*, overall, (n * md + 8.0 * overall) / (n + 8.0) AS adj, count(*) OVER (PARTITION BY unit) AS k, row_number() OVER (PARTITION BY unit ORDER BY (n * md + 8.0 * overall) / (n + 8.0) DESC, month) AS r FROM m JOIN o USING (unit))
SELECT unit, max(month) FILTER (WHERE r = 1) AS best, max(month) FILTER (WHERE r = k) AS worst, count(*) FILTER (WHERE r IN (2, 3) AND adj > overall) AS runners FROM a WHERE k >= 4 GROUP BY unit""")
def month_ranking(spark, sf):
    obs = T.observations(spark, sf)
    out = W.month_ranking(U.rate_by_month(obs), U.rate_summary(obs))
    return out.select("unit", F.col("best.month").alias("best"), F.col("worst.month").alias("worst"), F.size("runners").alias("runners"))


CLUB_EVIDENCE = f"""{PE.effect_base_sql()}, {PE.usage_sql('use', 'flagged', [])}, {PE.effect_sql('pooled', 'flagged', [])}, {PE.years_sql('flagged', [])},
club_ev AS (SELECT *, {PE.support_sql('trips', 6, 12, 15)} AS support FROM (SELECT *, diff - 1.96 * se AS lo, diff + 1.96 * se AS hi
  FROM use JOIN pooled USING (label) LEFT JOIN years USING (label) WHERE scored_n >= 12 AND trips >= 60 AND other >= 4))"""


def club_evidence(spark, sf):
    m = PE.settled_label_moments(spark, sf, ["year"])
    wide = E.label_evidence(m, [])
    return wide.where(F.col("trips") >= 60)


@query("club_label_plan", f"""{CLUB_EVIDENCE}
SELECT side, rank, label, trips, {cols('diff', 'lo', 'hi')}, support FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY diff DESC, label) AS rank FROM (
  SELECT *, CASE WHEN support = 'backed' AND diff > 0 THEN 'use' WHEN support = 'below' THEN 'avoid' END AS side FROM club_ev)) WHERE side IS NOT NULL AND rank <= 3""")
def club_label_plan(spark, sf):
    return P.club_label_plan(club_evidence(spark, sf))


@query("presentation_plan", f"""
loc AS (SELECT * FROM (WITH {PE.UNIT_TAG_SQL} SELECT unit, label, diff AS here_diff, trips AS here_trips FROM unit_tag)),
{PE.TAG_SQL},
s AS (SELECT *, CASE support WHEN 'backed' THEN 'use' WHEN 'below' THEN 'avoid' WHEN 'unstable' THEN 'unstable' END AS side FROM tag_eff),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY diff DESC, label) AS rank FROM s WHERE side IS NOT NULL)
SELECT side, rank, label, trips, {cols('diff')}, unit, {cols('here_diff')}, here_trips FROM r LEFT JOIN loc USING (label)
WHERE (side = 'use' AND rank <= 3) OR (side = 'avoid' AND rank <= 2) OR side = 'unstable'""")
def presentation_plan(spark, sf):
    local = E.unit_tag_effects(settle(PE.tag_moments(spark, sf, ["unit"])), ["unit"])
    return P.presentation_plan(PE.tag_rows(spark, sf), local)


@query("unit_brief", f"""{expected_sql()}, {CONSISTENCY}
SELECT e.unit, day, CASE WHEN day = '{DAY}' THEN 'Saturday' ELSE 'Sunday' END AS weekday, 'July' AS month_name, {r6('expected')} AS expected, {r6('lower')} AS lower, basis, n, n_total,
  (SELECT least(count(*), 10) FROM scored s JOIN (SELECT DISTINCT obs_id, category FROM labs) USING (obs_id) WHERE s.unit = e.unit) AS citations, CAST(6 AS BIGINT) AS here
FROM expect e CROSS JOIN (VALUES ('{DAY}'), ('2001-07-15')) d(day)""")
def unit_brief(spark, sf):
    with T.shared_facts():
        briefs_df = briefs(spark, sf)
    return briefs_df.select("unit", "day", "weekday", "month_name", "expected", "lower", "basis", "n", "n_total",
                            F.size("citations").alias("citations"), F.size("here").alias("here"))


def briefs(spark, sf):
    obs = T.observations(spark, sf)
    labels = T.labels(spark, sf)
    sat = next_saturday(F.lit("2001-07-10").cast("date"))
    days = T.units(spark, sf).select("unit", F.explode(F.array(sat, F.date_add(sat, 1))).alias("day"))
    bust = U.bust_rate(obs).select("bust_rate").scalar()
    sentences = U.consistency_sentence(U.unit_consistency(obs), bust)
    named = T.units(spark, sf).select("unit_id", "unit")
    notes = R.condition_note(T.conditions(spark, sf)).join(named, "unit_id").select("unit", F.col("obs_date").alias("day"), "note")
    advice = C.band_advice(C.band_effects(PE.banded(spark, sf), labels), T.units(spark, sf))
    return P.unit_briefs(days, R.expected_rate(obs, MONTH, AS_OF_YEAR).where(F.col("expected").isNotNull()), sentences, notes, advice,
                         R.evidence_rows(obs, labels, ["unit"]), R.label_share(obs, labels))


@query("planner_payload", f"""{expected_sql()},
pl AS (SELECT u.unit, round({HOME_MILES.format(lat='u.lat', lon='u.lon')}, 1) AS miles, u.geo_uncertain, expected, lower, n_total FROM units u LEFT JOIN expect e ON e.unit = u.unit),
rk AS (SELECT unit, row_number() OVER (ORDER BY lower DESC, unit) AS rank FROM pl WHERE lower IS NOT NULL AND miles <= 400)
SELECT day, pl.unit, {r6('miles')} AS miles, geo_uncertain, {r6('expected')} AS expected, {r6('lower')} AS lower, n_total, CASE WHEN rank <= 12 THEN rank END AS rank
FROM pl LEFT JOIN rk ON rk.unit = pl.unit CROSS JOIN (VALUES ('{DAY}'), ('2001-07-15')) d(day)""")
def planner_payload(spark, sf):
    return P.planner_payload(T.observations(spark, sf), T.units(spark, sf), {DAY: MONTH, "2001-07-15": MONTH}, AS_OF_YEAR, 400)


# Sections of the published document: the query that gives the rows, its keys, and its columns by kind
# (s text, l whole number, d double, b boolean).
SECTIONS = {
    "headline": ("headline", [], "reports:l units:l scored:l first:s last:s scored_from:l scored_to:l median_rate:d best:d unit_known_pct:d"),
    "coverage": ("coverage_panel", ["tier"], "dimension:s pct:d n:l of:l tier:s"),
    "labels": ("label_lift", [], "category:s n_trips:l raw_rate:d median_rate:d shrunk_rate:d lower_rate:d lift:d lift_lb:d baseline:d scored_trips:l"),
    "evidence": ("label_evidence", ["unit"], "unit:s label:s trips:l share:d rate:d baseline:d diff:d lo:d hi:d naive_diff:d years:l years_agreeing:l stable:b club_unstable:b support:s"),
    "tags": ("tag_effects", ["support"], "label:s trips:l share:d rate:d baseline:d diff:d lo:d hi:d naive_diff:d years:l years_agreeing:l stable:b support:s"),
    "conditions": ("conditions_panel", ["unit", "condition"], "unit:s condition:s value:s n:l median:d"),
    "water": ("water_panel", ["unit"], "unit:s clarity_median:d clarity_n:l water_temp_median:d water_temp_n:l depth_median:d depth_n:l clarity_murky:l clarity_stained:l clarity_clear:l vegetation:l structure:l technique:l density_heavy:l density_moderate:l density_light:l veg_mention_rate:d"),
    "species": ("species_mix", ["unit"], "unit:s species:s n:l pct:d"),
    "lakes": ("unit_table", ["unit"], "unit:s town:s trips:l acres:d max_depth_ft:d day_rate:d median_rate:d best:d clarity:d"),
    "consistency": ("unit_consistency", ["unit"], "unit:s trips:l median:d mean:d worst_decile:d best_decile:d bust_rate:d bust_n:l typical_count:d cv:d band:s"),
    "months": ("rate_by_month", ["unit"], "unit:s month:l n:l median:d mean:d"),
    "years": ("by_year", ["unit"], "unit:s year:l n:l median:d mean:d"),
    "weights": ("weight_bands", ["unit"], "unit:s band:s n:l total:l best:d median_best:d over_5_rate:d pct:d"),
    "planner": ("planner_payload", ["unit"], "day:s unit:s miles:d geo_uncertain:b expected:d lower:d n_total:l rank:l"),
    "label_plan": ("club_label_plan", ["side"], "side:s rank:l label:s trips:l diff:d lo:d hi:d support:s"),
    "presentations": ("presentation_plan", ["side"], "side:s rank:l label:s trips:l diff:d unit:s here_diff:d here_trips:l"),
}
_AS_JSON = {"s": "to_json({c})", "l": "CAST({c} AS VARCHAR)", "b": "CAST({c} AS VARCHAR)",
            "d": r"regexp_replace(CAST(CAST({c} AS DECIMAL(18, 6)) AS VARCHAR), '\.?0*$', '')"}


def section_sql(name: str) -> str:
    source, keys, columns = SECTIONS[name]
    kinds = sorted(c.split(":") for c in columns.split())
    row = " || ',' || ".join(f"""'"{c}":' || coalesce({_AS_JSON[k].format(c=f'"{c}"')}, 'null')""" for c, k in kinds)
    key = f"concat_ws('|', {', '.join(keys)})" if keys else "''"
    return f"""SELECT '{name}' AS section, key, '[' || string_agg(r, ',' ORDER BY r) || ']' AS document
FROM (SELECT {key} AS key, '{{' || {row} || '}}' AS r FROM ({ORACLES[source]})) GROUP BY key"""


@query("payload_sink", "\nUNION ALL ".join(map(section_sql, SECTIONS)))
def payload_sink(spark, sf):
    """Every section written as documents, read back, and shown by content."""
    path = f"{ensure_checkpoint_dir(spark)}/published/{uuid.uuid4().hex}"
    with T.shared_facts():
        sections = {name: (QUERIES[source](spark, sf), keys) for name, (source, keys, _) in SECTIONS.items()}
    I.publish(sections, path)
    return I.published(spark, path).withColumn("document", F.to_json("document"))
