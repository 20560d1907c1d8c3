"""Text rules on reports written from order columns, and on the documents table."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X, vocabulary as V
from ..operators import phrases as P, rules, taxonomy as TX
from ..operators.dictionary import scan_forms
from ..sources.tables import settle, spread
from . import testbed as T
from .registry import query, r6
from .units import cols

# --- reports: one per order, phrased from its columns --------------------------------
REPORTS = r"""src AS (SELECT o_orderkey AS obs_id, o_custkey % 40 AS a, CAST(floor(o_totalprice) AS BIGINT) % 10 AS b, CAST(floor(o_totalprice / 10) AS BIGINT) % 10 AS c,
  o_orderkey % 8 AS t, CAST(floor(o_orderkey / 8) AS BIGINT) % 7 AS u, o_orderpriority AS pr, o_custkey FROM orders),
reports AS (SELECT obs_id, o_custkey,
 CASE t WHEN 0 THEN a || ' LMB - ' || b || '.' || c || ' lbs' WHEN 1 THEN a || '' WHEN 2 THEN a || '/1' || b || '-19"' WHEN 3 THEN a || ' under ' || b || '#'
  WHEN 4 THEN a || ': 2 huge crappie, ' || c || ' bass 2 -' || b || ' lbs, ' || a || ' LMB' WHEN 5 THEN a || ' Best Five ' || (a + 3) || ' lbs, biggest ' || b || '.5 lbs'
  WHEN 6 THEN CASE WHEN b < 5 THEN 'Fair number' ELSE ' lots of cats ' END ELSE '.' || b || c || 'lbs x ' || a || ', ' || b || 'lb bag. Largest ' || c || 'lbs' END AS raw,
 CASE u WHEN 0 THEN 'Water temp was ' || (30 + 2 * a) || ' degrees and visibility about ' || b || ' feet. Fished in ' || c || ' to 1' || b || ' feet of water near docks at dawn.'
  WHEN 1 THEN 'The lake was slightly stained near the dam. Tons of hydrilla and lily pads. We got skunked in the afternoon with bream around.'
  WHEN 2 THEN 'visibility to ' || a || '" and water was ' || (60 + b) || ' f. thick milfoil matted along the shoreline; punched it in the morning'
  WHEN 3 THEN b || ''' viz, crystal clear water. No fish after dark. We drove up from Tyler on highway ' || a || ' to get there. texas rig on the weed line'
  WHEN 4 THEN 'Around ' || a || ' ft on the points, then out to ' || b || '-' || c || 'ft. water at 1' || a || ' degrees. Some moss, no hydrilla. drop shot and wacky. Crappie too'
  WHEN 5 THEN pr || ' nothing to report' END AS body
 FROM src)"""


def reports(spark, sf):
    o = spread(T.table(spark, sf, "orders"))
    price = F.col("o_totalprice")
    src = o.select(F.col("o_orderkey").alias("obs_id"), "o_custkey", (F.col("o_custkey") % 40).alias("a"),
                   (F.floor(price) % 10).alias("b"), (F.floor(price / 10) % 10).alias("c"),
                   (F.col("o_orderkey") % 8).alias("t"), (F.floor(F.col("o_orderkey") / 8) % 7).alias("u"),
                   F.col("o_orderpriority").alias("pr"))
    fmt, a, b, c = F.format_string, F.col("a"), F.col("b"), F.col("c")
    t, u = F.col("t"), F.col("u")
    raw = (F.when(t == 0, fmt("%d LMB - %d.%d lbs", a, b, c)).when(t == 1, fmt("%d", a)).when(t == 2, fmt('%d/1%d-19"', a, b))
           .when(t == 3, fmt("%d under %d#", a, b)).when(t == 4, fmt("%d: 2 huge crappie, %d bass 2 -%d lbs, %d LMB", a, c, b, a))
           .when(t == 5, fmt("%d Best Five %d lbs, biggest %d.5 lbs", a, a + 3, b))
           .when(t == 6, F.when(b < 5, "Fair number").otherwise(" lots of cats "))
           .otherwise(fmt(".%d%dlbs x %d, %dlb bag. Largest %dlbs", b, c, a, b, c)))
    body = (F.when(u == 0, fmt("Water temp was %d degrees and visibility about %d feet. Fished in %d to 1%d feet of water near docks at dawn.", 30 + 2 * a, b, c, b))
            .when(u == 1, "The lake was slightly stained near the dam. Tons of hydrilla and lily pads. We got skunked in the afternoon with bream around.")
            .when(u == 2, fmt('visibility to %d" and water was %d f. thick milfoil matted along the shoreline; punched it in the morning', a, 60 + b))
            .when(u == 3, fmt("%d' viz, crystal clear water. No fish after dark. We drove up from Tyler on highway %d to get there. texas rig on the weed line", b, a))
            .when(u == 4, fmt("Around %d ft on the points, then out to %d-%dft. water at 1%d degrees. Some moss, no hydrilla. drop shot and wacky. Crappie too", a, b, c, a))
            .when(u == 5, fmt("%s nothing to report", F.col("pr"))))
    return src.select("obs_id", "o_custkey", raw.alias("raw"), body.alias("body"))


# --- the given documents, whole: every text is both the total as written and the body ---------
WRITTEN = "reports AS (SELECT doc_id AS obs_id, source, text AS raw, text AS body FROM documents)"


def written(spark, sf):
    return spread(T.table(spark, sf, "documents")).select(
        F.col("doc_id").alias("obs_id"), "source", F.col("text").alias("raw"), F.col("text").alias("body"))


def rule(name: str, sql: str):
    """Registers a rule over reports twice: on the reports of the orders, and as ``name_documents`` on
    the whole texts of the documents, with the same SQL over either table."""
    def register(fn):
        query(name, sql)(lambda spark, sf: fn(reports(spark, sf)))
        query(f"{name}_documents", sql.replace(REPORTS, WRITTEN))(lambda spark, sf: fn(written(spark, sf)))
        return fn
    return register


def q(pattern: str) -> str:
    """A pattern as a SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def dec(expr: str) -> str:
    d = f"replace({expr}, ',', '.')"
    return f"TRY_CAST(CASE WHEN starts_with({d}, '.') THEN '0' || {d} ELSE {d} END AS DOUBLE)"


CANON = "CASE " + " ".join(f"WHEN regexp_matches(tok, {q(f'^(?:{p})')}, 'i') THEN '{n}'" for n, p in V.SPECIES) + " END"
TOTALS = f"""{REPORTS},
pair AS (SELECT obs_id, {CANON} AS species, CAST(n AS BIGINT) AS n FROM (SELECT obs_id, unnest(regexp_extract_all(trim(raw), {q(V.COUNT_SPECIES)}, 1)) AS n,
   unnest(regexp_extract_all(trim(raw), {q(V.COUNT_SPECIES)}, 2)) AS tok FROM reports) WHERE CAST(n AS BIGINT) BETWEEN 1 AND 500),
sp AS (SELECT obs_id, species, CAST(sum(n) AS BIGINT) AS n FROM pair GROUP BY obs_id, species),
num AS (SELECT obs_id, list_filter(list_transform(regexp_extract_all(regexp_replace(trim(raw), {q(V.SIZE)}, '§', 'g'), {q(V.NUMBER)}) , lambda x: {dec('x')}),
   lambda v: v = floor(v) AND v BETWEEN 0 AND 500)[1] AS first FROM reports),
tot AS (SELECT r.*, CAST(coalesce(first, (SELECT sum(n) FROM sp WHERE sp.obs_id = r.obs_id)) AS BIGINT) AS total FROM reports r JOIN num USING (obs_id))"""


@rule("count_total", f"{TOTALS} SELECT obs_id, raw, total FROM tot")
def count_total(given):
    return rules.totals(given).select("obs_id", "raw", "total")


@rule("species_split", f"{TOTALS} SELECT obs_id, species, n FROM sp")
def species_split(given):
    return given.select("obs_id", F.explode(X.species_pairs(F.col("raw"))).alias("s")).select("obs_id", "s.*")


@rule("vague_flag", f"{TOTALS} SELECT obs_id, total IS NULL AND regexp_matches(raw, {q(V.VAGUE)}) AS vague FROM tot")
def vague_flag(given):
    return rules.totals(given).select("obs_id", "vague")


@rule("max_weight", f"""{REPORTS},
m AS (SELECT obs_id, regexp_split_to_array(trim(raw), {q(V.WEIGHT)}) AS p, regexp_extract_all(trim(raw), {q(V.WEIGHT)}, 0) AS h, regexp_extract_all(trim(raw), {q(V.WEIGHT)}, 1) AS g FROM reports),
e AS (SELECT obs_id, i, g[i] AS tok,
  right(array_to_string(list_transform(range(1, i), lambda j: p[j] || h[j]), '') || p[i], 16) AS lead,
  left(p[i + 1] || array_to_string(list_transform(range(i + 1, len(h) + 1), lambda j: h[j] || p[j + 1]), ''), 12) AS trail
  FROM m, unnest(range(1, len(h) + 1)) x(i)),
w AS (SELECT obs_id, max(v) AS max_weight FROM (SELECT *, {dec('tok')} AS v FROM e) WHERE v BETWEEN 0.1 AND 18.0
  AND (regexp_matches(lead, {q(V.SINGLE)}) OR NOT (regexp_matches(lead, {q(V.BAG)}) OR regexp_matches(trail, {q(V.BAG)}))) GROUP BY obs_id)
SELECT obs_id, {r6('max_weight')} AS max_weight FROM reports LEFT JOIN w USING (obs_id)""")
def max_weight(given):
    return given.select("obs_id", X.max_weight(F.col("raw")).alias("max_weight"))


@rule("max_length", f"""{REPORTS} SELECT obs_id, {r6(f"list_max(list_filter(list_transform(regexp_extract_all(trim(raw), {q(V.LENGTH)}, 1) , lambda x: {dec('x')}), lambda v: v BETWEEN 4 AND 40))")} AS max_length FROM reports""")
def max_length(given):
    return given.select("obs_id", X.max_length(F.col("raw")).alias("max_length"))


@rule("parse_decimal", f"""{REPORTS} SELECT obs_id, i, {r6(dec('tok'))} AS value FROM (SELECT obs_id, unnest(l) AS tok, unnest(range(0, len(l))) AS i FROM (
  SELECT obs_id, regexp_extract_all(raw, {q(V.NUMBER)}) AS l FROM reports))""")
def parse_decimal(given):
    return given.select("obs_id", F.posexplode(X.every(F.col("raw"), V.NUMBER)).alias("i", "tok")).select(
        "obs_id", "i", X.parse_decimal(F.col("tok")).alias("value"))


def first_mention(column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {q(p)}, 'i') THEN '{n}'" for n, p in V.SPECIES) + " END"


@rule("species_mentions", f"""{REPORTS},
h AS (SELECT obs_id, name, min(i) AS i FROM (SELECT obs_id, unnest([{", ".join(f"CASE WHEN regexp_matches(body, {q(p)}, 'i') THEN '{n}' END" for n, p in V.SPECIES)}]) AS name,
   unnest(range(0, {len(V.SPECIES)})) AS i FROM reports) WHERE name IS NOT NULL GROUP BY obs_id, name)
SELECT obs_id, string_agg(name, ',' ORDER BY i) AS names FROM h GROUP BY obs_id""")
def species_mentions(given):
    names = X.species_mentions(F.col("body"))
    return given.where(F.size(names) > 0).select("obs_id", F.array_join(names, ",").alias("names"))


@rule("catch_rows", f"""{TOTALS}
SELECT obs_id, species, n FROM sp UNION ALL
SELECT obs_id, coalesce({first_mention('raw')}, {first_mention('body')}, 'unspecified') AS species, total AS n FROM tot
WHERE total IS NOT NULL AND obs_id NOT IN (SELECT obs_id FROM sp)""")
def catch_rows(given):
    return rules.catch_rows(rules.totals(given)).select("obs_id", "species", "n")


# --- features ---------------------------------------------------------------------------
_UNIT_IN = V.INCH_UNIT.replace("(?i)", "")
CLARITY = "coalesce(" + ", ".join(
    f"CASE WHEN f{i} > 0 AND f{i} <= 30 THEN round(f{i}, 2) END" for i in (0, 1)) + ")"


def feet_sql(i: int) -> str:
    p = q(V.CLARITY_NUMBERS[i])
    v = f"TRY_CAST(regexp_extract(body, {p}, 1) AS DOUBLE)"
    return f"CASE WHEN regexp_matches(regexp_extract(body, {p}, 2), {q(_UNIT_IN)}, 'i') THEN {v} / 12.0::DOUBLE ELSE {v} END AS f{i}"


LABEL_CASE = "CASE " + " ".join(f"WHEN regexp_matches(body, {q(p)}) THEN '{n}'" for n, p in V.CLARITY_LABELS) + " END"
TEMP = "coalesce(" + ", ".join(
    f"CASE WHEN TRY_CAST(regexp_extract(body, {q(p)}, 1) AS DOUBLE) BETWEEN 32 AND 100 THEN TRY_CAST(regexp_extract(body, {q(p)}, 1) AS DOUBLE) END" for p in V.WATER_TEMP) + ")"
# RE2 has no look-ahead: blank the excluded form first.
BITE_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches({'regexp_replace(body, ' + q(chr(92) + 'bam' + chr(92) + 'b' + chr(92) + 's*-') + ', ' + q(' ') + ', ' + q('gi') + ')' if n == 'morning' else 'body'}, "
    f"{q(p.replace('(?!' + chr(92) + 's*-)', ''))}) THEN '{n}'" for n, p in V.BITE_WINDOW) + " END"


@rule("clarity_ft", f"{REPORTS}, f AS (SELECT obs_id, {feet_sql(0)}, {feet_sql(1)} FROM reports) SELECT obs_id, {r6(CLARITY)} AS clarity_ft FROM f")
def clarity_ft(given):
    return given.select("obs_id", X.clarity_ft(F.col("body")).alias("clarity_ft"))


@rule("clarity_label", f"{REPORTS} SELECT obs_id, {LABEL_CASE} AS clarity_label FROM reports")
def clarity_label(given):
    return given.select("obs_id", X.clarity_label(F.col("body")).alias("clarity_label"))


@rule("water_temp", f"{REPORTS} SELECT obs_id, {r6(TEMP)} AS water_temp_f FROM reports")
def water_temp(given):
    return given.select("obs_id", X.water_temp(F.col("body")).alias("water_temp_f"))


DEPTHS = f"""dp AS (SELECT obs_id, a, coalesce(b, a) AS b FROM (SELECT obs_id, TRY_CAST(unnest(regexp_extract_all(body, {q(V.DEPTH)}, 1)) AS DOUBLE) AS a,
  TRY_CAST(nullif(unnest(regexp_extract_all(body, {q(V.DEPTH)}, 2)), '') AS DOUBLE) AS b FROM reports)),
dr AS (SELECT obs_id, min(least(a, b)) AS lo, max(greatest(a, b)) AS hi FROM dp WHERE a > 0 AND a <= 60 AND b > 0 AND b <= 60 GROUP BY obs_id)"""


@rule("depth_range", f"{REPORTS}, {DEPTHS} SELECT obs_id, {cols('lo', 'hi')} FROM reports LEFT JOIN dr USING (obs_id)")
def depth_range(given):
    d = X.depth_range(F.col("body"))
    return given.select("obs_id", d["lo"].alias("lo"), d["hi"].alias("hi"))


@rule("bite_window", f"{REPORTS} SELECT obs_id, {BITE_CASE} AS bite FROM reports")
def bite_window(given):
    return given.select("obs_id", X.bite_window(F.col("body")).alias("bite"))


@rule("blank_flag", f"{TOTALS} SELECT obs_id, CAST(CASE WHEN total > 0 THEN 0 WHEN regexp_matches(body, {q(V.BLANK)}) THEN 1 END AS BIGINT) AS blank FROM tot")
def blank_flag(given):
    return rules.totals(given).select("obs_id", X.blank_flag(F.col("body"), F.col("total")).alias("blank"))


@rule("report_features", f"""{TOTALS}, f AS (SELECT obs_id, {feet_sql(0)}, {feet_sql(1)} FROM reports), {DEPTHS}
SELECT obs_id, {r6(CLARITY)} AS clarity_ft, {LABEL_CASE} AS clarity_label, {r6(TEMP)} AS water_temp_f, {r6('lo')} AS depth_min_ft, {r6('hi')} AS depth_max_ft,
  {BITE_CASE} AS bite_window, CAST(CASE WHEN total > 0 THEN 0 WHEN regexp_matches(body, {q(V.BLANK)}) THEN 1 END AS BIGINT) AS blank
FROM tot JOIN f USING (obs_id) LEFT JOIN dr USING (obs_id)""")
def report_features(given):
    return rules.features(rules.totals(given))


# --- tags ----------------------------------------------------------------------------------
def tags_sql(source: str, vocabulary: dict, dense: tuple) -> str:
    """CTE ``found_tags``: window around the first match taken from the text around it."""
    rows = []
    for kind, terms in vocabulary.items():
        for value, p in terms:
            rows.append(f"({q(kind)}, {q(value)}, {q('(?i)' + p)}, {str(kind in dense).upper()})")
    density = "CASE " + " ".join(f"WHEN regexp_matches(win, {q(p)}) THEN '{n}'" for n, p in V.DENSITY) + " END"
    return f"""voc(kind, value, rx, dense) AS (VALUES {', '.join(rows)}),
hit AS (SELECT obs_id, kind, value, dense, body, regexp_extract(body, rx) AS m, regexp_split_to_array(body, rx)[1] AS pre FROM {source} JOIN voc ON regexp_matches(body, rx)),
found_tags AS (SELECT obs_id, kind, value, CASE WHEN dense THEN {density} END AS detail FROM (
  SELECT *, right(pre, 60) || m || substr(body, length(pre) + length(m) + 1, 20) AS win FROM hit))"""


@query("vocab_tags", f"{REPORTS}, {tags_sql('reports', X.FISHING_VOCABULARY, ('vegetation',))} SELECT obs_id, kind, value, detail FROM found_tags")
def vocab_tags(spark, sf):
    return rules.tag_rows(reports(spark, sf))


DOC_VOCABULARY = {"cover": [("ion", "tion"), ("rule", "license|licen[cs]ed"), ("mail", r"[a-z0-9.]+@[a-z0-9.]+"), ("pipe", r"\|"), ("hand", "hand|band"), ("erle", "erle|elle")],
                  "mark": [("digits", r"[0-9]{4,}"), ("question", r"\?"), ("token", "token|secret|password")]}
_DOCS = "docs AS (SELECT doc_id AS obs_id, source AS unit, lang, text AS body FROM documents)"


def docs(spark, sf):
    return spread(T.table(spark, sf, "documents")).select(
        F.col("doc_id").alias("obs_id"), F.col("source").alias("unit"), "lang", F.col("text").alias("body"))


@query("vocab_tags_documents", f"{_DOCS}, {tags_sql('docs', DOC_VOCABULARY, ('cover',))} SELECT obs_id, kind, value, detail FROM found_tags")
def vocab_tags_documents(spark, sf):
    return rules.tag_rows(docs(spark, sf), DOC_VOCABULARY, ("cover",))


# --- labels from free text --------------------------------------------------------------------
PART_TAXONOMY = TX.Taxonomy.from_entries({
    "colors": ["red", "blue"],
    "techniques": [{"match": ["hot"], "name": "hot_dip", "implies": "metal"}, {"match": ["cold"], "name": "cold_roll"}],
    "terms": [{"match": ["widget", "small widget"], "category": "device", "subtype": "widget"},
              {"match": ["gizmo"], "category": "device", "subtype": "unspecified"},
              {"match": ["gear", "bolt"], "category": "hardware", "subtype": "fastener"},
              {"match": ["promo"], "category": "device", "subtype": "promo"}],
    "ambiguous": ["standard", "old", "new rod"]})
# Field: the part's name and type of a line, joined with a separator.
FIELDS = """fields AS (SELECT l_orderkey * 10 + l_linenumber AS obs_id, p_name || ' ; ' || p_type AS label_raw, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun, p_type, p_name
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, p_name, p_type FROM lineitem JOIN part ON l_partkey = p_partkey)),
cat AS (SELECT *, CASE noun WHEN 'widget' THEN 'device' WHEN 'gizmo' THEN 'device' WHEN 'gear' THEN 'hardware' WHEN 'bolt' THEN 'hardware' END AS c1,
  CASE noun WHEN 'widget' THEN 'widget' WHEN 'gizmo' THEN 'unspecified' WHEN 'gear' THEN 'fastener' WHEN 'bolt' THEN 'fastener' END AS s1,
  CASE WHEN adj IN ('red', 'blue') THEN adj END AS color FROM fields),
parts AS (
  SELECT obs_id, 0 AS pos, p_name AS part, CASE WHEN p_name = 'new rod' THEN 'ambiguous' WHEN c1 IS NOT NULL OR adj = 'hot' THEN 'hit' ELSE 'unknown' END AS kind,
    CASE WHEN p_name = 'new rod' THEN NULL WHEN c1 IS NOT NULL THEN c1 WHEN adj = 'hot' THEN 'metal' END AS category,
    CASE WHEN c1 IS NOT NULL THEN s1 WHEN adj = 'hot' THEN 'unspecified' END AS subtype, color,
    CASE adj WHEN 'hot' THEN 'hot_dip' WHEN 'cold' THEN 'cold_roll' ELSE '' END AS techniques FROM cat
  UNION ALL SELECT obs_id, 1, p_type, CASE p_type WHEN 'PROMO' THEN 'hit' WHEN 'STANDARD' THEN 'ambiguous' ELSE 'unknown' END,
    CASE p_type WHEN 'PROMO' THEN 'device' END, CASE p_type WHEN 'PROMO' THEN 'promo' END, NULL, '' FROM cat)"""


def label_fields(spark, sf):
    line, part = T.table(spark, sf, "lineitem"), T.table(spark, sf, "part")
    rows = line.join(part, line.l_partkey == part.p_partkey).select(
        "l_orderkey", "l_linenumber", "p_name", "p_type").dropDuplicates()
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obs_id"),
                       F.concat("p_name", F.lit(" ; "), "p_type").alias("label_raw"))


@query("label_parse_field", f"{FIELDS} SELECT obs_id, part, kind, category, subtype, CASE WHEN category IS NOT NULL THEN color END AS color, techniques FROM parts")
def label_parse_field(spark, sf):
    parsed = TX.label_parse_field(label_fields(spark, sf), PART_TAXONOMY)
    return parsed.select("obs_id", "part", "kind", F.array_join("techniques", ",").alias("techniques"),
                         F.explode_outer("hits").alias("h")).select(
        "obs_id", "part", "kind", "h.category", "h.subtype", "h.color", "techniques")


@query("review_queue", f"{FIELDS} SELECT part AS raw, count(*) AS n FROM parts WHERE kind = 'unknown' GROUP BY part")
def review_queue(spark, sf):
    return TX.review_queue(TX.label_parse_field(label_fields(spark, sf), PART_TAXONOMY))


@query("taxonomy_dim", """
SELECT form, category, subtype, length(form) AS length, count(*) AS n FROM (VALUES ('small widget', 'device', 'widget'), ('widget', 'device', 'widget'), ('gizmo', 'device', 'unspecified'),
  ('gear', 'hardware', 'fastener'), ('bolt', 'hardware', 'fastener'), ('promo', 'device', 'promo')) v(form, category, subtype)
JOIN part ON regexp_matches(lower(p_name || ' ' || p_type), '\\b' || replace(form, ' ', '[\\s-]*') || 's?\\b') GROUP BY ALL""")
def taxonomy_dim(spark, sf):
    """Surface forms with the number of parts whose text holds them."""
    forms = TX.taxonomy_dim(spark, PART_TAXONOMY).drop("seq")
    text = F.concat_ws(" ", "p_name", "p_type")
    present = F.array_compact(F.array(*[F.when(text.rlike(TX.phrase_pattern(f)), f) for f, _, _ in PART_TAXONOMY.terms]))
    counts = T.table(spark, sf, "part").select(F.explode(present).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    return forms.drop("pattern").join(counts, "form")


DOC_TAXONOMY = TX.Taxonomy.from_entries({
    "techniques": [{"match": ["apache license", "apache"], "name": "apache"}, {"match": ["public license"], "name": "gpl"}],
    "terms": [{"match": ["general public license", "license"], "category": "legal", "subtype": "license"},
              {"match": ["work"], "category": "legal", "subtype": "unspecified"},
              {"match": ["the of", "the and", "and the"], "category": "glue", "subtype": "pair"},
              {"match": ["token", "secret"], "category": "key", "subtype": "secret"}]})
NORM = ("trim(regexp_replace(regexp_replace(replace(lower(body), '&', ' and '), '[^a-z0-9\\s\"''.-]', ' ', 'g'), '\\s+', ' ', 'g'))")


@query("normalize_text", f"{_DOCS} SELECT obs_id, {NORM} AS norm FROM docs")
def normalize_text(spark, sf):
    return docs(spark, sf).select("obs_id", X.normalize_text(F.col("body")).alias("norm"))


@query("label_scan_text", f"""{_DOCS}, n AS (SELECT obs_id, {NORM} AS t FROM docs),
f(form, category, subtype) AS (VALUES ('general public license', 'legal', 'license'), ('license', 'legal', 'license'), ('work', 'legal', 'unspecified'), ('the of', 'glue', 'pair'),
  ('the and', 'glue', 'pair'), ('and the', 'glue', 'pair'), ('token', 'key', 'secret'), ('secret', 'key', 'secret')),
h AS (SELECT obs_id, category, subtype, form, length(form) AS len, regexp_extract(t, '(?i)\\b' || replace(form, ' ', '[\\s-]*') || 's?\\b') AS raw, row_number() OVER () AS x FROM n JOIN f
  ON regexp_matches(t, '(?i)\\b' || replace(form, ' ', '[\\s-]*') || 's?\\b'))
SELECT obs_id, category, subtype, raw FROM h QUALIFY row_number() OVER (PARTITION BY obs_id, category, subtype ORDER BY len DESC,
  CASE form WHEN 'the and' THEN 0 WHEN 'and the' THEN 1 ELSE 2 END) = 1""")
def label_scan_text(spark, sf):
    return TX.label_scan_text(docs(spark, sf), DOC_TAXONOMY).select("obs_id", "category", "subtype", "raw")


# Forms taken from the tables themselves: every part name, and the first words of every benchmark item.
_LARGE = f"""{_DOCS}, n AS (SELECT obs_id, {NORM} AS t FROM docs),
b AS (SELECT item_id, list_filter(string_split({NORM}, ' '), lambda w: regexp_full_match(w, '[a-z0-9]+')) AS w FROM (SELECT item_id, text AS body FROM benchmark)),
forms AS (SELECT form, category, subtype FROM (SELECT array_to_string(w[1:k], ' ') AS form, 'item' AS category, CAST(k AS VARCHAR) || ' words' AS subtype
    FROM b, (VALUES (2), (3), (4)) v(k) WHERE len(w) >= k UNION SELECT DISTINCT p_name, 'part', split_part(p_name, ' ', 2) FROM part) GROUP BY ALL)"""


def large_forms(spark, sf):
    words = F.filter(F.split(X.normalize_text(F.col("text")), " "), lambda w: w.rlike("^[a-z0-9]+$"))
    items = T.table(spark, sf, "benchmark").select(words.alias("w"), F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("k"))
    first = items.where(F.size("w") >= F.col("k")).select(
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("form"), F.lit("item").alias("category"),
        F.concat(F.col("k").cast("string"), F.lit(" words")).alias("subtype"))
    parts = T.table(spark, sf, "part").select(F.col("p_name").alias("form"), F.lit("part").alias("category"),
                                              F.split_part("p_name", F.lit(" "), F.lit(2)).alias("subtype"))
    return first.union(parts).distinct()


@query("label_scan_dictionary", f"""{_LARGE}
SELECT obs_id, category, subtype, max(length(form)) AS longest FROM n JOIN forms
  ON regexp_matches(t, '\\b' || replace(form, ' ', '[\\s-]*') || 's?\\b') GROUP BY obs_id, category, subtype""")
def label_scan_dictionary(spark, sf):
    """A dictionary that grows with the data: longer forms first, of equal ones the smaller."""
    forms = large_forms(spark, sf)
    ranked = forms.withColumn("rank", F.struct((-F.length("form")).alias("n"), F.col("form").alias("form")))
    found = scan_forms(docs(spark, sf), ranked)
    return found.select("obs_id", "category", "subtype", (-F.col("seq.n")).alias("longest"))


@query("scan_techniques", f"""{_DOCS}, n AS (SELECT obs_id, {NORM} AS t FROM docs)
SELECT obs_id, concat_ws(',', CASE WHEN regexp_matches(t, '\\bpublic[\\s-]*licenses?\\b') THEN 'gpl' END, CASE WHEN regexp_matches(t, '\\bapaches?\\b') THEN 'apache' END) AS techniques FROM n
WHERE regexp_matches(t, '\\bpublic[\\s-]*licenses?\\b|\\bapaches?\\b')""")
def scan_techniques(spark, sf):
    """A name is listed where its longest form stands in the taxonomy."""
    out = TX.scan_techniques(docs(spark, sf), DOC_TAXONOMY).where(F.size("techniques") > 0)
    return out.select("obs_id", F.array_join(F.array_sort("techniques", lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)), ",").alias("techniques"))


@query("label_dedupe", """
SELECT DISTINCT obs_id, category, subtype, color FROM labs l WHERE NOT (subtype = 'unspecified' AND EXISTS (
  SELECT 1 FROM labs m WHERE m.obs_id = l.obs_id AND m.category = l.category AND m.subtype <> 'unspecified'))""")
def label_dedupe(spark, sf):
    return TX.label_dedupe(T.labels(spark, sf)).select("obs_id", "category", "subtype", "color")


@query("label_merge_sources", """
SELECT obs_id, category, subtype, color, source FROM labs
QUALIFY row_number() OVER (PARTITION BY obs_id, category, subtype ORDER BY source, color) = 1""")
def label_merge_sources(spark, sf):
    hits = T.labels(spark, sf).withColumns({"seq": F.lit(0), "raw": F.col("color")})
    return TX.label_merge_sources(hits).select("obs_id", "category", "subtype", "color", "source")


@query("set_union_ordered", """
a AS (SELECT l_orderkey AS obs_id, l_returnflag AS v, min(l_linenumber) AS p FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
b AS (SELECT l_orderkey AS obs_id, l_returnflag AS v, 100 + min(l_linenumber) AS p FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
u AS (SELECT obs_id, v, min(p) AS p FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY obs_id, v)
SELECT obs_id, string_agg(v, ',' ORDER BY p, v) AS techniques FROM u GROUP BY obs_id""")
def set_union_ordered(spark, sf):
    line = T.table(spark, sf, "lineitem")

    def ordered(status, name):
        firsts = line.where(F.col("l_linestatus") == status).groupBy(F.col("l_orderkey").alias("obs_id"), F.col("l_returnflag").alias("v")) \
            .agg(F.min("l_linenumber").alias("p"))
        return firsts.groupBy("obs_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias(name))

    both = ordered("O", "a").join(ordered("F", "b"), "obs_id", "full")
    return both.select("obs_id", F.array_join(TX.ordered_union(F.col("a"), F.col("b")), ",").alias("techniques"))


# --- coverage --------------------------------------------------------------------------------
_COV_DIMS = ["fish_count", "label_any", "label_field", "label_field_matched", "narrative", "clarity", "water_temp", "depth",
             "bite_window", "vegetation", "structure", "technique"]
COVERAGE = f"""{TOTALS}, f AS (SELECT obs_id, {feet_sql(0)}, {feet_sql(1)} FROM reports), {DEPTHS}, {tags_sql('reports', X.FISHING_VOCABULARY, ('vegetation',))},
kinds AS (SELECT obs_id, bool_or(kind = 'vegetation') AS vegetation, bool_or(kind = 'structure') AS structure, bool_or(kind = 'technique') AS technique FROM found_tags GROUP BY obs_id),
lab_any AS (SELECT obs_id, TRUE AS label_any, bool_or(source = 'field') AS label_field, bool_or(source = 'field' AND subtype <> 'unspecified') AS label_field_matched FROM labs GROUP BY obs_id),
ex AS (SELECT tot.obs_id, total IS NOT NULL AS fish_count, coalesce(label_any, FALSE) AS label_any, coalesce(label_field, FALSE) AS label_field, coalesce(label_field_matched, FALSE) AS label_field_matched,
  body IS NOT NULL AS narrative, {CLARITY} IS NOT NULL OR {LABEL_CASE} IS NOT NULL AS clarity, {TEMP} IS NOT NULL AS water_temp, lo IS NOT NULL AS depth, {BITE_CASE} IS NOT NULL AS bite_window,
  coalesce(vegetation, FALSE) AS vegetation, coalesce(structure, FALSE) AS structure, coalesce(technique, FALSE) AS technique
  FROM tot JOIN f USING (obs_id) LEFT JOIN dr USING (obs_id) LEFT JOIN kinds USING (obs_id) LEFT JOIN lab_any USING (obs_id)),
rows_ AS (SELECT 'unit' AS dimension, count(*) FILTER (WHERE unit_id IS NOT NULL) AS n_with, count(*) AS n_total FROM obs
  UNION ALL SELECT 'trip_date_exact', count(*) FILTER (WHERE date_source = 'reservation'), count(*) FROM obs
  UNION ALL SELECT 'trip_date_estimated', count(*) FILTER (WHERE date_source = 'posted_estimate'), count(*) FROM obs
  {" ".join(f"UNION ALL SELECT '{d}', count(*) FILTER (WHERE {d}), {'count(*) FILTER (WHERE label_field)' if d == 'label_field_matched' else 'count(*)'} FROM ex" for d in _COV_DIMS)}),
coverage AS (SELECT *, round(100.0::DOUBLE * n_with / n_total, 1) AS pct, CASE WHEN dimension IN ('unit', 'trip_date_exact', 'trip_date_estimated', 'fish_count', 'label_any', 'label_field_matched') THEN 'full' ELSE 'partial' END AS tier FROM rows_)"""


def coverage(spark, sf):
    trips = T.observations(spark, sf).select((F.col("unit_id").isNotNull()).alias("unit_known"), "date_source")
    totals = rules.totals(reports(spark, sf))
    tags = X.vocab_tags(F.col("body"), X.FISHING_VOCABULARY, dense=())
    has = lambda kind: F.coalesce(F.exists("tags", lambda t: t["kind"] == kind), F.lit(False)).alias(kind)
    labs = T.labels(spark, sf).groupBy("obs_id").agg(
        F.bool_or(F.col("source") == "field").alias("label_field"),
        F.bool_or((F.col("source") == "field") & (F.col("subtype") != "unspecified")).alias("label_field_matched"))
    body = F.col("body")
    flags = totals.withColumn("tags", tags).join(labs, "obs_id", "left").select(
        F.col("total").isNotNull().alias("fish_count"), F.col("label_field").isNotNull().alias("label_any"),
        F.coalesce("label_field", F.lit(False)).alias("label_field"), F.coalesce("label_field_matched", F.lit(False)).alias("label_field_matched"),
        body.isNotNull().alias("narrative"), (X.clarity_ft(body).isNotNull() | X.clarity_label(body).isNotNull()).alias("clarity"),
        X.water_temp(body).isNotNull().alias("water_temp"), X.depth_range(body)["lo"].isNotNull().alias("depth"),
        X.bite_window(body).isNotNull().alias("bite_window"), has("vegetation"), has("structure"), has("technique"))
    return rules.coverage_stats(trips, flags)


@query("coverage_stats", f"{COVERAGE} SELECT dimension, n_with, n_total, {cols('pct')}, tier FROM coverage")
def coverage_stats(spark, sf):
    return coverage(spark, sf).orderBy(F.desc("tier"), F.desc("pct"))


# Reader-facing names of the coverage dimensions.
COVERAGE_NAMES = {
    "unit": "unit known", "fish_count": "total parsed", "label_any": "any label",
    "label_field_matched": "label field resolved", "trip_date_exact": "date from reservation",
    "trip_date_estimated": "date from posting day", "narrative": "body text",
    "clarity": "clarity", "water_temp": "temperature", "depth": "depth range",
    "bite_window": "part of day", "vegetation": "plants", "structure": "cover", "technique": "presentation"}


@query("coverage_panel", f"""{COVERAGE}
SELECT name AS dimension, {cols('pct')}, n_with AS n, n_total AS of, tier FROM coverage JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in COVERAGE_NAMES.items())}) d(k, name) ON k = dimension""")
def coverage_panel(spark, sf):
    names = spark.createDataFrame(list(COVERAGE_NAMES.items()), "dimension string, name string")
    return coverage(spark, sf).join(names, "dimension").select(
        F.col("name").alias("dimension"), "pct", F.col("n_with").alias("n"), F.col("n_total").alias("of"), "tier")


# --- phrases -----------------------------------------------------------------------------------
STOP = ["the", "and", "of", "to", "that", "for", "was", "with", "are", "this", "from", "les", "des", "que"]
PHRASES = f"""{_DOCS},
blk AS (SELECT DISTINCT token FROM (SELECT unnest(string_split_regex(lower(lang || ' ' || unit || ' ' || s_name || ' reEr onTion'), '[^a-z'']+')) AS token FROM docs CROSS JOIN (SELECT min(s_name) AS s_name FROM supplier)
   UNION ALL SELECT unnest(string_split_regex('re er on tion', '[^a-z'']+'))) WHERE length(token) > 2),
wl AS (SELECT obs_id, unit, string_split_regex(trim(regexp_replace(lower(body), '[^a-z0-9'']+', ' ', 'g')), ' ') AS w FROM docs),
tok AS (SELECT obs_id, unit, pos, token FROM (SELECT obs_id, unit, unnest(w) AS token, unnest(range(0, len(w))) AS pos FROM wl)
  WHERE length(token) > 2 AND NOT regexp_matches(token, '[0-9]') AND token NOT IN ({', '.join(q(w) for w in STOP)}) AND token NOT IN (SELECT token FROM blk)),
ph AS (SELECT DISTINCT obs_id, unit, phrase FROM (SELECT obs_id, unit, token AS phrase FROM tok UNION ALL
  SELECT obs_id, unit, token || ' ' || nxt FROM (SELECT *, lead(token) OVER (PARTITION BY obs_id ORDER BY pos) AS nxt FROM tok) WHERE nxt IS NOT NULL)),
idx AS (SELECT unit, phrase, count(*) AS df FROM ph GROUP BY unit, phrase)"""


def blocked(spark, sf):
    supplier = T.table(spark, sf, "supplier").agg(F.min("s_name")).scalar()
    names = docs(spark, sf).select(F.concat_ws(" ", "lang", "unit", supplier, F.lit("reEr onTion")).alias("name"))
    return P.blocked_tokens(names, ["name"])


def words(spark, sf):
    return P.kept_words(docs(spark, sf), STOP, blocked(spark, sf))


@query("blocked_tokens", f"{PHRASES} SELECT token FROM blk")
def blocked_tokens(spark, sf):
    return blocked(spark, sf)


@query("phrase_tokens", f"{PHRASES} SELECT token, count(*) AS n, count(DISTINCT obs_id) AS docs FROM tok GROUP BY token")
def phrase_tokens(spark, sf):
    return P.phrase_tokens(words(spark, sf))


@query("phrase_sets", f"{PHRASES} SELECT obs_id, count(*) AS phrases, min(phrase) AS first, max(phrase) AS last FROM ph GROUP BY obs_id")
def phrase_sets(spark, sf):
    return P.phrase_sets(words(spark, sf)).where(F.size("phrases") > 0).select(
        "obs_id", F.size("phrases").alias("phrases"), F.array_min("phrases").alias("first"), F.array_max("phrases").alias("last"))


@query("mention_index", f"{PHRASES} SELECT unit, phrase, df FROM idx")
def mention_index(spark, sf):
    return P.mention_index(P.phrase_sets(words(spark, sf)))


DISTINCTIVE = f"""{PHRASES},
sz AS (SELECT unit, count(*) AS n FROM docs GROUP BY unit), club AS (SELECT phrase, sum(df) AS c FROM idx GROUP BY phrase),
sc AS (SELECT unit, phrase, df, n, ln(((df + 0.5) / (n + 1)) / ((c + 0.5) / ((SELECT count(*) FROM docs) + 1))) AS lift FROM idx JOIN sz USING (unit) JOIN club USING (phrase)
  WHERE df >= {{min_df}} AND df * 1.0 / n >= 0.04)"""


def distinctive(spark, sf, min_df=6, min_lift=0.35):
    return P.distinctive_phrases(settle(P.phrase_sets(words(spark, sf))), min_df=min_df, min_lift=min_lift)


@query("distinctive_phrases", f"""{DISTINCTIVE.format(min_df=4)}
SELECT unit, phrase, df AS reports, n AS of, {r6('100.0 * df / n')} AS share, {r6('exp(lift)')} AS times_club, {r6('lift * ln(1 + df)')} AS score FROM sc WHERE lift > 0.2""")
def distinctive_phrases(spark, sf):
    """Gates a little lower than the defaults, since a source holds few documents here."""
    return distinctive(spark, sf, min_df=4, min_lift=0.2)


STEM = ("array_to_string(list_transform(string_split(phrase, ' '), lambda w: CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y'"
        " WHEN regexp_matches(w, '[sxzh]es$') AND length(w) > 4 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND NOT w LIKE '%ss' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END), ' ')")


@query("phrase_greedy_dedupe", f"""{DISTINCTIVE.format(min_df=4)},
li AS (SELECT unit, list([phrase || '|' || {STEM}] ORDER BY round(lift * ln(1 + df), 9) DESC, phrase) AS items FROM sc WHERE lift > 0.2 GROUP BY unit),
kept AS (SELECT unit, list_reduce(items, lambda acc, x: CASE WHEN len(acc) >= 10 OR len(list_filter(acc, lambda k: contains(split_part(k, '|', 1), split_part(x[1], '|', 1))
  OR contains(split_part(x[1], '|', 1), split_part(k, '|', 1)) OR split_part(k, '|', 2) = split_part(x[1], '|', 2))) > 0 THEN acc ELSE list_concat(acc, x) END) AS l FROM li)
SELECT unit, i AS rank, split_part(l[i], '|', 1) AS phrase FROM kept, unnest(range(1, len(l) + 1)) t(i)""")
def phrase_greedy_dedupe(spark, sf):
    return P.phrase_greedy_dedupe(distinctive(spark, sf, min_df=4, min_lift=0.2))


@query("stem_phrase", """
w AS (SELECT p_partkey, unnest(string_split(p_name || 's ' || lower(p_brand) || 'ies ' || lower(p_type) || 'xes glass', ' ')) AS w, unnest([0, 1, 2, 3, 4]) AS i FROM part),
s AS (SELECT p_partkey, i, CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN regexp_matches(w, '[sxzh]es$') AND length(w) > 4 THEN left(w, length(w) - 2)
  WHEN w LIKE '%s' AND NOT w LIKE '%ss' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END AS t FROM w)
SELECT p_partkey, string_agg(t, ' ' ORDER BY i) AS stem FROM s GROUP BY p_partkey""")
def stem_phrase(spark, sf):
    phrase = F.concat("p_name", F.lit("s "), F.lower("p_brand"), F.lit("ies "), F.lower("p_type"), F.lit("xes glass"))
    return T.table(spark, sf, "part").select("p_partkey", X.stem_phrase(phrase).alias("stem"))


@query("publish_guard", f"""{DISTINCTIVE.format(min_df=4)}
SELECT count(*) AS leaked FROM (SELECT DISTINCT unnest(string_split_regex(lower(phrase), '[^a-z'']+')) AS token FROM sc WHERE lift > 0.2) WHERE token IN (SELECT token FROM blk)""")
def publish_guard(spark, sf):
    leaked = P.publish_guard(distinctive(spark, sf, 4, 0.2), "phrase", blocked(spark, sf))
    return leaked.agg(F.count("*").alias("leaked"))


# --- snippets ---------------------------------------------------------------------------------
def snippets_sql(unit: str, useful: str = V.USEFUL, noise: str = V.NOISE) -> str:
    return f"""{REPORTS},
sn AS (SELECT {unit} AS unit, obs_id, unnest(l) AS s, unnest(range(0, len(l))) AS pos FROM (
  SELECT *, list_transform(regexp_extract_all(body, {q(V.SENTENCE)}) , lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS l FROM reports)),
k AS (SELECT unit, s, min((obs_id, pos)) AS seen FROM sn WHERE length(s) >= 30 AND NOT regexp_matches(s, {q(noise)}) AND regexp_matches(s, {q(useful)}) GROUP BY unit, s),
rk AS (SELECT unit, s AS sentence, row_number() OVER (PARTITION BY unit ORDER BY seen) AS rank FROM k) SELECT unit, rank, sentence FROM rk WHERE rank <= 4"""


_TELLING, _IDLE = r"[ ,](?:license|password|that the|dans)[ ,.]", r"[0-9]{4}|[|]"


@query("snippets_documents", snippets_sql("source", _TELLING, _IDLE).replace(REPORTS, WRITTEN))
def snippets_documents(spark, sf):
    return rules.snippets(written(spark, sf), unit="source", useful=_TELLING, noise=_IDLE)


@query("snippets", snippets_sql("CAST(o_custkey % 25 AS VARCHAR)"))
def snippets(spark, sf):
    rows = reports(spark, sf).withColumn("unit", (F.col("o_custkey") % 25).cast("string"))
    return rules.snippets(rows)
