"""Page parsing on the pages table, and on pages rendered from order, customer and
supplier rows so that the expected values are known columns."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import entities as N, markup as M, pages as P
from ..sources.tables import spread
from . import testbed as T
from .registry import query, r6
from .units import cols


def pages(spark, sf):
    return spread(T.table(spark, sf, "pages"))


@query("html_to_text", """
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<head[^>]*>.*?</head>', ' ', 'g'), '(?s)<script[^>]*>.*?</script>', ' ', 'g'), '(?s)<style[^>]*>.*?</style>', ' ', 'g') AS h FROM pages),
t AS (SELECT page_id, regexp_replace(h, '<[^>]+>', ' ', 'g') AS h FROM b)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(h, '&#x27;', ''''), '&quot;', '"'), '&nbsp;', ' '), '&lt;', '<'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM t""")
def html_to_text(spark, sf):
    return pages(spark, sf).select("page_id", H.html_to_text(F.col("html")).alias("text"))


@query("link_count", "SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\b')) AS links FROM pages")
def link_count(spark, sf):
    return pages(spark, sf).select("page_id", H.link_count(F.col("html")).alias("links"))


@query("narrative_join", """
c AS (SELECT page_id, list_transform(string_split_regex(html, '<p>')[2:], lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(split_part(x, '</p>', 1), '<[^>]+>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))) AS ps,
  list_transform(string_split_regex(html, '<p>')[2:], lambda x: regexp_matches(split_part(x, '</p>', 1), 'with|que')) AS bad FROM pages),
e AS (SELECT page_id, unnest(ps) AS p, unnest(bad) AS bad, unnest(range(0, len(ps))) AS i FROM c)
SELECT page_id, b AS body FROM pages LEFT JOIN (SELECT page_id, string_agg(p, chr(10) || chr(10) ORDER BY i) AS b FROM e WHERE NOT bad AND p <> '' GROUP BY page_id) USING (page_id)""")
def narrative_join(spark, sf):
    """Paragraphs naming one of two words stand in for the field block."""
    return pages(spark, sf).select("page_id", H.narrative_join(F.col("html"), ["with", "que"]).alias("body"))


@query("missing_stub_filter", """
SELECT page_id, length(html) AS n FROM pages WHERE NOT (NOT contains(html, '<h2') AND (contains(html, 'http') OR contains(html, '%%%')))""")
def missing_stub_filter(spark, sf):
    kept = P.missing_stub_filter(pages(spark, sf), ["http", "%%%"], "<h2")
    return kept.select("page_id", F.length("html").alias("n"))


# --- the given pages, each read once -------------------------------------------------------
_PLAIN = "regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"
_ENDS = "</?(?:p|article|footer|body|html|div|ul|nav|h1)(?:[ >])"


def _text(e: str) -> str:
    bare = f"regexp_replace({e}, '<[^>]+>', '', 'g')"
    for name, char in (("&#x27;", "''"), ("&quot;", '"'), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&middot;", "·"), ("&copy;", "©")):
        bare = f"replace({bare}, '{name}', '{char}')"
    bare = f"regexp_replace({bare}, '&amp;?', '&', 'g')"          # this one also counts where the text was cut before ';'
    return f"trim(regexp_replace({bare}, '[ \\t\\n\\x0b\\f\\r\\x{{a0}}]+', ' ', 'g'))"


@query("page_paragraphs", f"""
c AS (SELECT page_id, string_split_regex({_PLAIN}, '<p>')[2:] AS ps FROM pages),
e AS (SELECT page_id, i + 1 AS pos, string_split_regex(ps[i + 1], '{_ENDS}')[1] AS inner_html FROM c, unnest(range(0, len(ps))) AS t(i))
SELECT page_id, pos, {_text('inner_html')} AS text, inner_html LIKE '%<b>%' AS bold FROM e""")
def page_paragraphs(spark, sf):
    """Every paragraph, closed or not, with its text."""
    read = M.elements(pages(spark, sf).select("page_id", "html"), [], ["p"])
    return read.select("page_id", F.posexplode("nodes").alias("i", "n")).select(
        "page_id", (F.col("i") + 1).cast("long").alias("pos"), "n.text", F.col("n.inner").contains("<b>").alias("bold"))


@query("page_links", f"""
l AS (SELECT page_id, regexp_extract_all(h, '<a href="([^"]*)"', 1) AS hrefs, regexp_extract_all(h, '(?s)<a [^>]*>(.*?)</a>', 1) AS texts FROM (SELECT page_id, {_PLAIN} AS h FROM pages))
SELECT page_id, i + 1 AS pos, hrefs[i + 1] AS href, {_text('texts[i + 1]')} AS text FROM l, unnest(range(0, len(hrefs))) AS t(i)""")
def page_links(spark, sf):
    read = M.elements(pages(spark, sf).select("page_id", "html"), [], ["a"])
    return read.select("page_id", F.posexplode("nodes").alias("i", "n")).select(
        "page_id", (F.col("i") + 1).cast("long").alias("pos"), "n.href", "n.text")


@query("page_outline", f"""
h AS (SELECT page_id, html, {_PLAIN} AS h FROM pages)
SELECT page_id, {_text("regexp_extract(h, '(?s)<title>(.*?)</title>', 1)")} AS title, {_text("regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1)")} AS heading,
  {_text("regexp_extract(h, '(?s)<div class=.ad.>(.*?)</div>', 1)")} AS ad, {_text("regexp_extract(h, '(?s)<footer>(.*?)</footer>', 1)")} AS footer,
  len(regexp_extract_all(regexp_extract(h, '(?s)<nav>(.*?)</nav>', 1), '<a ')) AS nav_links, len(regexp_extract_all(regexp_extract(h, '(?s)<article>(.*?)</article>', 1), '<p>')) AS article_ps FROM h""")
def page_outline(spark, sf):
    """Title, heading, notice and footer, and what stands inside navigation and article."""
    read = M.elements(pages(spark, sf).select("page_id", "html"), ["nav", "article"], ["title", "h1", ".ad", "footer", "a", "p"])
    nodes = F.col("nodes")
    text = lambda **of: F.coalesce(M.first(M.having(nodes, **of))["text"], F.lit(""))
    boxes = read.withColumns({"nav": M.first(M.having(nodes, tag="nav")), "article": M.first(M.having(nodes, tag="article"))})
    inside = lambda tag, box: F.size(M.having(nodes, tag=tag, within=F.col(box))).cast("long")
    return boxes.select("page_id", text(tag="title").alias("title"), text(tag="h1").alias("heading"), text(of="ad").alias("ad"),
                        text(tag="footer").alias("footer"), inside("a", "nav").alias("nav_links"), inside("p", "article").alias("article_ps"))


# --- report pages rendered from orders ----------------------------------------------------
EXPECTED = """exp AS (SELECT o_orderkey AS page_id, 'Day ' || o_orderkey || ' & more' AS title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS posted_date, 'AUTHOR ' || o_custkey AS author, 'Fry' AS author_rank,
  2000 + o_custkey % 20 AS member_since, o_custkey % 90 AS post_count, CASE WHEN s THEN CAST(o_orderkey AS VARCHAR) END AS reservation_number, CASE WHEN s THEN 'Unit : ' || (o_custkey % 25) || ' -' END AS property_name,
  CASE WHEN s THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS trip_date, CASE WHEN s THEN CASE o_orderkey % 3 WHEN 0 THEN 'AM' WHEN 1 THEN 'PM' ELSE 'ALL_DAY' END END AS slot,
  CASE WHEN s THEN (o_custkey % 40) || ' LMB' END AS raw, CASE WHEN s THEN 'red widget; bolt' END AS label_raw, 'First ' || o_orderkey || '.' || chr(10) || chr(10) || 'Second linex' AS body,
  o_orderkey % 4 AS photo_count, CASE WHEN s THEN 'structured' ELSE 'legacy' END AS era FROM (SELECT *, o_orderstatus <> 'P' AS s FROM orders))"""


def report_pages(spark, sf):
    o = spread(T.table(spark, sf, "orders"))
    k, cust, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    slot = F.when(k % 3 == 0, "AM").when(k % 3 == 1, "PM").otherwise("All Day")
    fields = F.when(F.col("o_orderstatus") != "P", F.format_string(
        "<p>\n<strong>Reservation Number : </strong> %d<br />\n<strong>Property Name : </strong> Unit : %d -<br />\n<strong>Reservation Date : </strong> %s %s - <br />"
        "<strong>Total Fish/Sizes : </strong> %d LMB<br /><strong>Lures Used : </strong> red widget; bolt<br />\n</p>",
        k, cust % 25, F.date_format(day, "MM/dd/yyyy"), slot, cust % 40)).otherwise("")
    html = F.concat(F.format_string(
        '<html><head><title>x</title></head><body><h2 class="text-dark mb-5"> Day %d &amp; more </h2><div class="post_left text-left"><div class="user"><p>%s</p><h3>  AUTHOR %d\n  </h3>\n<p>Fry</p></div>'
        '<div class="user-meta d-flex"><img /><div><p>Member Since :<br> <em>%d</em> <br>\nNumber of Posts :<br /><em> %d</em></p></div></div></div><div class="post-right w-100"><div class="row"><div class="col">',
        k, F.date_format(day, "MMM dd yyyy"), cust, 2000 + cust % 20, cust % 90), fields,
        F.format_string('<p>First %d.</p>\n<p>Second line<b>x</b></p><div class="postedBy">Posted By: A</div></div></div></div><div class="report-gallery">', k),
        F.repeat(F.lit('<a href="x"><img/></a>'), (k % 4).cast("int")), F.lit('</div><p>Drop images here</p></body></html>'))
    stub = F.when(k % 11 == 0, "<html>A PHP Error was encountered</html>").otherwise(html)
    return o.select(k.alias("page_id"), html.alias("full_html"), stub.alias("html"), F.lit("report").alias("kind"),
                    F.lit(False).alias("is_missing"))


@query("parse_report_page", f"{EXPECTED} SELECT * FROM exp")
def parse_report_page(spark, sf):
    return P.parse_report_page(report_pages(spark, sf).select("page_id", F.col("full_html").alias("html")))


@query("build_reports", f"{EXPECTED} SELECT * REPLACE (CASE WHEN property_name IS NOT NULL THEN replace(replace(property_name, ' : ', ': '), ' -', '') END AS property_name) FROM exp WHERE page_id % 11 <> 0")
def build_reports(spark, sf):
    return P.build_reports(report_pages(spark, sf), N.normalize_unit_name)


@query("build_reports_counts", "SELECT count(*) FILTER (WHERE o_orderkey % 11 <> 0) AS kept, count(*) FILTER (WHERE o_orderkey % 11 = 0) AS skipped FROM orders")
def build_reports_counts(spark, sf):
    missing = P.is_missing(F.col("html"))
    return report_pages(spark, sf).agg(F.count_if(~missing).alias("kept"), F.count_if(missing).alias("skipped"))


@query("kv_fields", """SELECT o_orderkey AS page_id, 'Property Name' AS label, 'Unit : ' || (o_custkey % 25) || ' -' AS value FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, 'Total Fish/Sizes', (o_custkey % 40) || ' LMB' FROM orders WHERE o_orderstatus <> 'P'""")
def kv_fields(spark, sf):
    fields = H.kv_fields(F.col("full_html"), ["Property Name", "Total Fish/Sizes"])
    return report_pages(spark, sf).select("page_id", F.explode(fields).alias("label", "value"))


@query("numeric_meta", "SELECT o_orderkey AS page_id, 2000 + o_custkey % 20 AS first, o_custkey % 90 AS second, CAST(NULL AS BIGINT) AS third FROM orders")
def numeric_meta(spark, sf):
    ems = F.col("full_html")
    return report_pages(spark, sf).select("page_id", *[H.numeric_meta(ems, i).alias(n) for i, n in enumerate(("first", "second", "third"))])


@query("parse_posted_date", "SELECT o_orderkey AS obs_id, CASE WHEN o_orderkey % 5 < 3 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS posted FROM orders")
def parse_posted_date(spark, sf):
    """Three usable spellings, one impossible date, one text without a date."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = (F.when(k % 5 == 0, F.date_format(day, "MMM d yyyy")).when(k % 5 == 1, F.date_format(day, " MMM dd yyyy "))
            .when(k % 5 == 2, F.date_format(day, "MMM dd, yyyy")).when(k % 5 == 3, "Feb 31 2011").otherwise("no date at all"))
    return T.table(spark, sf, "orders").select(k.alias("obs_id"), H.parse_posted_date(text).alias("posted"))


@query("parse_card_date", "SELECT o_orderkey AS obs_id, CASE WHEN o_orderkey % 5 < 3 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS carded FROM orders")
def parse_card_date(spark, sf):
    k = F.col("o_orderkey")
    card = (F.when(k % 5 < 3, F.concat(F.lit("by A, "), F.date_format("o_orderdate", "MMM d, yyyy"), F.lit(" etc")))
            .when(k % 5 == 3, "on Abc 12, 2014").otherwise("x"))
    return T.table(spark, sf, "orders").select(k.alias("obs_id"), H.parse_card_date(card).alias("carded"))


@query("parse_reservation", """SELECT o_orderkey AS obs_id, CASE WHEN o_orderkey % 5 < 4 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day,
  CASE o_orderkey % 5 WHEN 0 THEN 'AM' WHEN 1 THEN 'PM' WHEN 2 THEN 'ALL_DAY' END AS slot FROM orders""")
def parse_reservation(spark, sf):
    k, date = F.col("o_orderkey"), F.date_format("o_orderdate", "MM/dd/yyyy")
    text = (F.when(k % 5 == 0, F.concat(date, F.lit(" AM -"))).when(k % 5 == 1, F.concat(date, F.lit(" pm")))
            .when(k % 5 == 2, F.concat(date, F.lit(" All  Day - "))).when(k % 5 == 3, date).otherwise("13/45/2026 AM"))
    day, slot = H.parse_reservation(text)
    return T.table(spark, sf, "orders").select(k.alias("obs_id"), day.alias("day"), slot.alias("slot"))


@query("split_on_last_comma", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'A: ' || c_name || ', x' WHEN 1 THEN c_name WHEN 2 THEN c_mktsegment END AS name,
  CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 2 THEN 'T' END AS town FROM customer""")
def split_on_last_comma(spark, sf):
    k = F.col("c_custkey")
    text = (F.when(k % 4 == 0, F.concat(F.lit("A: "), "c_name", F.lit(", x , "), "c_mktsegment")).when(k % 4 == 1, F.col("c_name"))
            .when(k % 4 == 2, F.concat("c_mktsegment", F.lit(" ,  T "))).otherwise("  "))
    name, town = H.split_on_last_comma(text)
    return T.table(spark, sf, "customer").select(k, name.alias("name"), town.alias("town"))


# --- listing pages: twelve cards on a page, a card per order -------------------------------------
def listing_pages(spark, sf):
    o = T.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    prop = F.when(k % 4 != 3, F.format_string("Property : Lake %d &amp; Co: East , Town %d<br>", k % 25, k % 9)).otherwise("")
    card = F.format_string(
        '<div class="divTableRow x"><div class="table-summary"><p><a class="t" href="/forums/view_report/%d">Report <b>%d</b></a><br>%s Started By : Author %d, %s</p></div>'
        '<div class="table-replies"><span>Replies :</span> %d</div><div class="table-views"><i>seen</i> %d </div></div>',
        k, k, prop, F.col("o_custkey"), F.date_format("o_orderdate", "MMM d, yyyy"), k % 13, k % 1000)
    cards = F.array_sort(F.collect_list(F.struct(k.alias("k"), card.alias("c"))))
    return o.groupBy(F.floor(k / 12).alias("page_id")).agg(
        F.concat(F.lit('<div class="divTable"><div class="head">x</div>'), F.array_join(F.transform(cards, lambda s: s["c"]), ""), F.lit("</div>")).alias("html"))


@query("parse_listing_cards", """
SELECT CAST(floor(o_orderkey / 12) AS BIGINT) AS page_id, o_orderkey AS report_id, 'Report ' || o_orderkey AS title, CASE WHEN o_orderkey % 4 <> 3 THEN 'Lake ' || (o_orderkey % 25) || ' & Co: East' END AS lake_name,
  CASE WHEN o_orderkey % 4 <> 3 THEN 'Town ' || (o_orderkey % 9) END AS lake_town, 'Author ' || o_custkey AS author, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS posted_date,
  o_orderkey % 13 AS replies, o_orderkey % 1000 AS views FROM orders""")
def parse_listing_cards(spark, sf):
    return P.parse_listing_cards(listing_pages(spark, sf)).drop("pos")


@query("labelled_int", "SELECT o_orderkey AS obs_id, CASE o_orderkey % 3 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey + 1 END AS value FROM orders")
def labelled_int(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = (F.when(k % 3 == 0, F.format_string("<span>Views : </span> %d extra 7 x", c))
            .when(k % 3 == 1, F.format_string("<b>seen</b> %d ", c + 1)).otherwise("none"))
    return T.table(spark, sf, "orders").select(k.alias("obs_id"), H.labelled_int(text, "Views").alias("value"))


@query("money_after", f"SELECT o_orderkey AS obs_id, {r6('CASE WHEN o_orderkey % 3 < 2 THEN 1000 + o_custkey % 900 + 100 + 0.5 END')} AS money FROM orders")
def money_after(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 900 + 100
    text = (F.when(k % 3 == 0, F.format_string("x Day Rate : $ 1,%d.50 and $9", c)).when(k % 3 == 1, F.format_string("DAY RATE is about $1,%d.50", c))
            .otherwise("Day Rate 3 for $5"))
    return T.table(spark, sf, "orders").select(k.alias("obs_id"), H.money_after(text, "Day Rate").alias("money"))


# --- unit pages: one per supplier -----------------------------------------------------------------
def unit_pages(spark, sf):
    k = F.col("s_suppkey")
    info = F.when(k % 7 != 6, "Property Info").otherwise("Nothing")
    bank = F.when(k % 3 == 0, "Bank fishing is available.").when(k % 3 == 1, "Bank fishing is not available.").otherwise("")
    html = F.format_string(
        "<html><script>var a = 9;</script><h1>Town %d, %s</h1><p>%s This lake covers %d.5 +/- acres with depths reaching %d-%d feet and pockets %d ft deep. Gold and Silver Members. "
        "Day Rate: $1,%d.50 Half-Day Rate $ %d.00 Boat Availability Jon&nbsp;boat Boat Launch none. %s Houston Area. Please harvest all under 14 inches. x</p>"
        "<div>Reservation Number 1 deep diving crank 99 feet deep, 500 acres</div></html>",
        k % 9, F.col("s_name"), info, 5 + k % 50, 6 + k % 30, 2 + k % 9, 4 + k % 40, 100 + k % 900, 10 + k % 90, bank)
    return T.table(spark, sf, "supplier").select(F.concat(F.lit("lake_"), k.cast("string")).alias("slug"), html.alias("html"))


@query("parse_unit_page", f"""
SELECT 'lake_' || s_suppkey AS slug, 'Town ' || (s_suppkey % 9) || ', ' || s_name AS name, {r6('5 + s_suppkey % 50 + 0.5')} AS acres, {r6('greatest(6 + s_suppkey % 30, 4 + s_suppkey % 40)')} AS max_depth_ft,
  'Gold and Silver Members' AS membership_tier, CAST(CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS BIGINT) AS bank_fishing, 'Jon boat' AS boat_type, {r6('1000 + 100 + s_suppkey % 900 + 0.5')} AS day_rate,
  {r6('10 + s_suppkey % 90')} AS half_day_rate, 'Houston Area' AS region, 'Please harvest all under 14 inches.' AS harvest_rules FROM supplier WHERE s_suppkey % 7 <> 6""")
def parse_unit_page(spark, sf):
    return P.parse_unit_page(unit_pages(spark, sf))


# --- markers ------------------------------------------------------------------------------------------
@query("json_marker_extract", f"""
m AS (SELECT c_custkey, CAST(floor(c_custkey / 50) AS BIGINT) AS page_id, CASE WHEN c_custkey % 10 < 7 THEN 'slug_' || (c_custkey % 400) END AS slug, c_name AS title, 24.0 + (c_custkey * 37 % 140) / 10.0 AS lat,
  -103.1::DOUBLE + (c_custkey * 53 % 96) / 10.0::DOUBLE AS lon, CASE WHEN c_custkey % 10 < 5 THEN 'Place ' || (c_custkey % 9) || ' Texas' END AS place FROM customer),
k AS (SELECT *, coalesce(slug, lower(title)) AS key FROM m WHERE lat BETWEEN 25.8 AND 37.1 AND lon BETWEEN -103.1 AND -93.5)
SELECT CAST(c_custkey AS VARCHAR) AS club_id, title, slug, {cols('lat', 'lon')}, place FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id, c_custkey) = 1""")
def json_marker_extract(spark, sf):
    k = F.col("c_custkey")
    link = F.when(k % 10 < 7, F.format_string('<a href=\\"/view-property/Slug_%d\\">x</a>', k % 400)).otherwise("")
    head = F.when(k % 10 < 5, F.format_string("<h4> Place %d  Texas</h4>", k % 9)).otherwise("")
    marker = F.format_string('{"id": "%d", "title": " %s ", "lat": "%s", "lon": "%s", "content": "%s%s"}', k, F.col("c_name"),
                             (24.0 + (k * 37 % 140) / 10.0).cast("string"), (-103.1 + (k * 53 % 96) / 10.0).cast("string"), head, link)
    docs = T.table(spark, sf, "customer").groupBy(F.floor(k / 50).alias("page_id")).agg(
        F.concat(F.lit("<script>var m = ["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), marker.alias("m")))), lambda s: s["m"]), ", "), F.lit("]</script>")).alias("html"))
    return P.json_marker_extract(docs)
