"""Cached pages to typed rows. Each page is read once into its elements; every field is
a column expression on them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html as H
from . import markup as M

# Signs of an absent page served with a success status, and the block that
# every report has; labels of the field block.
MISSING_MARKERS = ["A PHP Error was encountered", "Attempt to read property"]
REPORT_BLOCK = H.class_open("post-right")
FIELD_LABELS = ["Reservation Number", "Property Name", "Reservation Date", "Total Fish/Sizes", "Lures Used"]
LAT_RANGE, LON_RANGE = (25.8, 37.1), (-103.1, -93.5)
MARKER = r'\{[^{}]*"lat"\s*:\s*"-?\d[\d.]*"[^{}]*\}'


def page_scan(pages: DataFrame, kind: str, include_missing: bool = False) -> DataFrame:
    """Pages of one kind. On a table partitioned by kind the filter prunes folders."""
    out = pages.where(F.col("kind") == kind)
    return out if include_missing else out.where(~F.col("is_missing") & F.col("html").isNotNull())


def is_missing(doc: Column, markers: list[str] = MISSING_MARKERS, block: str = REPORT_BLOCK) -> Column:
    """An error marker and no report: told by content, whatever the length of the page."""
    hit = F.lit(False)
    for m in markers:
        hit = hit | doc.contains(m)
    return hit & ~doc.rlike(block)


def missing_stub_filter(pages: DataFrame, markers: list[str] = MISSING_MARKERS,
                        block: str = REPORT_BLOCK) -> DataFrame:
    return pages.where(~is_missing(F.col("html"), markers, block))


def parse_listing_cards(pages: DataFrame) -> DataFrame:
    """One row per card; the last card of an id on a page wins."""
    nodes = F.col("nodes")
    cards = M.records(pages.select("page_id", "html"), ".divTableRow",
                      [".table-summary", ".table-replies", ".table-views", "a"])
    cards = cards.withColumn("summary", M.first(M.having(nodes, of="table-summary"))).where(F.col("summary").isNotNull())
    links = F.filter(M.having(nodes, tag="a", within=F.col("summary")), lambda n: n["href"].contains("view_report"))
    cards = cards.withColumn("link", M.first(links))
    cards = cards.withColumn("report_id", F.regexp_extract("link.href", r"view_report/(\d+)", 1).try_cast("bigint"))
    cards = cards.where(F.col("report_id").isNotNull())
    text, block = F.col("summary.text"), F.col("summary.inner")
    prop = F.coalesce(F.nullif(F.regexp_extract(block, r"Property\s*:\s*([^\n<]{2,})", 1), F.lit("")),
                      F.nullif(F.regexp_extract(text, r"Property\s*:\s*(.{2,}?)\s*(?:Started\s*By|$)", 1), F.lit("")))
    name, town = H.split_on_last_comma(H.unescape(prop))
    started = r"(?s)Started\s*By\s*:\s*(.*?)\s*,\s*([A-Z][a-z]{2}\s+\d{1,2},\s*\d{4})"
    count = lambda of, label: H.labelled_int(M.first(M.having(nodes, of=of))["inner"], label)
    parsed = cards.select(
        "page_id", "pos", "report_id", F.nullif("link.text", F.lit("")).alias("title"),
        name.alias("lake_name"), town.alias("lake_town"),
        F.nullif(H.clean(F.regexp_extract(text, started, 1)), F.lit("")).alias("author"),
        F.coalesce(H.parse_card_date(F.regexp_extract(text, started, 2)), H.parse_card_date(text)).alias("posted_date"),
        count("table-replies", "Replies").alias("replies"), count("table-views", "Views").alias("views"))
    fields = [c for c in parsed.columns if c not in ("page_id", "report_id")]
    last = parsed.groupBy("page_id", "report_id").agg(F.max_by(F.struct(*fields), "pos").alias("r"))
    return last.select("page_id", "report_id", "r.*")


def report_elements(pages: DataFrame) -> DataFrame:
    """Each page's blocks of a report, from one reading: title, ps and author of the user block, ems of the meta block,
    right and ps of the report, photos of the gallery."""
    nodes = F.col("nodes")
    read = M.elements(pages.select("page_id", "html"), [".post_left", ".user", ".user-meta", ".post-right", ".report-gallery"],
                      ["h2", "h3", "p", "em", "a"])
    box = lambda of, within=None: M.first(M.having(nodes, of=of, within=within))
    boxes = read.withColumns({"left": box("post_left"), "meta": box("user-meta"), "right": box("post-right"),
                              "gallery": box("report-gallery")}).withColumn("user", box("user", F.col("left")))
    inside = lambda tag, of: M.having(nodes, tag=tag, within=F.col(of))
    return boxes.select("page_id", M.first(M.having(nodes, tag="h2", of="text-dark"))["text"].alias("title"),
                        inside("p", "user").alias("user_ps"), M.first(inside("h3", "user"))["text"].alias("author"),
                        F.transform(inside("em", "meta"), lambda n: n["text"]).alias("ems"),
                        inside("p", "right").alias("ps"), F.size(inside("a", "gallery")).cast("long").alias("photo_count"))


def parse_report_page(pages: DataFrame) -> DataFrame:
    """Detail pages of both shapes: with a field block and without."""
    with_label = "|".join(FIELD_LABELS)
    blocks = report_elements(pages)
    labelled = F.filter("ps", lambda p: p["inner"].rlike(with_label))
    told = F.filter("ps", lambda p: ~p["inner"].rlike(with_label) & (p["text"] != ""))
    body = F.array_join(F.transform(told, lambda p: p["text"]), "\n\n")
    blocks = blocks.withColumn("fields", H.kv_fields(F.array_join(F.transform(labelled, lambda p: p["inner"]), "<br>"), FIELD_LABELS))
    numbers = F.filter("ems", lambda e: e.rlike(r"^\d+$"))
    field = lambda k: F.try_element_at("fields", F.lit(k))
    user = lambda k: F.get("user_ps", F.lit(k))["text"]
    day, slot = H.parse_reservation(field("Reservation Date"))
    empty_to_null = lambda c: F.nullif(c, F.lit(""))
    return blocks.select(
        "page_id", empty_to_null(F.col("title")).alias("title"), H.parse_posted_date(user(0)).alias("posted_date"),
        empty_to_null(F.col("author")).alias("author"), user(1).alias("author_rank"),
        F.get(numbers, F.lit(0)).try_cast("bigint").alias("member_since"), F.get(numbers, F.lit(1)).try_cast("bigint").alias("post_count"),
        field("Reservation Number").alias("reservation_number"), field("Property Name").alias("property_name"),
        day.alias("trip_date"), slot.alias("slot"), field("Total Fish/Sizes").alias("raw"), field("Lures Used").alias("label_raw"),
        empty_to_null(F.trim(F.regexp_replace(body, r"\s*Posted By:[^\n]*\z", ""))).alias("body"), "photo_count",
        F.when(field("Property Name").isNotNull(), "structured").otherwise("legacy").alias("era"))


def build_reports(pages: DataFrame, normalise_unit) -> DataFrame:
    """Every cached detail page that is not a stub, with its unit name normalised."""
    present = missing_stub_filter(page_scan(pages, "report"))
    return parse_report_page(present).withColumn("property_name", normalise_unit(F.col("property_name")))


# Phrases carrying a depth, and the plausible range in feet.
_N = r"(\d+(?:\.\d+)?)"
DEPTHS = [rf"(?i)depths?[^.\d]{{0,28}}?{_N}\s*(?:-|to|–|—)?\s*(?:\d+(?:\.\d+)?)?\s*(?:feet|foot|ft)\b",
          rf"(?i)(?:deep|depth)[^.\d]{{0,24}}?\(?\s*up to\s*{_N}\s*(?:feet|foot|ft)\b",
          rf"(?i){_N}\s*(?:feet|foot|ft)\s*(?:deep|in depth|of depth)\b"]
DEPTH_RANGE = (2, 120)
TIER = r"(?i)(Gold and Silver Members|Gold Member[s]? (?:Only|Exclusive)|All Members|Silver Members)"
REGION = (r"(?i)(Dallas\s*/\s*Fort Worth Area|Houston Area|Austin Area|San Antonio Area|Oklahoma Area"
          r"|East Texas|West Texas)")


def parse_unit_page(pages: DataFrame) -> DataFrame:
    """Attributes of a unit from its page; only the text before the first embedded
    report counts for size and depth."""
    text, nodes = F.col("text"), F.col("nodes")
    rows = M.elements(pages.select("slug", "html"), [], ["h1", "h2"], whole="text")
    rows = rows.where(text.contains("Property Info") | text.contains("Fishing Locations"))
    info = F.get(F.split(text, "Reservation Number", 2), F.lit(0))
    found = F.flatten(F.array(*[F.regexp_extract_all(info, F.lit(p), F.lit(1)) for p in DEPTHS]))
    depths = F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda v: v.between(*DEPTH_RANGE))
    hit = lambda rx, i=1: F.nullif(H.clean(F.regexp_extract(text, rx, i)), F.lit(""))
    boat = hit(r"(?is)Boat Availability\s*(.*?)(?:Boat Launch|Tent Camping|Property Info|\.|$)")
    heading = F.coalesce(M.first(M.having(nodes, tag="h1")), M.first(M.having(nodes, tag="h2")))["text"]
    bank = F.when(text.rlike("(?i)Bank fishing is available"), 1).when(text.rlike("(?i)Bank fishing is not available"), 0)
    return rows.select(
        "slug", F.nullif(heading, F.lit("")).alias("name"),
        F.regexp_extract(info, rf"(?i){_N}\s*(?:\+/-\s*)?acres?", 1).try_cast("double").alias("acres"),
        F.array_max(depths).alias("max_depth_ft"), hit(TIER).alias("membership_tier"), bank.alias("bank_fishing"),
        boat.alias("boat_type"), H.money_after(text, "Day Rate").alias("day_rate"),
        H.money_after(text, "Half-Day Rate").alias("half_day_rate"), hit(REGION).alias("region"),
        hit(r"(?i)(Please harvest[^.]*\.)").alias("harvest_rules"))


def json_marker_extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Flat JSON markers inside a page: parsed, kept inside the region, first per slug
    or title."""
    raw = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.col(html), F.lit(MARKER), F.lit(0))).alias("pos", "raw"))
    obj = F.from_json(H.unescape(F.col("raw")), "id string, title string, lat string, lon string, content string")
    rows = raw.select("page_id", "pos", obj.alias("o")).select(
        "page_id", "pos", F.nullif(F.trim("o.id"), F.lit("")).alias("club_id"), H.clean(F.coalesce("o.title", F.lit(""))).alias("title"),
        F.col("o.lat").try_cast("double").alias("lat"), F.col("o.lon").try_cast("double").alias("lon"),
        F.nullif(F.lower(F.regexp_extract("o.content", r"(?i)/view-property/([a-z0-9_\-]+)", 1)), F.lit("")).alias("slug"),
        F.nullif(H.clean(H.unescape(F.regexp_extract("o.content", r"(?is)<h4>(.*?)</h4>", 1))), F.lit("")).alias("place"))
    inside = rows.where(F.col("lat").between(*LAT_RANGE) & F.col("lon").between(*LON_RANGE))
    keyed = inside.withColumn("key", F.coalesce("slug", F.nullif(F.lower("title"), F.lit("")))).where(F.col("key").isNotNull())
    fields = ["club_id", "title", "slug", "lat", "lon", "place"]
    first = keyed.groupBy("key").agg(F.min_by(F.struct(*fields), F.struct("page_id", "pos")).alias("f"))
    return first.select("f.*")
