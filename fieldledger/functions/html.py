"""Markup as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Named entities, the ampersand last so nothing is decoded twice.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
            ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&ndash;", "–"),
            ("&mdash;", "—"), ("&hellip;", "…"), ("&deg;", "°"), ("&middot;", "·"), ("&copy;", "©"),
            ("&reg;", "®"), ("&frac12;", "½"), ("&eacute;", "é"), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    """Numeric and common named entities decoded; texts without '&' pass untouched."""
    def char(n: Column) -> Column:
        """The character of a code point; the replacement character where there is none."""
        valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd")

    def hex_value(n: Column) -> Column:
        digits = F.regexp_replace(n, "^0+", "")
        return F.when(F.length(digits) <= 8, F.conv(digits, 16, 10)).try_cast("bigint")

    decimal = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(\d+);"), F.lit(1)))
    hexes = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#[xX]([0-9a-fA-F]+);"), F.lit(1)))
    out = F.aggregate(decimal, text, lambda t, n: F.replace(
        t, F.concat(F.lit("&#"), n, F.lit(";")), char(n.try_cast("bigint"))))
    out = F.aggregate(hexes, out, lambda t, n: F.regexp_replace(
        t, F.concat(F.lit("&#[xX]"), n, F.lit(";")), char(hex_value(n))))
    for name, value in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.when(text.contains("&"), out).otherwise(text)


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def html_to_text(doc: Column) -> Column:
    """Whole page to plain text: scripts, styles and head dropped, tags to blanks."""
    bare = F.regexp_replace(doc, r"(?s)<(script|style|head)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(bare, r"<[^>]+>", " ")), r"[\s ]+", " "))


def node_text(fragment: Column) -> Column:
    """Text of a fragment, tags removed without a separator."""
    return clean(unescape(F.regexp_replace(fragment, r"<[^>]+>", "")))


def class_open(name: str, tag: str = "div") -> str:
    return rf"""(?i)<{tag}\b[^>]*class="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>"""


def paragraphs(fragment: Column) -> Column:
    return F.regexp_extract_all(fragment, F.lit(r"(?is)<p\b[^>]*>(.*?)(?=</p>|<p\b|\z)"), F.lit(1))


def link_count(fragment: Column) -> Column:
    return F.coalesce(F.regexp_count(fragment, F.lit(r"(?i)<a\b")), F.lit(0))


def kv_fields(fragment: Column, labels: list[str]) -> Column:
    """Map of '<strong>Label : </strong> value<br>' pairs with a known label."""
    chunks = F.split(fragment, r"(?i)<br\s*/?>")
    rx = r"(?is)<strong>\s*([^<:]+?)\s*:\s*</strong>(.*)"
    pairs = F.transform(chunks, lambda c: F.struct(
        F.regexp_extract(c, rx, 1).alias("key"), node_text(F.regexp_extract(c, rx, 2)).alias("value")))
    kept = F.filter(pairs, lambda p: p["key"].isin(labels) & (p["value"] != ""))
    # Of repeated labels the last pair wins.
    return F.aggregate(kept, F.expr("cast(map() as map<string,string>)"), lambda m, p: F.map_concat(
        F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))


def narrative_join(fragment: Column, labels: list[str]) -> Column:
    """Paragraphs without a field label, joined by a blank line, byline cut off."""
    with_label = "|".join(labels)
    texts = F.filter(F.transform(F.filter(paragraphs(fragment), lambda p: ~p.rlike(with_label)), node_text),
                     lambda t: t != "")
    body = F.array_join(texts, "\n\n")
    return F.nullif(F.trim(F.regexp_replace(body, r"\s*Posted By:[^\n]*\z", "")), F.lit(""))


def numeric_meta(fragment: Column, k: int) -> Column:
    """The k-th all-digit <em> text, as a number."""
    ems = F.transform(F.regexp_extract_all(fragment, F.lit(r"(?is)<em[^>]*>(.*?)</em>"), F.lit(1)), node_text)
    return F.get(F.filter(ems, lambda e: e.rlike(r"^\d+$")), F.lit(k)).try_cast("bigint")


def labelled_int(fragment: Column, label: str) -> Column:
    """Integer after a label and its span, else the integer ending the text."""
    direct = F.regexp_extract(fragment, rf"{label}\s*:?\s*</span>\s*(\d+)", 1)
    trailing = F.regexp_extract(node_text(fragment), r"(\d+)\s*$", 1)
    return F.coalesce(F.nullif(direct, F.lit("")), F.nullif(trailing, F.lit(""))).try_cast("bigint")


def _month_date(text: Column, rx: str) -> Column:
    joined = F.concat_ws(" ", *[F.regexp_extract(text, rx, i) for i in (1, 2, 3)])
    return F.try_to_date(joined, "MMM d yyyy")


def parse_posted_date(text: Column) -> Column:
    """'Sep 11 2026'; NULL when it is no date."""
    return _month_date(F.trim(text), r"^([A-Z][a-z]{2})\s+(\d{1,2})[ ,]+(\d{4})$")


def parse_card_date(text: Column) -> Column:
    """First 'Apr 19, 2015' in the text."""
    return _month_date(text, r"([A-Z][a-z]{2})\s+(\d{1,2}),\s*(\d{4})")


def parse_reservation(text: Column) -> tuple[Column, Column]:
    """'09/11/2026 AM -' to (date, slot); both NULL for an impossible date."""
    rx = r"(?i)(\d{1,2})/(\d{1,2})/(\d{4})\s*(AM|PM|All\s*Day)?"
    day = F.try_to_date(F.concat_ws("/", *[F.regexp_extract(text, rx, i) for i in (1, 2, 3)]), "M/d/yyyy")
    slot = F.upper(F.regexp_extract(text, rx, 4))
    named = F.when(slot.startswith("ALL"), "ALL_DAY").otherwise(F.nullif(slot, F.lit("")))
    return day, F.when(day.isNotNull(), named)


def split_on_last_comma(text: Column) -> tuple[Column, Column]:
    s = clean(text)
    has = s.contains(",")
    name = F.when(has, F.regexp_extract(s, r"(?s)^(.*),([^,]*)$", 1)).otherwise(s)
    town = F.when(has, F.regexp_extract(s, r"(?s)^(.*),([^,]*)$", 2))
    return F.nullif(clean(name), F.lit("")), F.nullif(clean(town), F.lit(""))


def money_after(text: Column, label: str) -> Column:
    """First dollar amount within thirty non-digits after a label."""
    amount = F.regexp_extract(text, rf"(?i){label}\D{{0,30}}?\$\s*([\d,]+(?:\.\d+)?)", 1)
    return F.replace(amount, F.lit(","), F.lit("")).try_cast("double")
