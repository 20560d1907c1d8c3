"""Free-text labels mapped onto a taxonomy.

The taxonomy is an argument: a table of surface forms read from a file, looked up by
the inverted dictionary, so that its size does not matter to the texts.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import collapse_ws, normalize_text
from ..sources.tables import settle
from .dictionary import WORD, find_forms, form_index, scan_forms

# Fixed value: separators of a label field; "and" is part of colour names.
SEPARATORS = r"(?i)[;,/+|\n]|\bthen\b|\balso\b"
STRIP = " .-\"'"


def phrase_pattern(phrase: str) -> str:
    """Surface form as a pattern: loose spacing and hyphens, optional plural."""
    words = r"[\s-]*".join(re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", w) for w in phrase.split())
    return rf"(?i)\b{words}s?\b"


@dataclass(frozen=True)
class Taxonomy:
    """terms: (form, category, subtype); techniques: (form, name, implied category)."""
    terms: list[tuple[str, str, str]]
    colors: list[str] = field(default_factory=list)
    techniques: list[tuple[str, str, str | None]] = field(default_factory=list)
    ambiguous: list[str] = field(default_factory=list)

    @classmethod
    def from_entries(cls, doc: dict) -> "Taxonomy":
        flat = lambda entries, *keys: [
            (form, *(e.get(k) for k in keys)) for e in entries for form in e["match"]]
        longest = lambda rows: sorted(rows, key=lambda r: -len(r[0]))
        return cls(longest(flat(doc.get("terms", []), "category", "subtype")),
                   sorted(doc.get("colors", []), key=lambda c: -len(c)),
                   longest(flat(doc.get("techniques", []), "name", "implies")),
                   [a.lower() for a in doc.get("ambiguous", [])])


def taxonomy_dim(spark: SparkSession, tax: Taxonomy) -> DataFrame:
    """(form, pattern, category, subtype, length, seq)."""
    rows = [(f, phrase_pattern(f), c, s, len(f), i) for i, (f, c, s) in enumerate(tax.terms)]
    return spark.createDataFrame(rows, "form string, pattern string, category string, subtype string, length int, seq int")


def strip_ends(c: Column) -> Column:
    return F.btrim(c, F.lit(STRIP))


def split_parts(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, SEPARATORS), strip_ends), lambda p: p != "")


def _forms(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Forms in order of their rank, keyed for lookup; schema: the further fields."""
    return form_index(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"rank int, form string{schema}"))


def _widest(forms: list[str]) -> int:
    return max((len(re.findall(WORD, f.lower())) for f in forms), default=0)


def _consumed(texts: DataFrame, found: DataFrame, known: DataFrame) -> DataFrame:
    """Takes the forms found out of each text, techniques first, longest form first.

    Adds left (what remains), techs, implied, hits, and trail: the texts in between."""
    no_names = F.expr("cast(array() as array<string>)")
    no_hits = F.expr("cast(array() as array<struct<category:string,subtype:string>>)")
    details = known.select("rank", "pattern", "technique", "name", "category", "subtype").dropDuplicates(["rank"])
    lists = found.join(details, "rank").groupBy("part").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "pattern", "technique", "name", "category", "subtype"))).alias("_forms"))
    start = F.struct(F.col("_text").alias("text"), no_names.alias("techs"), F.lit(None).cast("string").alias("implied"),
                     no_hits.alias("hits"), no_names.alias("trail"))

    def step(acc: Column, f: Column) -> Column:
        every = F.trim(F.regexp_replace(acc["text"], f["pattern"], F.lit(" ")))
        once = F.trim(F.regexp_replace(acc["text"], F.concat(F.lit("(?s)^(.*?)(?:"), f["pattern"], F.lit(")")), F.lit("$1 ")))
        after = F.when(f["technique"], every).otherwise(once)
        hit = F.struct(f["category"].alias("category"), f["subtype"].alias("subtype"))
        return F.when(F.regexp_like(acc["text"], f["pattern"]), F.struct(
            after.alias("text"),
            F.when(f["technique"], F.array_union(acc["techs"], F.array(f["name"]))).otherwise(acc["techs"]).alias("techs"),
            F.when(f["technique"], F.coalesce(acc["implied"], f["category"])).otherwise(acc["implied"]).alias("implied"),
            F.when(f["technique"], acc["hits"]).otherwise(F.concat(acc["hits"], F.array(hit))).alias("hits"),
            F.concat(acc["trail"], F.array(after)).alias("trail"))).otherwise(acc)

    joined = texts.join(lists, "part", "left")
    folded = joined.withColumn("_a", F.when(F.col("_forms").isNull(), start).otherwise(F.aggregate("_forms", start, step)))
    return folded.select("part", "_text", F.col("_a.text").alias("left"), "_a.techs", "_a.implied", "_a.hits", "_a.trail")


def parse_parts(parts: DataFrame, tax: Taxonomy, part: str = "part") -> DataFrame:
    """Adds kind, hits and techniques to the different parts of label fields.

    kind: 'hit', 'ambiguous', 'unknown' or 'empty'. Techniques are taken out first and may imply a category; then
    terms, longest first, each consuming its first occurrence; the colour comes from what is left.

    Forms are found by the inverted dictionary. Taking one out can bring the words around it together, so the texts in
    between are looked up too, until no further form turns up; each turn concerns only parts with a new form.
    """
    spark = parts.sparkSession
    none = F.expr("cast(array() as array<struct<category:string,subtype:string,color:string>>)")
    no_names = F.expr("cast(array() as array<string>)")
    ambiguous = list(tax.ambiguous)
    text = F.col("_text")
    texts = settle(parts.select(F.col(part).alias("part")).dropDuplicates().withColumn("_text", normalize_text(F.col("part"))))
    known = _forms(spark, [(f, True, n, i, None) for f, n, i in tax.techniques]
                   + [(f, False, None, c, s) for f, c, s in tax.terms],
                   ", technique boolean, name string, category string, subtype string")
    widest = _widest([f for f, *_ in tax.techniques + tax.terms])
    look_up = lambda rows: find_forms(rows, known, widest).select("part", "rank").dropDuplicates()
    found = settle(look_up(texts))
    while True:
        taken = settle(_consumed(texts, found, known))
        between = taken.where(F.size("trail") > 0).select("part", F.explode(F.array_distinct("trail")).alias("_text"))
        new = settle(look_up(between).join(found, ["part", "rank"], "left_anti"))
        if new.isEmpty():
            break
        found = settle(found.union(new))
    colors = _forms(spark, [(c,) for c in tax.colors], "")
    seen = (find_forms(taken.select("part", F.col("left").alias("_text")), colors, _widest(tax.colors))
            .groupBy("part").agg(F.min("rank").alias("rank"))
            .join(colors.select("rank", F.col("form").alias("_color"), "pattern").dropDuplicates(["rank"]), "rank").drop("rank"))
    out = taken.join(seen, "part", "left").withColumn("_left", collapse_ws(
        F.when(F.col("pattern").isNull(), F.col("left")).otherwise(F.regexp_replace("left", F.col("pattern"), F.lit(" ")))))

    one = lambda cat, sub: F.array(F.struct(cat.cast("string").alias("category"), sub.cast("string").alias("subtype"),
                                            F.col("_color").alias("color")))
    coloured = F.transform("hits", lambda h: F.struct(
        h["category"].alias("category"), h["subtype"].alias("subtype"), F.col("_color").alias("color")))
    filler = text.isin(ambiguous) | text.rlike(r"^\d+$")
    implied = F.col("implied")
    bare_color = (F.col("_left") == "") & F.col("_color").isNotNull()
    found = F.size("hits") > 0
    kind = (F.when(text == "", "empty").when(filler, "ambiguous").when(found | implied.isNotNull() | bare_color, "hit")
            .when(F.col("_left") == "", "empty").when(F.col("_left").isin(ambiguous), "ambiguous").otherwise("unknown"))
    hits = (F.when((text == "") | filler, none).when(found, coloured)
            .when(implied.isNotNull(), one(implied, F.lit("unspecified")))
            .when(bare_color, one(F.lit(None), F.lit(None))).otherwise(none))
    spoken = F.when((text == "") | filler, no_names).otherwise(F.col("techs"))
    return out.select(F.col("part").alias(part), kind.alias("kind"), hits.alias("hits"), spoken.alias("techniques"))


def label_parse_field(reports: DataFrame, tax: Taxonomy, raw: str = "label_raw") -> DataFrame:
    """One row per part: obs_id, pos, part, kind, hits, techniques. Each different spelling is
    parsed once, however often it was written."""
    parts = reports.select("obs_id", F.posexplode(split_parts(F.col(raw))).alias("pos", "part"))
    known = parse_parts(parts.select("part").dropDuplicates(), tax)
    return parts.join(known, "part").select("obs_id", "pos", "part", "kind", "hits", "techniques")


def field_hits(parsed: DataFrame) -> DataFrame:
    return parsed.select("obs_id", "pos", "part", F.posexplode("hits").alias("i", "h")).select(
        "obs_id", F.col("part").alias("raw"), "h.category", "h.subtype", "h.color",
        (F.col("pos") * 1000 + F.col("i")).alias("seq"))


def review_queue(parsed: DataFrame, limit: int | None = None) -> DataFrame:
    out = parsed.where(F.col("kind") == "unknown").groupBy(F.col("part").alias("raw")).agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "raw")
    return out if limit is None else out.limit(limit)


def label_scan_text(reports: DataFrame, tax: Taxonomy, body: str = "body") -> DataFrame:
    """Every (category, subtype) of the taxonomy present in a text, with the match of
    its longest surface form."""
    forms = reports.sparkSession.createDataFrame([(i, *t) for i, t in enumerate(tax.terms)],
                                                 "rank int, form string, category string, subtype string")
    return scan_forms(reports, forms, body)


def scan_techniques(reports: DataFrame, tax: Taxonomy, body: str = "body") -> DataFrame:
    """The techniques named in each text that is not null, in the order of the taxonomy."""
    index = _forms(reports.sparkSession, [(f, n) for f, n, _ in tax.techniques], ", name string")
    texts = reports.where(F.col(body).isNotNull()).select("obs_id", normalize_text(F.col(body)).alias("_text"))
    first = (find_forms(texts, index, _widest([f for f, *_ in tax.techniques])).groupBy("obs_id", "name")
             .agg(F.min("rank").alias("rank")))
    named = first.groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("n"))
    names = F.coalesce(F.transform("n", lambda x: x["name"]), F.expr("cast(array() as array<string>)"))
    return texts.select("obs_id").join(named, "obs_id", "left").select("obs_id", names.alias("techniques"))


def label_dedupe(hits: DataFrame) -> DataFrame:
    """Drops 'unspecified' where the same observation names a specific subtype of the
    category, then repeats of (category, subtype, color)."""
    specific = hits.where(F.col("category").isNotNull() & (F.col("subtype") != "unspecified")) \
        .select("obs_id", "category").dropDuplicates().withColumn("_specific", F.lit(True))
    marked = hits.dropDuplicates(["obs_id", "category", "subtype", "color"]).join(
        specific, ["obs_id", "category"], "left")
    generic = F.coalesce(F.col("_specific") & (F.col("subtype") == "unspecified"), F.lit(False))
    return marked.where(~generic).drop("_specific")


def label_merge_sources(hits: DataFrame) -> DataFrame:
    """One row per (obs, category, subtype): the field's hit before the narrative's."""
    priority = F.when(F.col("source") == "field", 0).otherwise(1)
    first = F.min(F.struct(priority.alias("p"), "seq", "raw", "color", "source"))
    return (hits.where(F.col("category").isNotNull()).groupBy("obs_id", "category", "subtype")
            .agg(first.alias("f")).select("obs_id", "category", "subtype", "f.raw", "f.color", "f.source"))


def ordered_union(first: Column, second: Column) -> Column:
    """Entries of the first array, then unseen ones of the second, order kept."""
    empty = F.expr("cast(array() as array<string>)")
    return F.array_union(F.coalesce(first, empty), F.coalesce(second, empty))
