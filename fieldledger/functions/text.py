"""Text rules as column expressions. Whole texts, JVM-side, no row-wise Python."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import vocabulary as V


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; NULL when the pattern or the group does not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def match_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) for every match, zero-based. Start positions come
    from the lengths of the pieces between the matches."""
    pieces = F.split(text, pattern, -1)
    steps = bound(every(text, pattern), lambda hits: F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, m: F.struct(
        F.length(p).alias("gap"), m.alias("text"))))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")
    folded = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("spans")), lambda acc, s: F.struct(
        (acc["at"] + s["gap"] + F.length(s["text"])).alias("at"),
        F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + F.length(s["text"])).alias("end"),
            s["text"].alias("text")))).alias("spans")))
    return folded["spans"]


def parse_decimal(token: Column) -> Column:
    """'2,5' and '.25' included."""
    dotted = F.replace(token, F.lit(","), F.lit("."))
    return F.when(dotted.startswith("."), F.concat(F.lit("0"), dotted)).otherwise(dotted).try_cast("double")


def _around(text: Column, span: Column, before: int, after: int) -> tuple[Column, Column]:
    start = F.greatest(F.lit(0), span["start"] - before)
    return (F.substr(text, start + 1, span["start"] - start), F.substr(text, span["end"] + 1, F.lit(after)))


# --- totals -------------------------------------------------------------------------
def species_pairs(raw: Column) -> Column:
    """(species, n) summed over the '<n> <species>' pairs of the text."""
    s = F.trim(raw)
    counts, tokens = every(s, V.COUNT_SPECIES, 1), every(s, V.COUNT_SPECIES, 2)

    def canonical(token: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(V.SPECIES):
            out = F.when(token.rlike(f"(?i)^(?:{pattern})"), name).otherwise(out)
        return out

    pairs = F.filter(F.zip_with(counts, tokens, lambda n, t: F.struct(
        canonical(t).alias("species"), n.try_cast("bigint").alias("n"))),
        lambda p: p["n"].between(1, V.MAX_COUNT))
    summed = bound(pairs, lambda pairs: F.transform(
        F.array_distinct(F.transform(pairs, lambda p: p["species"])), lambda name: F.struct(name.alias("species"), F.aggregate(
            F.filter(pairs, lambda p: p["species"] == name), F.lit(0).cast("bigint"), lambda a, p: a + p["n"]).alias("n"))))
    return F.array_sort(summed, lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).otherwise(0))


def count_total(raw: Column, species: Column | None = None) -> Column:
    """First whole number that is not a size, else the sum of the species pairs."""
    s = F.trim(raw)
    numbers = bound(match_spans(s, V.SIZE), lambda sizes: F.filter(match_spans(s, V.NUMBER), lambda m: ~F.exists(
        sizes, lambda z: (z["start"] <= m["start"]) & (m["start"] < z["end"]))))
    values = F.filter(F.transform(numbers, lambda m: parse_decimal(m["text"])),
                      lambda v: (v == F.floor(v)) & v.between(0, V.MAX_COUNT))
    first = F.get(values, F.lit(0)).cast("bigint")
    pairs = species_pairs(raw) if species is None else species
    return F.coalesce(first, F.when(F.size(pairs) > 0, F.aggregate(
        pairs, F.lit(0).cast("bigint"), lambda a, p: a + p["n"])))


def max_weight(raw: Column) -> Column:
    """Largest plausible single weight; a bag weight is left out unless the number is
    directly marked as one fish."""
    s = F.trim(raw)

    def single(span: Column) -> Column:
        lead, trail = _around(s, span, V.LEAD_CHARS, V.TRAIL_CHARS)
        return lead.rlike(V.SINGLE) | ~(lead.rlike(V.BAG) | trail.rlike(V.BAG))

    kept = F.filter(match_spans(s, V.WEIGHT), single)
    values = F.transform(kept, lambda m: parse_decimal(F.regexp_extract(m["text"], V.WEIGHT, 1)))
    return F.array_max(F.filter(values, lambda v: v.between(*V.WEIGHT_RANGE)))


def max_length(raw: Column) -> Column:
    values = F.transform(every(F.trim(raw), V.LENGTH, 1), parse_decimal)
    return F.array_max(F.filter(values, lambda v: v.between(*V.LENGTH_RANGE)))


def vague_flag(raw: Column, total: Column) -> Column:
    return F.coalesce(total.isNull() & raw.rlike(V.VAGUE), F.lit(False))


def species_mentions(text: Column) -> Column:
    """Canonical names occurring in the text, in the order of the alias list."""
    return F.array_distinct(F.array_compact(F.array(
        *[F.when(text.rlike(f"(?i){p}"), name) for name, p in V.SPECIES])))


# --- features -----------------------------------------------------------------------
def clarity_ft(body: Column) -> Column:
    def valid(pattern: str) -> Column:
        value, unit = found(body, pattern, 1).try_cast("double"), F.regexp_extract(body, pattern, 2)
        feet = F.when(unit.rlike(V.INCH_UNIT), value / 12.0).otherwise(value)
        return F.when((feet > 0) & (feet <= V.MAX_CLARITY), F.round(feet, 2))
    return F.coalesce(*[valid(p) for p in V.CLARITY_NUMBERS])


def first_class(text: Column, ordered: list[tuple[str, str]]) -> Column:
    """Name of the first class, in the given order, whose pattern occurs."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(ordered):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def clarity_label(body: Column) -> Column:
    return first_class(body, V.CLARITY_LABELS)


def water_temp(body: Column) -> Column:
    def valid(pattern: str) -> Column:
        value = found(body, pattern, 1).try_cast("double")
        return F.when(value.between(*V.WATER_TEMP_RANGE), value)
    return F.coalesce(*[valid(p) for p in V.WATER_TEMP])


def depth_range(body: Column) -> Column:
    """Struct (lo, hi) over all depth mentions."""
    ok = lambda v: (v > 0) & (v <= V.MAX_DEPTH)
    pairs = F.zip_with(every(body, V.DEPTH, 1), every(body, V.DEPTH, 2), lambda a, b: F.struct(
        a.try_cast("double").alias("a"),
        F.coalesce(F.nullif(b, F.lit("")).try_cast("double"), a.try_cast("double")).alias("b")))
    kept = F.filter(pairs, lambda p: ok(p["a"]) & ok(p["b"]))
    return bound(kept, lambda kept: F.struct(
        F.array_min(F.transform(kept, lambda p: F.least(p["a"], p["b"]))).alias("lo"),
        F.array_max(F.transform(kept, lambda p: F.greatest(p["a"], p["b"]))).alias("hi")))


def bite_window(body: Column) -> Column:
    return first_class(body, V.BITE_WINDOW)


def blank_flag(body: Column, total: Column) -> Column:
    return F.when(total > 0, 0).when(body.rlike(V.BLANK), 1)


def density_near(body: Column, pattern: str) -> Column:
    """Density word close to the first match of a pattern."""
    def near(at: Column) -> Column:
        end = at + F.length(F.regexp_extract(body, pattern, 0))
        start = F.greatest(F.lit(0), at - V.DENSITY_BEFORE)
        return F.substr(body, start + 1, end + V.DENSITY_AFTER - start)
    window = bound(F.length(F.get(F.split(body, pattern, 2), F.lit(0))), near)
    return bound(window, lambda text: first_class(text, V.DENSITY))


def vocab_tags(body: Column, vocabulary: dict[str, list[tuple[str, str]]], dense: tuple = ("vegetation",)) -> Column:
    """Array of (kind, value, detail) for every vocabulary entry found. One pass over
    the text; the detail is filled for the kinds that carry a density."""
    entries = []
    for kind, terms in vocabulary.items():
        for value, raw in terms:
            pattern = f"(?i){raw}"
            detail = density_near(body, pattern) if kind in dense else F.lit(None).cast("string")
            entries.append(F.when(body.rlike(pattern), F.struct(
                F.lit(kind).alias("kind"), F.lit(value).alias("value"), detail.alias("detail"))))
    return F.array_compact(F.array(*entries))


FISHING_VOCABULARY = {"vegetation": V.VEGETATION, "structure": V.STRUCTURE, "technique": V.TECHNIQUE}


# --- normal forms ---------------------------------------------------------------------
OTHER_ASCII = "".join(c for c in map(chr, range(128)) if not re.match(r"""[a-z0-9"'. -]""", c))


def normalize_text(text: Column) -> Column:
    lowered = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("&"), F.lit(" and "))
    # as [^a-z0-9"'.-]+ to a blank, which takes some ten times as long: Java tries the members of such a class one by one
    plain = F.regexp_replace(F.translate(lowered, OTHER_ASCII, " " * len(OTHER_ASCII)), r"[^\x00-\x7f]+", " ")
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def stem_phrase(phrase: Column) -> Column:
    """Crude singular of every word."""
    def stem(w: Column) -> Column:
        cut = lambda k: F.substr(w, F.lit(1), F.length(w) - k)
        return (F.when(w.endswith("ies") & (F.length(w) > 4), F.concat(cut(3), F.lit("y")))
                .when(w.rlike("[sxzh]es$") & (F.length(w) > 4), cut(2))
                .when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 3), cut(1)).otherwise(w))
    return F.array_join(F.transform(F.split(F.trim(phrase), r"\s+"), stem), " ")
